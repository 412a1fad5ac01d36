"""Triage of pending chunks, batched model calls, merging of suggestions, and the human queue."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.config import DEFAULT, EngineConfig
from quire.operators.state import shared_key

#: Fixed value: the review prompt around the text.
PROMPT = (
    "You are a technical documentation reviewer. Review the following text for:\n1. Grammar and spelling errors\n2. Technical accuracy\n3. Clarity and consistency\n4. Formatting issues\n\nText to review:\n",
    "\nPlease provide:\n1. Corrected text\n2. List of changes made (with before/after details)\n3. Confidence score (0-1)\n4. Brief reasoning for major changes\n\nFormat your response as JSON with this exact structure:\n"
    '{\n  "corrected_text": "the corrected text here",\n  "changes": [\n    {\n      "original": "text before",\n      "corrected": "text after",\n      "reason": "why this change was made"\n    }\n  ],\n  "confidence": 0.95,\n  "reasoning": "overall explanation of changes"\n}\n\n'
    'IMPORTANT: The "changes" array must contain objects with "original", "corrected", and "reason" fields.\n',
)


def triage(pending: DataFrame, reviews: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """pending (chunk_id, content) with rule_suggestion, rule_confidence and lane: auto, high or normal.

    reviews: the latest review of each chunk (reviewed_content, confidence); without one the content counts at 0.5, normal.
    """
    key = shared_key(pending, reviews)
    r = reviews.select(*key, F.col("reviewed_content").alias("_text"), F.col("confidence").alias("_conf"))
    j = pending.join(r, key, "left")
    conf = F.col("_conf")
    lane = F.when(conf > config.auto_above, "auto").when(conf < config.high_below, "high").otherwise("normal")
    return j.withColumns({"rule_suggestion": F.coalesce("_text", "content"), "rule_confidence": F.coalesce(conf, F.lit(0.5)), "lane": lane}).drop("_text", "_conf")


def call_in_batches(queue: DataFrame, client: Callable[[], Callable[[list[dict[str, Any]]], list[dict[str, Any]]]], config: EngineConfig = DEFAULT, attempts: int = 3, pause: float = 2.0) -> DataFrame:
    """Key, suggestion, confidence, source, reasoning of queue rows (document_id, chunk_id, content, lane, rule_suggestion, rule_confidence).

    Rows go out in the batches of ``batch_numbers``; a queue without documents is one of a single document. ``client()`` is
    made once in a task; where it fails ``attempts`` times (see ``retrying``), the batch keeps the rules' results. Calls in different partitions run side by side, so
    the partition count bounds the load; a lost task repeats its calls, so they should be idempotent (``journal`` repeats none
    that was answered). Answers beyond the shorter of batch and reply are dropped.
    """
    key = shared_key(queue)
    rows = batch_numbers(queue, config).select(*key, "content", "lane", "rule_suggestion", "rule_confidence", "batch")

    def answers(call: Callable, batch: list[dict[str, Any]]) -> list[tuple]:
        own = lambda x: tuple(x[c] for c in key)
        try:
            return [(*own(x), r.get("suggestion", x["rule_suggestion"]), r.get("confidence", 0.7), "api", r.get("reasoning")) for x, r in zip(batch, call(batch))]
        except Exception as e:  # an unavailable model must not fail the job
            return [(*own(x), x["rule_suggestion"], x["rule_confidence"], "rule_fallback", f"API error: {e}") for x in batch]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, batch, last = retrying(client(), attempts, pause), [], None
        names = [*key, "suggestion", "confidence", "source", "reasoning"]
        for frame in frames:
            out = []
            for x in frame.to_dict("records"):
                at = (x.get("document_id"), x.pop("batch"))
                if batch and at != last:
                    out += answers(call, batch)
                    batch = []
                last = at
                batch.append(x)
            yield pd.DataFrame(out, columns=names)
        if batch:
            yield pd.DataFrame(answers(call, batch), columns=names)

    # The rows of a batch follow one another: numbering sorts each document in one partition.
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes if n in key), "suggestion string, confidence double, source string, reasoning string"])
    return rows.mapInPandas(each, schema)


def merge(api: DataFrame, queue: DataFrame) -> DataFrame:
    """api results merged with the rules' suggestions; results without a queue row pass unchanged.

    Agreement raises confidence; else a side above 0.9 wins, the model first; both under 0.8 go to a human; the rest averages.
    """
    key = shared_key(api, queue)
    q = queue.select(*key, F.col("rule_suggestion").alias("_rule"), F.col("rule_confidence").alias("_rc"), F.lit(True).alias("_in"))
    j = api.join(q, key, "left")
    a, r = F.col("confidence"), F.col("_rc")
    agree = F.col("suggestion").eqNullSafe(F.col("_rule"))
    way = F.when(F.col("_in").isNull(), F.col("source")).when(agree, "hybrid_agreement").when(a > 0.9, "api_high_confidence").when(r > 0.9, "rule_high_confidence").when((a < 0.8) & (r < 0.8), "needs_human").otherwise("hybrid_moderate")
    j = j.withColumn("_way", way)
    pick = lambda **kw: F.when(F.col("_way") == "hybrid_agreement", kw["agree"]).when(F.col("_way") == "rule_high_confidence", kw["rule"]).when(F.col("_way") == "needs_human", kw["human"]).when(F.col("_way") == "hybrid_moderate", kw["mean"])
    text = pick(agree=F.col("suggestion"), rule=F.col("_rule"), human=F.lit(None).cast("string"), mean=F.col("suggestion"))
    conf = pick(agree=F.least(F.lit(0.98), (a + r) / 2 * 1.1), rule=r, human=F.lit(0.5), mean=(a + r) / 2)
    own = F.col("_way").isin("hybrid_agreement", "rule_high_confidence", "needs_human", "hybrid_moderate")
    return j.select(*shared_key(api), F.when(own, text).otherwise(F.col("suggestion")).alias("suggestion"), F.when(own, conf).otherwise(a).alias("confidence"), F.col("_way").alias("source"))


def needs_human(merged: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    return merged.agg(F.count_if(F.col("confidence") < config.human_below).alias("needs_human"), F.count("*").alias("total"))


def human_queue(chunks: DataFrame, latest: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks whose latest review (confidence, reviewed_content, n_changes) is uncertain, most urgent first, with previews."""
    key = shared_key(chunks, latest)
    j = chunks.join(latest.select(*key, "confidence", "reviewed_content", "n_changes"), key).filter(F.col("confidence") < config.human_below)
    urgent = F.when(F.col("confidence") < 0.6, "high").when(F.col("n_changes") > 10, "medium").when(F.col("page_start") < 50, "medium").otherwise("low")
    out = j.select(
        "document_id", "chunk_id", F.col("section_hierarchy").alias("section"), F.col("page_start").alias("page"), "confidence", F.substring("content", 1, 200).alias("original"),
        F.substring(F.nullif("reviewed_content", F.lit("")), 1, 200).alias("suggestion"), F.col("n_changes").alias("changes_count"), urgent.alias("priority"),
    )
    return out.orderBy(F.array_position(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("priority")), "confidence", "page", "chunk_id")


def review_prompt(text: Column, context: Column) -> Column:
    extra = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("\nContext:\n"), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(PROMPT[0]), text, F.lit("\n"), extra, F.lit(PROMPT[1]))


#: A reply's changes: objects, or plain strings, which count as corrections.
_CHANGES = "array<string>"


def parse_reply(reply: Column) -> Column:
    """struct<content, confidence, reasoning, changes>: from JSON with defaults, or the reply itself at 0.7 where it is none.

    changes are in the shape of the language rules' changes, of type llm_suggestion, at the reply's confidence and position 0.
    """
    parsed = F.from_json(reply, f"corrected_text string, confidence double, reasoning string, changes {_CHANGES}")
    is_json = F.try_parse_json(reply).isNotNull()
    confidence = F.when(is_json, F.coalesce(parsed["confidence"], F.lit(0.8))).otherwise(0.7)

    def change(c: Column) -> Column:
        field = lambda name: F.get_json_object(c, f"$.{name}")
        is_object = c.startswith("{")
        return F.struct(
            F.lit("llm_suggestion").alias("type"), F.when(is_object, F.coalesce(field("original"), F.lit(""))).otherwise("").alias("original"),
            F.when(is_object, F.coalesce(field("corrected"), F.lit(""))).otherwise(c).alias("corrected"), F.lit(0).alias("position"), confidence.alias("confidence"),
            F.when(is_object, F.coalesce(field("reason"), F.lit("LLM suggestion"))).otherwise("LLM suggestion").alias("reason"),
        )

    listed = F.transform(F.filter(F.coalesce(parsed["changes"], F.array().cast(_CHANGES)), lambda c: c.isNotNull()), change)
    return F.struct(
        F.when(is_json, F.coalesce(parsed["corrected_text"], reply)).otherwise(reply).alias("content"),
        confidence.alias("confidence"), F.when(is_json, parsed["reasoning"]).alias("reasoning"), listed.alias("changes"),
    )


def gate(reviewed: DataFrame, replies: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """reviewed (chunk_id, rule_text, rule_confidence) with the model's text where it was asked and clearly better.

    Asked where the rules' confidence is under ``llm_threshold``; accepted above it by more than ``llm_min_gain``.
    """
    key = shared_key(reviewed, replies)
    r = replies.select(*key, F.col("content").alias("_text"), F.col("confidence").alias("_conf"))
    j = reviewed.join(r, key, "left")
    asked = F.col("rule_confidence") < config.llm_threshold
    better = asked & F.coalesce(F.col("_conf") > F.col("rule_confidence") + config.llm_min_gain, F.lit(False))
    out = j.withColumns({"asked": asked, "accepted": better, "final_text": F.when(better, F.col("_text")).otherwise(F.col("rule_text")), "confidence": F.when(better, F.col("_conf")).otherwise(F.col("rule_confidence"))})
    return out.drop("_text", "_conf")


def echo_client() -> Callable[[list[dict[str, Any]]], list[dict[str, Any]]]:
    """A deterministic stand-in: returns each text unchanged at 0.85."""
    return lambda batch: [{"suggestion": x["content"], "confidence": 0.85} for x in batch]


def retrying(call: Callable, attempts: int = 3, pause: float = 2.0, most: float = 10.0, sleep: Callable[[float], None] | None = None) -> Callable:
    """``call`` with up to ``attempts`` tries and exponential pauses between ``pause`` and ``most`` seconds."""
    import time

    def run(*args: Any) -> Any:
        for i in range(attempts):
            try:
                return call(*args)
            except Exception:
                if i + 1 == attempts:
                    raise
                (sleep or time.sleep)(min(most, pause * 2**i))

    return run


def batch_numbers(queue: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """queue with the batch of ``batch_size`` that each row falls into, in chunk order within its document."""
    document = [c for c in shared_key(queue) if c == "document_id"]
    n = F.row_number().over(Window.partitionBy(*document).orderBy("chunk_id"))
    return queue.withColumn("batch", F.floor((n - 1) / config.batch_size))
