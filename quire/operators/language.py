"""Language rules: spelling, spacing, punctuation and ranges. Each pass gives the corrected text and its changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.functions.staging import staged
from quire.functions.text import MARK, bind, cased, cut, keep_case, marked, matches
from quire.operators import differ
from quire.schemas import CHANGE

#: Typos and corrections, in the order in which they are looked for.
TYPOS = {
    "occured": "occurred", "recieve": "receive", "seperate": "separate", "teh": "the", "taht": "that",
    "thier": "their", "wich": "which", "wiht": "with", "adn": "and", "nad": "and",
}
#: Reasons and confidences of the rules.
SPACES = ("grammar", r"  +", "Multiple spaces replaced with single space", 1.0)
PUNCTUATION = ("grammar", r"[.!?,;:][A-Z]", "Missing space after punctuation", 0.9)
RANGE = ("style", r"(\d(?<!\d\d)\d*+)[ \t]++-[ \t]++(\d++)", "Standardized number range formatting", 0.85)
TYPO_CONFIDENCE = 0.95
#: Fixed value: what a missing-space change counts for in a chunk's confidence.
CALIBRATED = {"Missing space after punctuation": 0.92}


def _change(kind: str, original: Column, corrected: Column, position: Column, confidence: float, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), original.alias("original"), corrected.alias("corrected"), position.cast("int").alias("position"), F.lit(confidence).alias("confidence"), reason.alias("reason"))


def _fix(text: Column, pattern: str, change, plain) -> Column:
    """struct<t, c>: the text with its matches corrected, and their changes from right to left; the pattern passes over the text once.

    ``change`` makes a change of a match (text, position); ``plain`` corrects a text that has the mark by which others are cut.
    """

    def fixed(t: Column) -> Column:
        def of(pieces: Column) -> Column:
            def both(found: Column) -> Column:
                parts = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(found, F.shiftright(i, 1))["corrected"]))
                return F.struct(F.when(t.contains(MARK), plain(t)).otherwise(F.array_join(parts, "")).alias("t"), F.reverse(found).alias("c"))

            return bind(F.transform(matches(pieces), change), both)

        # A text without matches is not cut up.
        right = F.struct(t.alias("t"), F.array().cast(f"array<{CHANGE}>").alias("c"))
        return F.when(t.isNotNull(), bind(marked(t, pattern), lambda m: F.when(m.contains(MARK), bind(cut(m), of)).otherwise(right)))

    # Named once: passes that work on one another's texts would else grow by powers where a filter takes them all in.
    return bind(text, fixed)


def _rule(text: Column, rule: tuple[str, str, str, float], fix, plain) -> Column:
    kind, pattern, reason, conf = rule
    return _fix(text, pattern, lambda m: _change(kind, m["text"], fix(m["text"]), m["position"], conf, F.lit(reason)), plain)


def _spelling(text: Column) -> Column:
    def step(a: Column, typo: Column) -> Column:
        done = F.struct(a["t"].alias("t"), F.array().cast(f"array<{CHANGE}>").alias("c"))
        for word, correction in TYPOS.items():
            done = F.when(typo == word, _typo(a["t"], word, correction)).otherwise(done)
        return bind(done, lambda d: F.struct(d["t"].alias("t"), F.concat(a["c"], d["c"]).alias("c")))

    def fixed(t: Column) -> Column:
        zero = F.struct(t.alias("t"), F.array().cast(f"array<{CHANGE}>").alias("c"))
        table = bind(F.lower(t), lambda low: F.filter(F.array(*[F.lit(w) for w in TYPOS]), lambda w: F.contains(low, w)))
        return F.aggregate(table, zero, step)

    return bind(text, fixed)


def _typo(text: Column, typo: str, correction: str) -> Column:
    def change(m: Column) -> Column:
        fixed = cased(m["text"], typo, correction)
        return _change("spelling", m["text"], fixed, m["position"], TYPO_CONFIDENCE, F.concat(F.lit("Common typo: '"), m["text"], F.lit("' → '"), fixed, F.lit("'")))

    # Letters first: where a word starts is looked up only behind them, and not at every place of the text.
    return _fix(text, rf"(?i:{typo})(?<=\b(?i:{typo}))\b", change, lambda t: keep_case(t, typo, correction))


def _spaces(text: Column) -> Column:
    return _rule(text, SPACES, lambda w: F.lit(" "), lambda t: F.regexp_replace(t, "  +", " "))


def _punctuation(text: Column) -> Column:
    apart = lambda t: F.regexp_replace(t, r"([.!?,;:])([A-Z])", "$1 $2")
    return _rule(text, PUNCTUATION, apart, apart)


def _ranges(text: Column) -> Column:
    joined = lambda t: F.regexp_replace(t, RANGE[1], "$1-$2")
    return _rule(text, RANGE, joined, joined)


def spelling(text: Column) -> tuple[Column, Column]:
    """Typos corrected in the word's case; changes per typo from right to left.

    A typo's pattern runs only over texts that contain its letters at all.
    """
    both = _spelling(text)
    return both["t"], both["c"]


def grammar_spaces(text: Column) -> tuple[Column, Column]:
    both = _spaces(text)
    return both["t"], both["c"]


def grammar_punctuation(text: Column) -> tuple[Column, Column]:
    both = _punctuation(text)
    return both["t"], both["c"]


def style_ranges(text: Column) -> tuple[Column, Column]:
    both = _ranges(text)
    return both["t"], both["c"]


def review(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """chunks with reviewed_content, changes and confidence; each pass works on the text that the one before left.

    A null content gives null text and no changes. The passes are materialised as columns, one projection each.
    """
    df, parts = chunks.withColumn("_t0", F.col("content")), []
    passes = [("spell", _spelling)] * config.spellcheck + [("space", _spaces), ("punct", _punctuation)] * config.grammar_check + [("style", _ranges)] * config.style_check
    for i, (name, apply) in enumerate(passes):
        df = df.withColumn("_both", apply(F.col(f"_t{i}")))
        df = df.withColumns({f"_t{i + 1}": F.col("_both.t"), f"_c_{name}": F.coalesce("_both.c", F.array().cast(f"array<{CHANGE}>"))}).drop("_both")
        parts.append(f"_c_{name}")
    joined = F.concat(*parts) if parts else F.array().cast(f"array<{CHANGE}>")
    out = df.withColumns({"reviewed_content": F.col(f"_t{len(passes)}"), "changes": joined})
    return out.withColumn("confidence", confidence(F.col("changes"))).drop(*parts, *[f"_t{i}" for i in range(len(passes) + 1)])


def confidence(changes: Column) -> Column:
    """Mean calibrated confidence of the changes, lowered where there are many; 1 without changes; two decimals."""
    value = lambda c: F.when((c["type"] == "grammar") & (c["reason"] == "Missing space after punctuation"), CALIBRATED["Missing space after punctuation"]).otherwise(c["confidence"])
    n = F.size(changes)
    mean = F.aggregate(changes, F.lit(0.0), lambda a, c: a + value(c)) / F.greatest(n, F.lit(1))
    return F.when(n <= 0, 1.0).otherwise(F.round(F.round(F.when(n > 20, mean * 0.85).when(n > 10, mean * 0.92).otherwise(mean), 9), 2))


def change_rows(reviewed: DataFrame) -> DataFrame:
    """One row per change: chunk_id, ordinal and the change's fields."""
    # The outer form keeps the optimizer from computing the changes a second time for a not-empty filter.
    each = reviewed.select("document_id", "chunk_id", F.posexplode_outer("changes").alias("ordinal", "c")).filter("ordinal IS NOT NULL")
    return each.select("document_id", "chunk_id", "ordinal", "c.*")


def change_counts(reviewed: DataFrame) -> DataFrame:
    """Changes by type over all chunks."""
    return reviewed.select(F.explode_outer("changes.type").alias("type")).filter("type IS NOT NULL").groupBy("type").agg(F.count("*").alias("n"))


def normalised(changes: DataFrame) -> DataFrame:
    """Change rows with defaults for what is missing: type unknown, confidence 0.8, position 0."""
    fill = {"type": F.lit("unknown"), "original": F.lit(""), "corrected": F.lit(""), "position": F.lit(0), "confidence": F.lit(0.8), "reason": F.lit("")}
    return changes.withColumns({c: F.coalesce(F.col(c), v) if c in changes.columns else v for c, v in fill.items()})


def inline_markup(content: Column, reviewed: Column, changes: Column) -> Column:
    """The original with each change as struck-out and coloured text, from the last position to the first; for under 10 changes.

    Equal positions keep their order. A change that is not found near its position is left out.
    """
    order = F.array_sort(F.transform(changes, lambda c, i: F.struct((-c["position"]).alias("p"), i.alias("i"), c["original"].alias("o"), c["corrected"].alias("n"))))

    def put(text: Column, c: Column) -> Column:
        at = F.call_function("locate", c["o"], text, F.greatest(-c["p"] - 10, F.lit(0)) + 1)
        new = F.concat(F.substr(text, F.lit(1), at - 1), F.lit("~~"), c["o"], F.lit('~~ <span style="color:red">'), c["n"], F.lit("</span>"), F.substr(text, at + F.length(c["o"]), F.length(text)))
        return F.when(at > 0, new).otherwise(text)

    return F.when(content == reviewed, reviewed).otherwise(F.aggregate(order, content, put))


def markup(reviewed: DataFrame) -> DataFrame:
    """reviewed with a column markup: inline for under ten changes, else word by word (see ``differ``), for which this runs jobs.

    Words are compared within their row; only texts beyond ``differ.NEAR`` are paired up for their rounds.
    """
    a, b = F.col("content"), F.col("reviewed_content")
    same, few = F.coalesce(a == b, F.lit(False)), F.coalesce(F.size("changes") < 10, F.lit(False))
    # Whether a text is huge is written too: looking for such rows reads nothing else.
    held = staged(reviewed.withColumn("_huge", ~same & ~few & differ.are_far(a, b)), "reviewed")
    near = ~same & ~few & ~F.col("_huge")
    words = differ.near_markup(F.when(near, a), F.when(near, b))
    out = held.filter(~F.col("_huge")).withColumn("markup", F.when(same, b).when(few, inline_markup(a, b, F.col("changes"))).otherwise(words)).drop("_huge")
    apart = held.filter("_huge").drop("_huge")
    if apart.isEmpty():
        return out
    pairs = differ.distinct_pairs(apart, "content", "reviewed_content", differ.words)
    rounds = differ.word_markup(pairs).withColumnRenamed("key", "_pair")
    return out.unionByName(apart.withColumn("_pair", differ.pair_key(a, b)).join(rounds, "_pair").drop("_pair"))
