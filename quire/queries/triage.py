"""Queries of triage, model replies and severity."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.functions.staging import shared_dir
from quire.operators import journal
from quire.operators import severity as V
from quire.operators import state as S
from quire.operators import triage as T
from quire.sources.seed import cte, frame


def _queue(spark, d):
    latest = S.latest_reviews(frame(spark, d, "seed_reviews"))
    return T.triage(frame(spark, d, "seed_chunks").select("document_id", "chunk_id", "ord", "content"), latest)


def triage(spark, d):
    return _queue(spark, d).select("chunk_id", F.md5("rule_suggestion").alias("suggestion_md5"), "rule_confidence", "lane")


def _api(spark, d):
    q = _queue(spark, d)
    n = F.col("ord")
    return q.select(*S.KEY, F.when(n % 3 == 0, F.col("rule_suggestion")).when(n % 3 == 1, F.lit("other")).otherwise("third").alias("suggestion"), ((60 + n % 41).cast("double") / 100).alias("confidence"), F.when(n % 9 == 0, "rule_fallback").otherwise("api").alias("source"))


def merge_suggestions(spark, d):
    m = T.merge(_api(spark, d), _queue(spark, d).filter("ord % 11 <> 0"))
    return m.select("chunk_id", F.md5("suggestion").alias("suggestion_md5"), F.round("confidence", 6).alias("confidence"), "source")


def needs_human(spark, d):
    return T.needs_human(T.merge(_api(spark, d), _queue(spark, d).filter("ord % 11 <> 0")))


def human_queue(spark, d):
    return T.human_queue(frame(spark, d, "seed_chunks"), S.latest_reviews(frame(spark, d, "seed_reviews")))


def api_batches(spark, d):
    return T.batch_numbers(_queue(spark, d)).groupBy("document_id", "batch").agg(F.count("*").alias("n"))


def api_echo(spark, d):
    """The echo client through the batched caller: every chunk once, its own text at 0.85."""
    return T.call_in_batches(_queue(spark, d), T.echo_client).select("chunk_id", F.md5("suggestion").alias("suggestion_md5"), "confidence", "source")


def llm_prompt(spark, d):
    c = frame(spark, d, "seed_chunks")
    return c.select("chunk_id", F.md5(T.review_prompt(F.col("content"), F.when(F.col("ord") % 2 == 0, F.lit("datasheet")))).alias("prompt_md5"))


def llm_parse(spark, d):
    return frame(spark, d, "seed_llm").select("chunk_id", T.parse_reply(F.col("reply")).alias("p")).select("chunk_id", "p.content", "p.confidence", "p.reasoning", F.array_join(F.transform("p.changes", lambda c: F.concat_ws("|", c["original"], c["corrected"], c["reason"])), ";").alias("changes"))


def llm_gate(spark, d):
    s = frame(spark, d, "seed_llm")
    replies = s.filter("doc_id % 5 <> 0").select(*S.KEY, T.parse_reply(F.col("reply")).alias("p")).select(*S.KEY, "p.*")
    return T.gate(s.select(*S.KEY, "rule_text", "rule_confidence"), replies).drop("document_id")


def _classified(spark, d):
    return V.classify(frame(spark, d, "seed_changes"))


def severity_classify(spark, d):
    return _classified(spark, d).select("ord", "rank", "severity_name")


def severity_filter(spark, d):
    return V.shown(_classified(spark, d)).select("ord", "severity_name")


def severity_statistics(spark, d):
    c = _classified(spark, d)
    out = [V.buckets(c, replace(DEFAULT, verbosity=v), "chunk_id").withColumn("verbosity", F.lit(v)) for v in V.SHOWN]
    return out[0].unionByName(out[1]).unionByName(out[2]).withColumn("signal_to_noise", F.round("signal_to_noise", 6))


def severity_summary(spark, d):
    return V.summary(_classified(spark, d), "chunk_id")


def severity_prioritise(spark, d):
    return V.prioritise(_classified(spark, d), replace(DEFAULT, max_review_items=20), "chunk_id").select("chunk_id", "ord", "severity_name", "place")


def _measure():
    return lambda prompt: str(len(prompt))


def llm_journal(spark, d):
    """Replies of a stand-in that counts characters, asked through a journal that has some of them already."""
    path = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    prompts = frame(spark, d, "seed_chunks").select("chunk_id", "ord", F.col("content").alias("prompt"))
    journal.ask(prompts.filter("ord % 3 = 0"), _measure, path, block=500)
    return journal.ask(prompts, _measure, path, block=500).select("chunk_id", "prompt_hash", "reply")


QUERIES = {f.__name__: f for f in (triage, merge_suggestions, needs_human, human_queue, api_batches, api_echo, llm_prompt, llm_parse, llm_gate, llm_journal, severity_classify, severity_filter, severity_statistics, severity_summary, severity_prioritise)}

_Q = cte("seed_chunks", "seed_reviews") + """, lr AS (SELECT * FROM seed_reviews QUALIFY row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY updated_at DESC, review_id DESC) = 1),
q AS (SELECT c.document_id, c.chunk_id, c.ord, c.content, coalesce(lr.reviewed_content, c.content) AS rule, coalesce(lr.confidence, 0.5) AS rc, CASE WHEN lr.confidence > 0.95 THEN 'auto' WHEN lr.confidence < 0.7 THEN 'high' ELSE 'normal' END AS lane FROM seed_chunks c LEFT JOIN lr USING (document_id, chunk_id)),
api AS (SELECT chunk_id, ord, CASE ord % 3 WHEN 0 THEN rule WHEN 1 THEN 'other' ELSE 'third' END AS s, CAST(60 + ord % 41 AS DOUBLE) / 100 AS a, CASE WHEN ord % 9 = 0 THEN 'rule_fallback' ELSE 'api' END AS src, rule, rc FROM q),
mg AS (SELECT *, CASE WHEN ord % 11 = 0 THEN src WHEN s = rule THEN 'hybrid_agreement' WHEN a > 0.9 THEN 'api_high_confidence' WHEN rc > 0.9 THEN 'rule_high_confidence' WHEN a < 0.8 AND rc < 0.8 THEN 'needs_human' ELSE 'hybrid_moderate' END AS way FROM api),
me AS (SELECT chunk_id, CASE way WHEN 'rule_high_confidence' THEN rule WHEN 'needs_human' THEN NULL ELSE s END AS s, CASE way WHEN 'hybrid_agreement' THEN least(0.98, (a + rc) / 2 * CAST(1.1 AS DOUBLE)) WHEN 'rule_high_confidence' THEN rc WHEN 'needs_human' THEN 0.5 WHEN 'hybrid_moderate' THEN (a + rc) / 2 ELSE a END AS c, way FROM mg)"""
_P1, _P2 = ("'" + x.replace("'", "''") + "'" for x in T.PROMPT)
_PARSE = ", pr AS (SELECT chunk_id, doc_id, rule_text, rule_confidence, reply, json_valid(reply) AS j FROM seed_llm), pp AS (SELECT *, CASE WHEN j THEN coalesce(json_extract_string(reply, '$.corrected_text'), reply) ELSE reply END AS content, CASE WHEN j THEN coalesce(CAST(json_extract_string(reply, '$.confidence') AS DOUBLE), 0.8) ELSE 0.7 END AS confidence, CASE WHEN j THEN json_extract_string(reply, '$.reasoning') END AS reasoning FROM pr)"
_SEV = cte("seed_changes") + """, lo AS (SELECT *, lower(coalesce(type, '')) AS k, lower(coalesce(reason, '')) AS r, coalesce(confidence, 1.0) AS c, coalesce(valid, true) AS ok FROM seed_changes),
cl AS (SELECT *, CASE WHEN k = 'crossref' AND NOT ok THEN 0 WHEN regexp_matches(r, 'unsupported claim|missing evidence|broken reference|section not found') THEN 0 WHEN k = 'llm_suggestion' OR regexp_matches(r, 'missing section|incomplete') THEN 1 WHEN c < 0.8 AND k <> 'grammar' THEN 1
 WHEN regexp_matches(r, 'terminology|inconsistent') OR k = 'style' OR contains(k, 'spelling') THEN 2 WHEN contains(r, 'formatting') AND NOT contains(r, 'space') THEN 3 WHEN k = 'grammar' AND regexp_matches(r, 'double space|whitespace') THEN 4 WHEN regexp_matches(r, 'extra space|spacing') THEN 4 ELSE 3 END AS rank FROM lo)"""
_NAME = "['critical', 'high', 'medium', 'low', 'ignore'][rank + 1]"


def _stat(v: str, most: int) -> str:
    n = [f"count(*) FILTER (rank = {i} AND {i} <= {most})" for i in range(4)]
    sup = f"count(*) FILTER (rank > {most})"
    total = " + ".join([*n, sup])
    return f"SELECT chunk_id, {n[0]} AS critical, {n[1]} AS high, {n[2]} AS medium, {n[3]} AS low, {sup} AS suppressed, {total} AS total_changes, {n[0]} + {n[1]} AS actionable_changes, round(({n[0]} + {n[1]}) / greatest(1, {total}), 6) AS signal_to_noise, '{v}' AS verbosity FROM cl GROUP BY chunk_id"


_NL = "chr(10)"
_NUMBERED = f"'   ' || n || '. ' || coalesce(reason, 'Unknown issue')"
_FULLC = f"{_NUMBERED} || CASE WHEN original <> '' THEN {_NL} || '      Original: \"' || original || '\"' ELSE '' END || CASE WHEN corrected <> '' THEN {_NL} || '      Corrected: \"' || corrected || '\"' ELSE '' END"
_SUMMARY = f""", nb AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, rank ORDER BY ord) AS n FROM cl),
gg AS (SELECT chunk_id, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank > 2) AS sup, string_agg({_FULLC}, {_NL} ORDER BY n) FILTER (rank = 0 AND n <= 10) AS t0, string_agg({_NUMBERED}, {_NL} ORDER BY n) FILTER (rank = 1 AND n <= 5) AS t1, count(*) FILTER (rank = 2 AND contains(reason, 'terminology')) AS terms, count(*) FILTER (rank = 2 AND contains(type, 'style')) AS styles FROM nb GROUP BY chunk_id)
SELECT chunk_id, CASE WHEN n0 > 0 THEN '🔴 Critical Issues (' || n0 || '):' || {_NL} || t0 || CASE WHEN n0 > 10 THEN {_NL} || '   ... and ' || (n0 - 10) || ' more' ELSE '' END || {_NL} || {_NL} ELSE '' END || CASE WHEN n1 > 0 THEN '🟠 High Priority (' || n1 || '):' || {_NL} || t1 || CASE WHEN n1 > 5 THEN {_NL} || '   ... and ' || (n1 - 5) || ' more' ELSE '' END || {_NL} || {_NL} ELSE '' END
 || CASE WHEN n2 > 0 THEN '🟡 Medium Priority (' || n2 || '):' || {_NL} || '   - ' || terms || ' terminology inconsistencies' || {_NL} || '   - ' || styles || ' style suggestions' || {_NL} || {_NL} ELSE '' END || CASE WHEN sup > 0 THEN '⚪ Suppressed: ' || sup || ' low-value changes (run with --verbose to see)' || {_NL} || {_NL} ELSE '' END || CASE WHEN n0 + n1 + n2 > 0 THEN '📊 Actionable Items: ' || (n0 + n1 + n2) ELSE '✅ No significant issues found!' END AS summary, n0 + n1 + n2 AS actionable FROM gg"""
ORACLES = {
    "triage": _Q + " SELECT chunk_id, md5(rule) AS suggestion_md5, rc AS rule_confidence, lane FROM q",
    "merge_suggestions": _Q + " SELECT chunk_id, md5(s) AS suggestion_md5, round(c, 6) AS confidence, way AS source FROM me",
    "needs_human": _Q + " SELECT count(*) FILTER (c < 0.9) AS needs_human, count(*) AS total FROM me",
    "human_queue": _Q + " SELECT document_id, c.chunk_id, section_hierarchy AS section, page_start AS page, confidence, left(content, 200) AS original, left(nullif(reviewed_content, ''), 200) AS suggestion, n_changes AS changes_count, CASE WHEN confidence < 0.6 THEN 'high' WHEN n_changes > 10 THEN 'medium' WHEN page_start < 50 THEN 'medium' ELSE 'low' END AS priority FROM seed_chunks c JOIN lr USING (document_id, chunk_id) WHERE confidence < 0.9",
    "api_batches": _Q + ", n AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS n FROM q) SELECT document_id, CAST(floor((n - 1) / 10) AS BIGINT) AS batch, count(*) AS n FROM n GROUP BY ALL",
    "api_echo": _Q + " SELECT chunk_id, md5(content) AS suggestion_md5, CAST(0.85 AS DOUBLE) AS confidence, 'api' AS source FROM q",
    "llm_prompt": cte("seed_chunks") + f" SELECT chunk_id, md5({_P1} || content || {_NL} || CASE WHEN ord % 2 = 0 THEN {_NL} || 'Context:' || {_NL} || 'datasheet' || {_NL} ELSE '' END || {_P2}) AS prompt_md5 FROM seed_chunks",
    "llm_parse": cte("seed_llm") + _PARSE + " SELECT chunk_id, content, confidence, reasoning, CASE WHEN doc_id % 4 = 0 THEN 'a|b ' || doc_id || '|why;|plain|LLM suggestion' ELSE '' END AS changes FROM pp",
    "llm_gate": cte("seed_llm") + _PARSE + ", g AS (SELECT *, rule_confidence < 0.95 AND doc_id % 5 <> 0 AND confidence > rule_confidence + CAST(0.05 AS DOUBLE) AS ok FROM pp) SELECT chunk_id, rule_text, rule_confidence, rule_confidence < 0.95 AS asked, ok AS accepted, CASE WHEN ok THEN content ELSE rule_text END AS final_text, CASE WHEN ok THEN confidence ELSE rule_confidence END AS confidence FROM g",
    "severity_classify": _SEV + f" SELECT ord, rank, {_NAME} AS severity_name FROM cl",
    "severity_filter": _SEV + f" SELECT ord, {_NAME} AS severity_name FROM cl WHERE rank <= 2",
    "severity_statistics": _SEV + " " + " UNION ALL ".join(_stat(v, m) for v, m in V.SHOWN.items()),
    "severity_summary": _SEV + _SUMMARY,
    "severity_prioritise": _SEV + f", pl AS (SELECT chunk_id, ord, rank, {_NAME} AS severity_name, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY rank, ord) AS INT) AS place FROM cl WHERE rank <= 2) SELECT chunk_id, ord, severity_name, place FROM pl WHERE rank = 0 OR place <= 20",
}
ORACLES["llm_journal"] = cte("seed_chunks") + " SELECT chunk_id, sha256(content) AS prompt_hash, CAST(length(content) AS VARCHAR) AS reply FROM seed_chunks"
