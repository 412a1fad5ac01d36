"""Deterministic inputs for the review operators, derived from the driver's tables.

The corpus has none of the patterns that the review rules look for, so each projection writes some in. Every statement is
plain SQL that Spark and DuckDB read alike; ``frame`` runs it on Spark, ``cte`` hands it to an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"
_S = "CAST({} AS STRING)".format
#: A hundred chunks, counted by a number column, make a document.
_DOC = "'doc' || CAST(CAST(floor({} / 100) AS BIGINT) AS STRING)".format


def _chunks(modulus: int, where: str) -> str:
    sec = f"{_S(f'doc_id % {modulus} + 1')} || '.' || {_S('doc_id % 5')} || ' Overview'"
    t = f"replace(replace(replace(coalesce(text, ''), ' the ', ' teh '), 'The ', 'Teh '), {_NL}, {_NL} || {_NL})"
    body = f"CASE WHEN doc_id % 4 = 0 THEN replace(t, ', ', ',  ') WHEN doc_id % 4 = 1 THEN replace(replace(t, '. ', '.'), ' and ', ' ADN ') WHEN doc_id % 4 = 2 THEN replace(replace(t, ', ', ',   '), ' and ', ' adn ') ELSE t END"
    tail = (
        f"'See Section ' || {_S('doc_id % 9 + 1')} || '.' || {_S('doc_id % 6')} || ', Figure ' || {_S('doc_id % 12 + 1')} || '-' || {_S('doc_id % 4 + 1')} || ' and Table ' || {_S('doc_id % 15 + 1')}"
        f" || '. Also section ' || {_S('doc_id % 11 + 1')} || ', Fig. ' || {_S('doc_id % 8 + 1')} || ', TABLE ' || {_S('doc_id % 3 + 1')} || '-' || {_S('doc_id % 2 + 1')} || ' and Eq. 1-' || {_S('doc_id % 3')}"
        f" || '. Range ' || {_S(f'doc_id % {modulus}')} || ' - ' || {_S('doc_id % 10 + 5')} || '.'"
    )
    return (
        f"SELECT document_id, chunk_id, ord, page, page AS page_start, page AS page_end, section AS section_hierarchy, 'text' AS chunk_type, section || {_NL} || {_NL} || {body} || {_NL} || {_NL} || {tail} AS content "
        f"FROM (SELECT {_DOC('doc_id')} AS document_id, 'chunk_' || {_S('doc_id')} AS chunk_id, doc_id, doc_id AS ord, CAST(floor(doc_id / 20) AS INT) + 1 AS page, {sec} AS section, {t} AS t FROM documents WHERE {where}) x"
    )


_EVENT = "event_type"
#: SQL of each projection over the driver's tables and the projections before it.
SEEDS: dict[str, str] = {
    "seed_chunks": _chunks(7, "doc_id IS NOT NULL"),
    "seed_v1": _chunks(7, "doc_id % 10 <> 1"),
    "seed_v2": _chunks(8, "doc_id % 10 <> 0"),
    "seed_pages": f"SELECT {_DOC('doc_id')} AS document_id, CAST(floor(doc_id / 20) AS INT) + 1 AS page, doc_id AS ord, CASE WHEN doc_id % 13 = 0 THEN '  ' || {_NL} ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id IS NOT NULL",
    "seed_toc": f"SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 5 = 4 THEN n_name WHEN n_nationkey % 5 = 3 THEN '  ' || {_S('n_nationkey % 9 + 1')} || '.0 ' || n_name WHEN n_nationkey % 5 = 2 THEN {_S('n_nationkey % 9 + 1')} || ' ' || n_name ELSE {_S('n_nationkey % 9 + 1')} || '.' || {_S('n_nationkey % 4')} || ' ' || n_name END AS title, n_regionkey AS level FROM nation",
    "seed_outline": "SELECT DISTINCT document_id, section_hierarchy AS title, 1 AS level FROM seed_chunks",
    "seed_figures": f"SELECT {_DOC('s_suppkey * 10')} AS document_id, CAST(s_suppkey AS INT) AS page, CAST(s_suppkey % 9 AS INT) AS image_index, 'png' AS image_format, CAST(floor(s_acctbal * 5) AS BIGINT) AS image_size, CAST(s_suppkey AS INT) AS xref, CASE WHEN s_suppkey % 3 = 0 THEN 'Intro. Figure ' || {_S('s_suppkey % 9 + 1')} || ': View of ' || s_name || {_NL} || 'more' WHEN s_suppkey % 3 = 1 THEN 'See fig. ' || {_S('s_suppkey % 9 + 1')} || '  Map ' || s_name ELSE 'no caption here' END AS page_text FROM supplier",
    "seed_cells": "SELECT p_brand, 'doc' || CAST(CAST(substr(p_brand, 7) AS INT) % 10 AS STRING) AS document_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS row_no, p_partkey, p_name, p_type, p_size FROM part",
    "seed_reviews": f"SELECT 'rev_' || {_S('event_id')} AS review_id, event_id, {_DOC('user_id')} AS document_id, 'chunk_' || {_S('user_id')} AS chunk_id, CASE WHEN event_id % 4 = 0 THEN 'pending' WHEN event_id % 4 = 1 THEN 'completed' WHEN event_id % 4 = 2 THEN 'in_progress' ELSE 'needs_review' END AS status, CAST(50 + event_id % 51 AS DOUBLE) / 100 AS confidence, CAST(event_id % 14 AS INT) AS n_changes, 'reviewed text ' || {_S('event_id % 97')} AS reviewed_content, ts AS updated_at FROM events",
    "seed_changes": f"SELECT event_id AS ord, {_DOC('user_id')} AS document_id, 'chunk_' || {_S('user_id')} AS chunk_id, CASE WHEN event_id % 7 = 0 THEN 'crossref' WHEN event_id % 7 = 1 THEN 'grammar' WHEN event_id % 7 = 2 THEN 'spelling' WHEN event_id % 7 = 3 THEN 'style' WHEN event_id % 7 = 4 THEN 'llm_suggestion' WHEN event_id % 7 = 5 THEN 'table_issue' ELSE 'figure_issue' END AS type, CASE WHEN event_id % 11 = 0 THEN 'Double space removed' WHEN event_id % 11 = 1 THEN 'Inconsistent terminology' WHEN event_id % 11 = 2 THEN 'Unsupported claim' WHEN event_id % 11 = 3 THEN 'Missing section' WHEN event_id % 11 = 4 THEN 'Formatting of list' WHEN event_id % 11 = 5 THEN 'Odd spacing' WHEN event_id % 11 = 6 THEN 'Broken reference' WHEN event_id % 11 = 7 THEN 'Missing space after punctuation' WHEN event_id % 11 = 8 THEN 'Formatting space' ELSE CAST(NULL AS STRING) END AS reason, CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(60 + event_id % 40 AS DOUBLE) / 100 END AS confidence, CASE WHEN event_id % 3 = 0 THEN false WHEN event_id % 3 = 1 THEN true END AS valid, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'old ' || {_S('event_id % 23')} END AS original, CASE WHEN event_id % 9 = 0 THEN 'old ' || {_S('event_id % 23')} ELSE 'new ' || {_S('event_id % 23')} END AS corrected, CASE WHEN event_id % 3 = 0 THEN 'high' WHEN event_id % 3 = 1 THEN 'medium' ELSE 'low' END AS severity, ts FROM events",
    "seed_llm": f"SELECT doc_id, {_DOC('doc_id')} AS document_id, 'chunk_' || {_S('doc_id')} AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN '{{\"corrected_text\": \"fixed ' || {_S('doc_id')} || '\", \"confidence\": 0.9' || {_S('doc_id % 10')} || ', \"reasoning\": \"r\", \"changes\": [{{{{\"original\": \"a\", \"corrected\": \"b ' || {_S('doc_id')} || '\", \"reason\": \"why\"}}}}, \"plain\"]}}' WHEN doc_id % 4 = 1 THEN '{{\"corrected_text\": \"only ' || {_S('doc_id')} || '\"}}' WHEN doc_id % 4 = 2 THEN 'plain reply ' || {_S('doc_id')} ELSE '{{\"confidence\": 0.5}}' END AS reply, CAST(60 + doc_id % 41 AS DOUBLE) / 100 AS rule_confidence, 'rule text ' || {_S('doc_id % 50')} AS rule_text FROM documents WHERE doc_id IS NOT NULL",
    "seed_sse": f"SELECT doc_id, 'data: {{\"choices\":[{{\"delta\":{{\"content\":\"part ' || {_S('doc_id')} || '\"}}}}]}}' || {_NL} || CASE WHEN doc_id % 3 = 0 THEN 'data: {{broken' WHEN doc_id % 3 = 1 THEN ': comment' ELSE '' END || {_NL} || 'data: {{\"choices\":[{{\"delta\":{{\"content\":\" and more\"}}}}]}}' || {_NL} || CASE WHEN doc_id % 2 = 0 THEN 'data: [DONE]' || {_NL} ELSE '' END || 'data: {{\"choices\":[{{\"delta\":{{\"content\":\" tail\"}}}}]}}' AS body FROM documents WHERE doc_id IS NOT NULL",
}
SEEDS = {k: v.replace("{{", "{").replace("}}", "}") for k, v in SEEDS.items()}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection, or a driver table, as a DataFrame."""
    if name not in SEEDS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {t: frame(spark, sf_dir, t) for t in re.findall(r"\bFROM (\w+)", SEEDS[name])}
    sql = SEEDS[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\bFROM (\w+)", r"FROM {\1}", sql), **tables)


def stream(spark: SparkSession, sf_dir: str, name: str, table: str) -> DataFrame:
    """A projection of one driver table as a stream."""
    rows = spark.readStream.schema(frame(spark, sf_dir, table).schema).parquet(f"{sf_dir}/{table}.parque[t]")
    return spark.sql(re.sub(r"\bFROM (\w+)", r"FROM {\1}", SEEDS[name]), **{table: rows})


def cte(*names: str) -> str:
    """The projections as leading common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({SEEDS[n]})" for n in names)
