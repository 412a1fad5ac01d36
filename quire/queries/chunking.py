"""Queries of the chunking operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.operators import chunking as C
from quire.queries.sql import STRIP
from quire.sources.seed import cte, frame


def _split(spark, d, strategy):
    c = C.split_chunks(frame(spark, d, "seed_chunks"), replace(DEFAULT, chunking_strategy=strategy))
    return c.select("document_id", "chunk_id", F.col("sub_chunk"), F.md5("content").alias("content_md5"), F.length("content").alias("n"))


def chunk_fixed(spark, d):
    return _split(spark, d, "fixed")


def chunk_semantic(spark, d):
    return _split(spark, d, "semantic")


def chunk_segments(spark, d):
    return frame(spark, d, "seed_chunks").select("chunk_id", F.posexplode_outer(C.segments(F.col("content"))).alias("no", "s")).filter("no IS NOT NULL").select("chunk_id", "no", F.md5("s.text").alias("text_md5"), "s.boundary")


def chunk_overlap(spark, d):
    return frame(spark, d, "seed_chunks").select("chunk_id", C.semantic_overlap(F.col("content"), 200).alias("overlap"))


def chunk_ids(spark, d):
    c = frame(spark, d, "seed_chunks")
    return c.select("chunk_id", C.chunk_id(F.col("content"), F.col("page") - 1, F.when(F.col("ord") % 2 == 0, "").otherwise("tbl_1")).alias("new_id"))


QUERIES = {f.__name__: f for f in (chunk_fixed, chunk_semantic, chunk_segments, chunk_overlap, chunk_ids)}

_P = "string_split(content, chr(10) || chr(10))"
_SEG = f"list_transform(list_filter(list_transform({_P}, lambda p: {STRIP('p')}), lambda p: p <> ''), lambda p: {{'text': p, 'boundary': regexp_matches(p, '{C.HEADER}') OR (length(p) < 60 AND NOT contains(p, chr(10)) AND regexp_matches(p, '^\\p{{Lu}}') AND NOT ends_with(p, '.'))}})"


def _over(x: str) -> str:
    s = f"string_split_regex({x}, '[.!?]\\s+')"
    two = f"array_to_string(({s})[-2:], '. ')"
    return f"CASE WHEN length({x}) < 100 THEN '' WHEN len({s}) >= 2 THEN right({two}, 400) ELSE right({x}, 200) END"


_FIXED = f"""list_reduce(list_transform({_P}, lambda p: {{'cur': p, 'out': CAST([] AS VARCHAR[])}}),
 lambda a, s: CASE WHEN length(a.cur) + length(s.cur) > 1500 AND a.cur <> '' THEN {{'cur': right(a.cur, 200) || chr(10) || chr(10) || s.cur, 'out': list_append(a.out, {STRIP('a.cur')})}}
 WHEN a.cur <> '' THEN {{'cur': a.cur || chr(10) || chr(10) || s.cur, 'out': a.out}} ELSE {{'cur': s.cur, 'out': a.out}} END, {{'cur': '', 'out': CAST([] AS VARCHAR[])}})"""
_SEMANTIC = f"""list_reduce(list_transform({_SEG}, lambda s: {{'cur': s.text, 'b': s.boundary, 'out': CAST([] AS VARCHAR[])}}),
 lambda a, s: CASE WHEN a.cur <> '' AND ((s.b AND length(a.cur) >= 500) OR length(a.cur) + length(s.cur) > 2500)
  THEN {{'cur': CASE WHEN {_over('a.cur')} <> '' THEN {_over('a.cur')} || chr(10) || chr(10) || s.cur ELSE s.cur END, 'b': false, 'out': list_append(a.out, {STRIP('a.cur')})}}
 WHEN a.cur <> '' THEN {{'cur': a.cur || chr(10) || chr(10) || s.cur, 'b': false, 'out': a.out}} ELSE {{'cur': s.cur, 'b': false, 'out': a.out}} END, {{'cur': '', 'b': false, 'out': CAST([] AS VARCHAR[])}})"""


def _pieces(fold: str, done: str) -> str:
    return (
        cte("seed_chunks") + f", f AS (SELECT document_id, chunk_id, {fold} AS a FROM seed_chunks WHERE length(content) > 1500), p AS (SELECT document_id, chunk_id, {done} AS out FROM f),"
        " e AS (SELECT document_id, chunk_id, unnest(out) AS content, unnest(range(0, len(out))) AS i FROM p)"
        " SELECT document_id, chunk_id || '_sub_' || i AS chunk_id, CAST(i AS INT) AS sub_chunk, md5(content) AS content_md5, CAST(length(content) AS INT) AS n FROM e"
        " UNION ALL SELECT document_id, chunk_id, CAST(NULL AS INT), md5(content), CAST(length(content) AS INT) FROM seed_chunks WHERE length(content) <= 1500"
    )


_REST = STRIP("a.cur")
ORACLES = {
    "chunk_fixed": _pieces(_FIXED, f"CASE WHEN {_REST} <> '' THEN list_append(a.out, {_REST}) ELSE a.out END"),
    "chunk_semantic": _pieces(_SEMANTIC, f"CASE WHEN {_REST} = '' THEN a.out WHEN length(a.cur) >= 500 OR len(a.out) = 0 THEN list_append(a.out, {_REST}) ELSE list_append(a.out[:-2], a.out[-1] || chr(10) || chr(10) || {_REST}) END"),
    "chunk_segments": cte("seed_chunks") + f", s AS (SELECT chunk_id, {_SEG} AS g FROM seed_chunks), e AS (SELECT chunk_id, unnest(g) AS s, unnest(range(0, len(g))) AS no FROM s) SELECT chunk_id, CAST(no AS INT) AS no, md5(s.text) AS text_md5, s.boundary AS boundary FROM e",
    "chunk_overlap": cte("seed_chunks") + f" SELECT chunk_id, {_over('content')} AS overlap FROM seed_chunks",
    "chunk_ids": cte("seed_chunks") + " SELECT chunk_id, 'chunk_' || (page - 1) || '_' || left(md5(left(content, 100) || (page - 1) || CASE WHEN ord % 2 = 0 THEN '' ELSE 'tbl_1' END), 12) || CASE WHEN ord % 2 = 0 THEN '' ELSE '_tbl_1' END AS new_id FROM seed_chunks",
}
