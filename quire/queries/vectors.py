"""Queries of embeddings, search and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import cosine
from quire.operators import vectors as V
from quire.queries import language as LQ
from quire.sources.seed import cte, frame

#: The issue types that queries ask for, by their number.
ISSUE_TYPES = ["crossref", "grammar", "spelling", "style", "llm_suggestion", "table_issue", "figure_issue"]


def vectors(spark, d):
    """Neighbour-blended vectors, so that some pairs are similar."""
    e = frame(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    n = e.agg(F.max("vec_id") + 1).alias("m")
    nxt = e.select(F.col("vec_id").alias("next_id"), F.col("a").alias("b"))
    j = e.join(n).withColumn("next_id", (F.col("vec_id") + 1) % F.col("(max(vec_id) + 1)")).join(nxt, "next_id")
    even = F.col("vec_id") % 2 == 0
    blend = F.zip_with("a", "b", lambda x, y: F.when(even, 0.9).otherwise(0.5) * x + F.when(even, 0.4).otherwise(0.9) * y)
    return j.select("vec_id", "label", "a", blend.alias("e"))


def cosine_pairs(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", F.round(cosine(F.col("a"), F.col("e")), 6).alias("similarity"))


def _found(spark, d, **kw):
    v = vectors(spark, d)
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("a").alias("q"), "label")
    index = v.select("vec_id", "e", "label")
    return V.search(index, q if kw.get("same") else q.drop("label"), **kw)


def vector_topk(spark, d):
    return _found(spark, d, k=5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def vector_topk_filtered(spark, d):
    return _found(spark, d, k=5, same="label").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def similar_chunks(spark, d):
    return _found(spark, d, k=4, skip_self=True).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


def align_argmax(spark, d):
    v = vectors(spark, d)
    doc = F.concat(F.lit("d"), (F.col("vec_id") / 50).cast("long").cast("string")).alias("document_id")
    out = V.align(v.select(doc, F.col("vec_id").alias("id1"), F.col("a").alias("e1")), v.select(doc, F.col("vec_id").alias("id2"), F.col("e").alias("e2")))
    return out.select("document_id", "id1", "id2", F.round("similarity", 6).alias("similarity"))


def collection_stats(spark, d):
    return V.collection_stats(vectors(spark, d).select(F.concat(F.lit("doc_"), F.col("label").cast("string")).alias("document_id")))


def pattern_upsert(spark, d):
    return V.patterns(frame(spark, d, "seed_changes"))


def _library(spark, d):
    """Patterns with vec_id, their place by pattern_id: counted within buckets of its first digits and moved on by the buckets before."""
    p = V.patterns(frame(spark, d, "seed_changes")).withColumn("bucket", F.substring("pattern_id", 1, 3))
    sizes = p.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("pattern_id")) + F.col("start")
    return p.join(F.broadcast(starts), "bucket").select(place.cast("long").alias("vec_id"), "pattern_id", "corrected_text", "issue_type", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), "frequency")


def _near_patterns(spark, d, library, by_type=False):
    """The three nearest of the library's patterns for each query, of the query's issue type if asked for.

    A pattern has the vector of its number; with types that of twenty times its number, which some queries lie near.
    """
    v = vectors(spark, d)
    kind = F.get(F.array(*[F.lit(x) for x in ISSUE_TYPES]), (F.col("vec_id") % len(ISSUE_TYPES)).cast("int"))
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), *([kind.alias("issue_type")] if by_type else []))
    own = library.select(F.col("vec_id").alias("pattern"), "issue_type", (F.col("vec_id") * (20 if by_type else 1)).alias("number"))
    if by_type:
        own = own.join(F.broadcast(v.agg((F.max("vec_id") + 1).alias("total")))).withColumn("number", F.col("number") % F.col("total"))
    index = v.join(own, F.col("vec_id") == F.col("number")).select(F.col("pattern").alias("vec_id"), F.col("a").alias("e"), "issue_type")
    return V.search(index if by_type else index.drop("issue_type"), q, k=3, same="issue_type" if by_type else None)


def _similar(near, library):
    return near.join(library, "vec_id").select("query_id", "rank", "pattern_id", "frequency", F.round("similarity", 6).alias("similarity"))


def _suggested(near, library):
    out = V.suggest(near, library, 0.1)
    return out.select("query_id", "suggestion", F.round("confidence", 6).alias("confidence"), "issue_type", F.round("similarity", 6).alias("similarity"))


def _context(near):
    out = V.review_context(near, 0.1)
    return out.select("query_id", F.array_join(F.col("patterns").cast("array<string>"), ",").alias("patterns"), "has_suggestion", F.round("confidence_boost", 6).alias("confidence_boost"))


def pattern_similar(spark, d):
    """The nearest patterns of the query's issue type."""
    library = _library(spark, d)
    return _similar(_near_patterns(spark, d, library, True), library)


def pattern_suggest(spark, d):
    library = _library(spark, d)
    return _suggested(_near_patterns(spark, d, library, True), library)


def review_context(spark, d):
    return _context(_near_patterns(spark, d, _library(spark, d), True))


def library_similar(spark, d):
    """The nearest patterns of any type."""
    library = _library(spark, d)
    return _similar(_near_patterns(spark, d, library), library)


def library_suggest(spark, d):
    library = _library(spark, d)
    return _suggested(_near_patterns(spark, d, library), library)


def library_context(spark, d):
    return _context(_near_patterns(spark, d, _library(spark, d)))


def pattern_stats(spark, d):
    return V.patterns(frame(spark, d, "seed_changes")).groupBy("issue_type").agg(F.count("*").alias("n"), F.sum("frequency").alias("uses"))


def embedding_uncached(spark, d):
    c = frame(spark, d, "seed_chunks")
    cache = c.filter("ord % 3 = 0").select(F.md5("content").alias("text_hash"))
    return V.uncached(c, cache).select("chunk_id", "text_hash")


def embedding_models(spark, d):
    use = F.when(F.col("n_nationkey") % 3 == 0, "quality").when(F.col("n_nationkey") % 3 == 1, "multilingual").otherwise("other")
    return V.model_info(frame(spark, d, "nation").select("n_nationkey"), use)


def embedding_encode(spark, d):
    """A deterministic stand-in encoder: characters and blanks."""
    return V.encode(frame(spark, d, "seed_chunks"), _stand_in).select("chunk_id", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_blanks"))


def _stand_in():
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


def vector_add(spark, d):
    c = frame(spark, d, "seed_chunks")
    have = c.filter("ord % 3 = 0").select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    return V.add_chunks(have, c, _stand_in).select("chunk_id", F.get("embedding", F.lit(0)).alias("n_chars"), F.get("embedding", F.lit(1)).alias("n_blanks"))


def pattern_learn(spark, d):
    """Patterns from the changes of reviewed chunks."""
    from quire.operators import language

    r = language.review(frame(spark, d, "seed_chunks")).withColumn("updated_at", F.col("ord"))
    return V.patterns(V.review_changes(r)).select("pattern_id", "original_text", "corrected_text", "frequency", F.col("created_at").alias("first_seen"), "last_seen")


QUERIES = {f.__name__: f for f in (cosine_pairs, vector_topk, vector_topk_filtered, similar_chunks, align_argmax, collection_stats, pattern_upsert, pattern_similar, pattern_suggest, review_context, library_similar, library_suggest, library_context, pattern_stats, embedding_uncached, embedding_models, embedding_encode, vector_add, pattern_learn)}

_V = "v0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), v AS (SELECT x.vec_id, x.label, x.a, list_transform(list_zip(x.a, y.a), lambda z: CASE WHEN x.vec_id % 2 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE * z[1] + CASE WHEN x.vec_id % 2 = 0 THEN 0.4 ELSE 0.9 END::DOUBLE * z[2]) AS e FROM v0 x JOIN v0 y ON y.vec_id = (x.vec_id + 1) % (SELECT max(vec_id) + 1 FROM v0))"
_COS = "list_cosine_similarity({}, {})".format


def _top(k: int, join: str, e: str = "e", q: str = "a") -> str:
    return f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, i.vec_id, 1 - pow(list_distance(i.{e}, q.{q}), 2) AS s FROM v i JOIN v q ON q.vec_id % 20 = 0 AND {join}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= {k})"


_PAT = "pat AS (SELECT left(md5(original || '_' || corrected), 16) AS pattern_id, original AS original_text, corrected AS corrected_text, coalesce(arg_min_null(type, {ts: ts, o: ord}), 'unknown') AS issue_type, arg_min_null(confidence, {ts: ts, o: ord}) AS confidence, count(*) AS frequency, min(ts) AS created_at, max(ts) AS last_seen FROM seed_changes WHERE original <> '' AND corrected <> '' AND original <> corrected GROUP BY ALL), lib AS (SELECT *, row_number() OVER (ORDER BY pattern_id) AS vec_id FROM pat)"
_C = cte("seed_changes") + ", "
_KIND = "[" + ", ".join(f"'{x}'" for x in ISSUE_TYPES) + f"][q.vec_id % {len(ISSUE_TYPES)} + 1]"
_NEAR = _C + _PAT + ", " + _top(3, "i.vec_id IN (SELECT vec_id FROM lib)", "a", "e").removeprefix("WITH ")
_TYPED = _C + _PAT + f", {_V}, s AS (SELECT q.vec_id AS query_id, lib.vec_id, 1 - pow(list_distance(i.a, q.e), 2) AS s FROM lib JOIN v i ON i.vec_id = lib.vec_id * 20 % (SELECT max(vec_id) + 1 FROM v0) JOIN v q ON q.vec_id % 20 = 0 AND lib.issue_type = {_KIND}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= 3)"
_SIMILAR = " SELECT query_id, rank, pattern_id, frequency, round(s, 6) AS similarity FROM top JOIN lib USING (vec_id)"
_SUGGEST = " SELECT query_id, corrected_text AS suggestion, round(coalesce(confidence, 0.8) * s, 6) AS confidence, issue_type, round(s, 6) AS similarity FROM top JOIN lib USING (vec_id) WHERE rank = 1 AND s >= 0.1"
_CONTEXT = " SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) FILTER (rank <= 2) AS patterns, max(s) >= 0.1 AS has_suggestion, round(count(*) * 0.05::DOUBLE, 6) AS confidence_boost FROM top GROUP BY query_id"
_ENCODED = "CAST(length(content) AS DOUBLE) AS n_chars, CAST(length(content) - length(replace(content, ' ', '')) AS DOUBLE) AS n_blanks"
ORACLES = {
    "cosine_pairs": f"WITH {_V} SELECT vec_id, round({_COS('a', 'e')}, 6) AS similarity FROM v",
    "vector_topk": _top(5, "true") + " SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM top",
    "vector_topk_filtered": _top(5, "i.label = q.label") + " SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM top",
    "similar_chunks": _top(4, "i.vec_id <> q.vec_id") + " SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM top",
    "align_argmax": f"WITH {_V}, s AS (SELECT 'd' || (x.vec_id // 50) AS document_id, x.vec_id AS id1, y.vec_id AS id2, {_COS('x.a', 'y.e')} AS s FROM v x JOIN v y ON x.vec_id // 50 = y.vec_id // 50), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id1 ORDER BY s DESC, id2) = 1) SELECT document_id, id1, id2, round(s, 6) AS similarity FROM b WHERE s >= 0.7",
    "collection_stats": "SELECT 'doc_' || label AS document_id, count(*) AS n_vectors FROM embeddings GROUP BY label",
    "pattern_upsert": _C + _PAT + " SELECT * FROM pat",
    "pattern_similar": _TYPED + _SIMILAR,
    "pattern_suggest": _TYPED + _SUGGEST,
    "review_context": _TYPED + _CONTEXT,
    "library_similar": _NEAR + _SIMILAR,
    "library_suggest": _NEAR + _SUGGEST,
    "library_context": _NEAR + _CONTEXT,
    "embedding_encode": cte("seed_chunks") + f" SELECT chunk_id, {_ENCODED} FROM seed_chunks",
    "vector_add": cte("seed_chunks") + f" SELECT chunk_id, {_ENCODED} FROM seed_chunks WHERE ord % 3 <> 0 UNION ALL SELECT chunk_id, 1, 2 FROM seed_chunks WHERE ord % 3 = 0",
    "pattern_learn": LQ._FULL + f", ch AS (SELECT chunk_id, original, corrected FROM sc UNION ALL SELECT chunk_id, m.t, {LQ._CORRECTED} FROM oc) SELECT left(md5(original || '_' || corrected), 16) AS pattern_id, original AS original_text, corrected AS corrected_text, count(*) AS frequency, min(ord) AS first_seen, max(ord) AS last_seen FROM ch JOIN seed_chunks USING (chunk_id) WHERE original <> corrected GROUP BY ALL",
    "pattern_stats": _C + _PAT + " SELECT issue_type, count(*) AS n, CAST(sum(frequency) AS BIGINT) AS uses FROM pat GROUP BY issue_type",
    "embedding_uncached": cte("seed_chunks") + " SELECT chunk_id, md5(content) AS text_hash FROM seed_chunks WHERE md5(content) NOT IN (SELECT md5(content) FROM seed_chunks WHERE ord % 3 = 0)",
    "embedding_models": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'all-mpnet-base-v2' WHEN 1 THEN 'paraphrase-multilingual-mpnet-base-v2' ELSE 'all-MiniLM-L6-v2' END AS model, CASE WHEN n_nationkey % 3 < 2 THEN 768 ELSE 384 END AS dimension FROM nation",
}
