"""Queries of the state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions.staging import staged
from quire.operators import incremental as I
from quire.operators import state as S
from quire.queries import crossref as XQ
from quire.sources.seed import cte, frame


def _embeddings(spark, d):
    return frame(spark, d, "embeddings").select(F.col("vec_id").alias("embedding_id"), F.concat(F.lit("doc"), F.floor(F.col("vec_id") * 3 % 300 / 100).cast("string")).alias("document_id"), F.concat(F.lit("chunk_"), (F.col("vec_id") * 3 % 300).cast("string")).alias("chunk_id"), (F.col("vec_id") % 7).alias("created_at"))


def review_upsert(spark, d):
    r = frame(spark, d, "seed_reviews").select(*S.KEY, F.col("event_id"), "status", "updated_at")
    out = S.upsert(r.filter("event_id % 2 = 0"), r.filter("event_id % 2 = 1"), list(S.KEY), F.desc("updated_at"), F.desc("event_id"))
    return out.select("chunk_id", "event_id", "status")


def review_latest(spark, d):
    return S.latest_reviews(frame(spark, d, "seed_reviews")).select("chunk_id", "review_id", "status", "confidence")


def review_pending(spark, d):
    return S.pending(frame(spark, d, "seed_chunks"), frame(spark, d, "seed_reviews"))


def document_crossrefs(spark, d):
    return S.document_references(XQ.references(spark, d), frame(spark, d, "seed_chunks")).groupBy("document_id", "reference_type").agg(F.count("*").alias("n"))


def document_records(spark, d):
    return S.document_records(frame(spark, d, "seed_chunks"))


def review_progress(spark, d):
    return S.progress(frame(spark, d, "seed_chunks"), frame(spark, d, "seed_reviews"))


def review_latest_stream(spark, d):
    """The latest reviews, kept by a stream over the events."""
    from quire.functions.staging import shared_dir
    from quire.sources.seed import stream
    from quire.streaming import state as kept

    base = f"{shared_dir(spark)}/reviews-{uuid.uuid4().hex}"
    kept.upsert_into(stream(spark, d, "seed_reviews", "events"), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return kept.read_table(spark, f"{base}/table").select("chunk_id", "review_id", "status", "confidence")


def progress_from_changes(spark, d):
    """Progress after four deliveries of reviews, the last of which takes some back, without reading earlier ones again."""
    chunks, reviews = frame(spark, d, "seed_chunks"), frame(spark, d, "seed_reviews").select("event_id", *I.SUPPORT)
    support = reviews.select(*I.SUPPORT, F.lit(1).cast("long").alias("n")).limit(0)
    progress = I.advanced(I.moved(support, support, chunks).limit(0), I.moved(support, support, chunks))
    part = lambda k: reviews.filter(F.col("event_id") % 3 == k)
    for old, new in ((part(0).limit(0), part(0)), (part(0).limit(0), part(1)), (part(0).limit(0), part(2)), (reviews.filter("event_id % 5 = 0"), part(0).limit(0))):
        delta = staged(I.signed(old, new), "delta")
        known = delta.join(chunks.select(*I.KEY).distinct(), [*I.KEY], "left_semi")
        progress = staged(I.advanced(progress, I.moved(support, known)), "progress")
        support = staged(I.folded(support, known), "support")
    return progress


def embedding_latest(spark, d):
    return S.latest_embeddings(_embeddings(spark, d))


def has_embeddings(spark, d):
    return S.has_embeddings(frame(spark, d, "seed_chunks"), _embeddings(spark, d).filter("embedding_id % 20 < 15"))


def embedding_status(spark, d):
    c = frame(spark, d, "seed_chunks")
    return S.embedding_status(S.document_records(c), c, _embeddings(spark, d).filter("embedding_id % 20 < 15"))


def chunks_without_embedding(spark, d):
    return S.without_embedding(frame(spark, d, "seed_chunks"), _embeddings(spark, d)).select("document_id", "chunk_id")


def chunks_of_document(spark, d):
    c = frame(spark, d, "seed_chunks")
    return S.document_chunks(c, c)


def chunk_insert(spark, d):
    c = frame(spark, d, "seed_chunks").select("chunk_id", "ord")
    return S.insert(c.filter("ord % 2 = 0"), c.filter("ord % 2 = 1"), "chunk_id")


QUERIES = {f.__name__: f for f in (review_upsert, review_latest, review_latest_stream, review_pending, progress_from_changes, document_crossrefs, document_records, review_progress, embedding_latest, has_embeddings, embedding_status, chunks_without_embedding, chunks_of_document, chunk_insert)}
_EMB = ", emb AS (SELECT vec_id AS embedding_id, 'doc' || CAST(floor(vec_id * 3 % 300 / 100) AS BIGINT) AS document_id, 'chunk_' || (vec_id * 3 % 300) AS chunk_id, vec_id % 7 AS created_at FROM embeddings)"
_HAS = "SELECT document_id, max(CASE WHEN e.chunk_id IS NOT NULL THEN 1 ELSE 0 END) = 1 AS has_embeddings FROM seed_chunks c LEFT JOIN (SELECT DISTINCT document_id, chunk_id FROM emb WHERE embedding_id % 20 < 15) e USING (document_id, chunk_id) GROUP BY document_id"
_REC = "SELECT document_id, CAST(max(page_start) AS BIGINT) AS total_pages, count(*) AS total_chunks FROM seed_chunks GROUP BY document_id"
ORACLES = {
    "review_upsert": cte("seed_reviews") + " SELECT chunk_id, event_id, status FROM seed_reviews QUALIFY row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY event_id % 2 DESC, updated_at DESC, event_id DESC) = 1",
    "review_latest": cte("seed_reviews") + " SELECT chunk_id, review_id, status, confidence FROM seed_reviews QUALIFY row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY updated_at DESC, review_id DESC) = 1",
    "review_pending": cte("seed_chunks", "seed_reviews") + " SELECT document_id, c.chunk_id, page_start FROM seed_chunks c LEFT JOIN seed_reviews r USING (document_id, chunk_id) WHERE r.status IS NULL OR r.status = 'pending'",
    "document_crossrefs": XQ._ALL.split(", targets AS")[0] + " SELECT document_id, reference_type, count(*) AS n FROM refs GROUP BY ALL",
    "document_records": cte("seed_chunks") + " " + _REC,
    "review_progress": cte("seed_chunks", "seed_reviews") + ", p AS (SELECT document_id, count(DISTINCT c.chunk_id) AS total, count(DISTINCT c.chunk_id) FILTER (status = 'completed') AS completed, count(DISTINCT c.chunk_id) FILTER (status = 'in_progress') AS in_progress, count(DISTINCT c.chunk_id) FILTER (status = 'needs_review') AS needs_review FROM seed_chunks c LEFT JOIN seed_reviews r USING (document_id, chunk_id) GROUP BY document_id) SELECT *, total - completed - in_progress - needs_review AS pending FROM p",
    "embedding_latest": cte("seed_chunks") + _EMB + " SELECT * FROM emb QUALIFY row_number() OVER (PARTITION BY document_id, chunk_id ORDER BY created_at DESC, embedding_id DESC) = 1",
    "has_embeddings": cte("seed_chunks") + _EMB + " " + _HAS,
    "embedding_status": cte("seed_chunks") + _EMB + f", a AS ({_REC}), b AS ({_HAS}) SELECT a.*, has_embeddings, CASE WHEN has_embeddings THEN 'all-MiniLM-L6-v2' END AS embedding_model FROM a LEFT JOIN b USING (document_id)",
    "chunks_without_embedding": cte("seed_chunks") + _EMB + " SELECT document_id, chunk_id FROM seed_chunks ANTI JOIN emb USING (document_id, chunk_id)",
    "chunks_of_document": cte("seed_chunks") + " SELECT document_id, chunk_id, page_start, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page_start, chunk_id) AS INT) AS place FROM seed_chunks",
    "chunk_insert": cte("seed_chunks") + " SELECT chunk_id, ord FROM seed_chunks",
}
ORACLES["review_latest_stream"] = ORACLES["review_latest"]
ORACLES["progress_from_changes"] = ORACLES["review_progress"].replace("LEFT JOIN seed_reviews r", "LEFT JOIN (SELECT * FROM seed_reviews WHERE event_id % 5 <> 0) r")
