"""The state tables: keyed upserts, latest-by selections, pending work and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.config import DEFAULT


#: A chunk is known by its document and its own id.
KEY = ("document_id", "chunk_id")


def shared_key(*tables: DataFrame) -> list[str]:
    """The columns of KEY that all tables have: single-document tables may leave the document out."""
    return [c for c in KEY if all(c in t.columns for t in tables)]


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The last row of each key by ``order`` (given as descending columns)."""
    rank = F.row_number().over(Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def insert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; a key that is there twice fails the job."""
    both = existing.unionByName(new)
    n = F.count("*").over(Window.partitionBy(key))
    check = F.when(n > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return both.withColumn("_ok", check).filter("_ok").drop("_ok")


def upsert(existing: DataFrame, new: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row per key; new rows replace existing ones, among themselves the last by ``order`` wins."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, F.desc("_new"), *order).drop("_new")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return latest(reviews, shared_key(reviews), F.desc("updated_at"), F.desc("review_id"))


def pending(chunks: DataFrame, reviews: DataFrame) -> DataFrame:
    """chunk_id and page_start of chunks without a review or with a pending one, once per such review."""
    key = shared_key(chunks, reviews)
    j = chunks.join(reviews.select(*key, "status"), key, "left")
    return j.filter(F.col("status").isNull() | (F.col("status") == "pending")).select("document_id", "chunk_id", "page_start").orderBy("page_start", "chunk_id")


def document_references(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """References with their chunk's document."""
    return refs.join(chunks.select(*KEY), shared_key(refs, chunks))


def document_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, chunk_id, page_start and place of the chunks of the given documents (document_id), in page order."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_start", "chunk_id"))
    asked = chunks.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return asked.select(*KEY, "page_start", place.alias("place"))


def document_records(chunks: DataFrame) -> DataFrame:
    """document_id, total_pages, total_chunks."""
    return chunks.groupBy("document_id").agg(F.max("page_start").cast("long").alias("total_pages"), F.count("*").alias("total_chunks"))


def progress(chunks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Distinct chunks by review status; pending is what the other three leave, so a chunk in several states counts in each."""
    key = shared_key(chunks, reviews)
    j = chunks.join(reviews.select(*key, "status"), key, "left")
    by = lambda s: F.count_distinct(F.when(F.col("status") == s, F.col("chunk_id")))
    p = j.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("total"), by("completed").alias("completed"), by("in_progress").alias("in_progress"), by("needs_review").alias("needs_review"))
    return p.withColumn("pending", F.col("total") - F.col("completed") - F.col("in_progress") - F.col("needs_review"))


def latest_embeddings(embeddings: DataFrame) -> DataFrame:
    return latest(embeddings, shared_key(embeddings), F.desc("created_at"), F.desc("embedding_id"))


def has_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """document_id and whether any of its chunks has an embedding."""
    key = shared_key(chunks, embeddings)
    have = embeddings.select(*key).distinct().withColumn("_has", F.lit(True))
    return chunks.join(have, key, "left").groupBy("document_id").agg(F.coalesce(F.bool_or("_has"), F.lit(False)).alias("has_embeddings"))


def embedding_status(records: DataFrame, chunks: DataFrame, embeddings: DataFrame, model: str = DEFAULT.embedding_model) -> DataFrame:
    """Document records with has_embeddings and embedding_model brought up to date."""
    return records.join(has_embeddings(chunks, embeddings), "document_id", "left").withColumn("embedding_model", F.when(F.col("has_embeddings"), F.lit(model)))


def without_embedding(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    key = shared_key(chunks, embeddings)
    return chunks.join(embeddings.select(*key), key, "left_anti")
