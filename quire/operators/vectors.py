"""Embeddings: encoding, similarity, top-k search and the pattern library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT
from quire.functions.text import cosine
from quire.operators import metric

#: Encoder names and dimensions by purpose.
MODELS = {"default": ("all-MiniLM-L6-v2", 384), "quality": ("all-mpnet-base-v2", 768), "multilingual": ("paraphrase-multilingual-mpnet-base-v2", 768)}


def encode(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """chunks (chunk_id, content) with their embedding; ``encoder()`` makes the model once in a task, which then takes batches."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            texts, out = frame["content"].fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                out += model(texts[i : i + batch])
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "embedding": out})

    return chunks.select("chunk_id", "content").mapInPandas(each, "chunk_id string, embedding array<double>")


def uncached(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose text is not in the cache (text_hash) of an earlier run."""
    return chunks.withColumn("text_hash", F.md5("content")).join(cache.select("text_hash"), "text_hash", "left_anti")


def model_info(rows: DataFrame, use: Column) -> DataFrame:
    """rows with the recommended model's name and dimension for a use; unknown uses take the default."""
    name, dim = (F.create_map(*[F.lit(x) for k, v in MODELS.items() for x in (k, v[i])]) for i in (0, 1))
    key = F.when(use.isin(*MODELS), use).otherwise("default")
    return rows.withColumns({"model": name[key], "dimension": dim[key]})


def search(index: DataFrame, queries: DataFrame, k: int = 5, same: str | None = None, skip_self: bool = False) -> DataFrame:
    """query_id, vec_id, similarity (1 - squared distance), rank: the ``k`` nearest vectors of every query, exactly.

    index: vec_id, e; queries: query_id, q. ``same`` names a column that both sides must share. Vectors are searched through a
    metric index (see ``metric``): cells that cannot hold a nearer vector are left out, and no plan grows with the queries.
    """
    built = metric.build(index, same)
    kind = lambda df, c: df.select(c).dtypes[0][1]
    found = metric.search(built, queries, k, same, skip_self) if built else metric.empty(index.sparkSession, kind(queries, "query_id"), kind(index, "vec_id"))
    return found.select("query_id", "vec_id", (F.lit(1.0) - F.col("square")).alias("similarity"), "rank")


def add_chunks(collection: DataFrame, chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """The collection (chunk_id, embedding) with the chunks (chunk_id, content) that it lacks, encoded; those that it has are not encoded again."""
    return collection.unionByName(encode(chunks.join(collection.select("chunk_id"), "chunk_id", "left_anti"), encoder, batch))


def collection_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("document_id").agg(F.count("*").alias("n_vectors"))


def align(left: DataFrame, right: DataFrame, threshold: float = DEFAULT.align_threshold) -> DataFrame:
    """document_id, id1, id2, similarity: each left vector's best right one of its document by cosine (ties: smallest id2), if at least ``threshold``.

    left: document_id, id1, e1; right: document_id, id2, e2. One right vector may serve several left ones. A document's
    sections are compared pair by pair, and only the best of each is kept as pairs arise.
    """
    pairs = left.join(right, "document_id").select("document_id", "id1", "id2", cosine(F.col("e1"), F.col("e2")).alias("similarity"))
    best = pairs.groupBy("document_id", "id1").agg(F.max(F.struct("similarity", (-F.col("id2")).alias("minus"), "id2")).alias("b"))
    return best.select("document_id", "id1", "b.id2", "b.similarity").filter(F.col("similarity") >= threshold)


def patterns(changes: DataFrame) -> DataFrame:
    """The pattern library from changes (original, corrected, type, confidence, ts): one row per pair, with its frequency."""
    usable = changes.filter("coalesce(original, '') <> '' AND coalesce(corrected, '') <> '' AND original <> corrected")
    key = F.substring(F.md5(F.concat("original", F.lit("_"), "corrected")), 1, 16)
    first = lambda c: F.min(F.struct("ts", "ord", c))[c]
    return usable.groupBy(key.alias("pattern_id"), F.col("original").alias("original_text"), F.col("corrected").alias("corrected_text")).agg(
        F.coalesce(first("type"), F.lit("unknown")).alias("issue_type"), first("confidence").alias("confidence"), F.count("*").alias("frequency"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"),
    )


def review_changes(reviews: DataFrame) -> DataFrame:
    """original, corrected, type, confidence, ts and ord of every change in reviews (changes, confidence, updated_at, ord), for ``patterns``.

    A pattern has the confidence of the review that it comes from.
    """
    each = reviews.select("confidence", F.col("updated_at").alias("ts"), F.col("ord").alias("of"), F.posexplode_outer("changes").alias("n", "c")).filter("n IS NOT NULL")
    return each.select("c.original", "c.corrected", "c.type", "confidence", "ts", F.struct("of", "n").alias("ord"))


def suggest(similar: DataFrame, library: DataFrame, threshold: float = DEFAULT.suggest_threshold) -> DataFrame:
    """query_id, suggestion, confidence, issue_type: the best pattern of each query (search result joined on vec_id), if similar enough."""
    best = similar.filter("rank = 1").filter(F.col("similarity") >= threshold)
    return best.join(library, "vec_id").select("query_id", F.col("corrected_text").alias("suggestion"), (F.col("confidence") * F.col("similarity")).alias("confidence"), "issue_type", "similarity")


def review_context(similar: DataFrame, threshold: float = DEFAULT.suggest_threshold) -> DataFrame:
    """query_id, patterns (two nearest of three), has_suggestion, confidence_boost (0.05 for each of the three found)."""
    top = similar.filter("rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("p"), F.max("similarity").alias("best"))
    return top.select("query_id", F.slice("p", 1, 2)["vec_id"].alias("patterns"), (F.col("best") >= threshold).alias("has_suggestion"), (F.size("p") * F.lit(0.05)).alias("confidence_boost"))
