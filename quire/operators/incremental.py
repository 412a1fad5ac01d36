"""Progress kept up to date from changes, without reading the reviews again.

A change is a signed row: a review comes (+1) or goes (-1) with a status. Support holds how many reviews give a chunk a status;
only where it rises from nothing, or falls to it, does a document's count move. New counts are old counts plus what moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.state import KEY

SUPPORT = [*KEY, "status"]
#: Statuses that have a count of their own.
COUNTED = ("completed", "in_progress", "needs_review")
COUNTS = ["total", *COUNTED]


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, chunk_id, status, n of reviews that went (``old``) and came (``new``)."""
    each = lambda df, n: df.select(*SUPPORT, F.lit(n).cast("long").alias("n"))
    return each(old, -1).unionByName(each(new, 1))


def netted(changes: DataFrame) -> DataFrame:
    """One row for each chunk and status that the changes touch and do not leave as it was."""
    return changes.filter("chunk_id IS NOT NULL AND status IS NOT NULL").groupBy(*SUPPORT).agg(F.sum("n").alias("n")).filter("n <> 0")


def folded(support: DataFrame, changes: DataFrame) -> DataFrame:
    """The support after ``changes``."""
    return netted(support.select(*SUPPORT, "n").unionByName(changes.select(*SUPPORT, "n")))


def moved(support: DataFrame, changes: DataFrame, new_chunks: DataFrame | None = None) -> DataFrame:
    """document_id and how much each count moves; only the support of what the changes touch is looked up.

    support is that from before the changes; new_chunks: document_id and chunk_id of chunks that were not there before.
    """
    before = support.select(*SUPPORT, F.col("n").alias("_before"))
    touched = netted(changes).join(before, SUPPORT, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    step = F.when((F.col("_before") <= 0) & (F.col("_before") + F.col("n") > 0), 1).when((F.col("_before") > 0) & (F.col("_before") + F.col("n") <= 0), -1).otherwise(0)
    by = lambda s: F.sum(F.when(F.col("status") == s, step).otherwise(0)).alias(s)
    out = touched.groupBy("document_id").agg(F.lit(0).cast("long").alias("total"), *[by(s) for s in COUNTED])
    if new_chunks is not None:
        chunks = new_chunks.groupBy("document_id").agg(F.count_distinct("chunk_id").alias("total"), *[F.lit(0).cast("long").alias(s) for s in COUNTED])
        out = out.unionByName(chunks)
    return out.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def advanced(progress: DataFrame, by: DataFrame) -> DataFrame:
    """``progress`` (document_id, the counts and pending) after the counts moved ``by`` so much."""
    g = progress.select("document_id", *COUNTS).unionByName(by.select("document_id", *COUNTS)).groupBy("document_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
    rest = F.col("total")
    for s in COUNTED:
        rest = rest - F.col(s)
    return g.withColumn("pending", rest).filter("total > 0")
