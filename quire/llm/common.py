"""Helpers shared by the training-text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and their lower-case letters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows that a Python function gets at a time.
ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints (``spark.checkpoint.dir``).

    Where it is unset, a temporary one serves a local master, whose tasks share the driver's disk; a cluster's would not, so there it is an error.
    """
    sc = spark.sparkContext
    if base := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return base
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(base := tempfile.mkdtemp(prefix="quire-"))
    return base


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor; columns that are read by several later steps are computed once.
    The files serve lazy results, so whoever owns the folder clears it after the job.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = ROWS) -> DataFrame:
    """``df.mapInArrow`` where ``each`` gets at most ``rows`` rows at a time, so that whole texts stay few as Python objects."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(b.slice(lo, rows) for b in batches for lo in range(0, b.num_rows, rows))

    return df.mapInArrow(sliced, schema)


def packed(docs: DataFrame, *own: str) -> DataFrame:
    """The columns ``own``, and all others as one struct ``_rest``, so that none of them can clash with a helper's columns."""
    rest = [c for c in docs.columns if c not in own]
    return docs.select(*own, (F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """``columns`` in their order, from ``df`` itself or from its ``_rest``, and ``more`` behind."""
    return df.select(*[F.col(c) if c in df.columns else F.col("_rest").getField(c).alias(c) for c in columns], *more)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text falls in ``fold``; null ids are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))
