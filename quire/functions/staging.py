"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local master, whose tasks share the driver's disk, gets a temporary one where that is unset."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return found
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(made := tempfile.mkdtemp(prefix="quire-"))
    return made


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and several readers share one computation.

    Whoever owns the folder clears it after the job, since lazy results read these files.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
