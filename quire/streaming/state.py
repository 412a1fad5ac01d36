"""State tables kept by streams: the latest row of each key, and signed changes of status.

Keyed state lives in the query's checkpoint. What a micro-batch changes is written to a folder of the batch's own number, so a
batch that runs again after a failure replaces what it wrote and nothing is there twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators.state import KEY, latest


def latest_of(rows: DataFrame, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ("updated_at", "review_id")) -> DataFrame:
    """key and row: of all rows so far the one with the greatest ``order`` (nulls lowest); a late older row changes nothing."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))


def upsert_into(rows: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = KEY, order: tuple[str, ...] = ("updated_at", "review_id")) -> StreamingQuery:
    """Start keeping the latest row of each key of the stream ``rows`` in the table at ``path``; a restart goes on from ``checkpoint``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("row.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_of(rows, key, order).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def read_table(spark: SparkSession, path: str, key: tuple[str, ...] = KEY) -> DataFrame | None:
    """The table that ``upsert_into`` keeps, one row for each key; None before the first batch."""
    try:
        changes = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return latest(changes, list(key), F.desc(F.col("batch").cast("long"))).drop("batch")


def signed_changes(rows: DataFrame) -> DataFrame:
    """document_id, chunk_id, status, n from a stream of reviews (document_id, chunk_id, status, updated_at, review_id).

    Where a chunk's latest review changes its status, the new one counts +1 and the one before -1; a late review counts nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.getOption
        best = had
        for frame in frames:
            for at, review, status in zip(frame["at"], frame["review_id"], frame["status"]):
                if best is None or (at, review) > best[:2]:
                    best = (int(at), review, status)
        if best != had:
            state.update(best)
        signs = [(best[2], 1)] + ([(had[2], -1)] if had else []) if best and (had is None or had[2] != best[2]) else []
        yield pd.DataFrame([(*key, s, n) for s, n in signs], columns=[*KEY, "status", "n"])

    timed = rows.select(*KEY, "status", "review_id", F.unix_micros("updated_at").alias("at"))
    schema = ", ".join([*(f"{c} string" for c in KEY), "status string", "n long"])
    return timed.groupBy(*KEY).applyInPandasWithState(step, schema, "at long, review_id string, status string", "append", GroupStateTimeout.NoTimeout)
