"""Review of chunks as they arrive: the batch plan's row-wise part on a stream, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, EngineConfig
from quire.operators import language


def reviewed_stream(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """A streaming DataFrame of chunks with the language rules applied; stateless."""
    return language.review(chunks, config)


def window_counts(reviewed: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Chunks, changes and mean confidence by event-time window (column ts), closed once ``late`` has passed."""
    return reviewed.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("n_chunks"), F.sum(F.size("changes")).alias("n_changes"), F.avg("confidence").alias("avg_confidence"))


def append_to(reviewed: DataFrame, path: str, checkpoint: str):
    """Start writing reviewed chunks to ``path``; restarts go on from ``checkpoint``. Returns the query."""
    return reviewed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
