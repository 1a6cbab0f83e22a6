"""The window operators as streams: tumbling levels and gap sessions. Folds with a state of their own are in ``folds``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import level


def levels(stream: DataFrame, key: str, ts: str, value: str, size: str, late: str) -> DataFrame:
    """Level features of tumbling windows; rows later than ``late`` are left out, as windows are closed by then."""
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key)
    return windows.agg(*(c.alias(n) for n, c in level(F.col(value)).items())).select(key, F.col("w.start").alias("start"), *level(F.col(value)))


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Intervals of events that are no further apart than ``gap`` (inclusive); the end is that of the last event."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys)
    return grouped.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("samples")).select(*keys, "start", "end", "samples")


def resumable(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Writes all that has arrived and ends; the next call, after a restart too, goes on behind it and repeats nothing."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
