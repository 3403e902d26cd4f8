"""Window assignment and track splitting of a stream of points, equal to the batch operators once the watermark has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(points: DataFrame, ts: str, length: str, step: str, late: str, key: str, value: str) -> DataFrame:
    """Moving-window statistics of a stream: number and mean per key and window; rows more than `late` behind are dropped."""
    w = F.window(ts, length, step)
    return (
        points.withWatermark(ts, late)
        .groupBy(w.alias("w"), F.col(key))
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("t1"), F.col("w.end").alias("t2"), key, "n", "mean")
    )


def stream_segments(points: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Runs of a track's points without a time gap of `gap`: start, end and number, emitted once the watermark has passed their end."""
    return (
        points.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("w"), F.col(key))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
        .select(key, "first", "last", "n")
    )
