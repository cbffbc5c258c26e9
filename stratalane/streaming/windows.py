"""Windows over event time and position tracks as streams; the same plans run over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_events(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(start, event_type, n, cents) by window; on a stream `late` bounds how long state is kept."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    cents = F.sum(F.floor(F.col("value") * 100)).alias("cents")
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), cents).select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with no pause longer than gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_seconds("session_window.start").alias("start"), F.unix_seconds("session_window.end").alias("end"), "n")


def window_counts(track: DataFrame, width: int, by: Sequence[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Counts by window of positions, kept up to date over a stream of track rows (output mode update or complete)."""
    return track.groupBy(*by, F.floor(F.col(pos) / width).alias("win")).agg(F.count("*").alias("value"))
