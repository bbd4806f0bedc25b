"""Log analytics that run on static tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def _timed(log: DataFrame, ts: str, lateness: str) -> DataFrame:
    timed = log.withColumn(ts, c(ts).cast("timestamp"))
    return timed.withWatermark(ts, lateness) if log.isStreaming else timed


def per_window(log: DataFrame, ts: str, value: str, by: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Entries, sum and largest value per time window and class."""
    grouped = _timed(log, ts, lateness).groupBy(F.window(ts, width), c(by))
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(c(value).cast("decimal(18,2)")).alias("total"),
        F.max(value).alias("largest"),
    ).select(c("window.start").alias("window_start"), by, "n", "total", "largest")


def sessions(log: DataFrame, ts: str, by: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity sessions per key: entries closer than ``gap`` belong together."""
    grouped = _timed(log, ts, lateness).groupBy(c(by), F.session_window(ts, gap))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(
        by, "first_ts", "last_ts", "n"
    )


def latest_snapshot(progress: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest progress row per key; on a stream use the update or complete output mode."""
    values = [x for x in progress.columns if x != key]
    return progress.groupBy(key).agg(F.max_by(F.struct(*values), c(ts)).alias("_last")).select(key, "_last.*")
