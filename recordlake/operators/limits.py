"""Sliding-window limits over an event log."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col

DEFAULT_LIMIT, DEFAULT_SECONDS = 60, 60  # Fixed values.


def trailing_count(events: DataFrame, key: str, ts: str, seconds: int = DEFAULT_SECONDS) -> DataFrame:
    """Hits per key in the window ``(ts - seconds, ts]``, without a one-task-per-key sort.

    Events are cut into buckets one window long. A hit only needs its own
    bucket and the one before, so each bucket is counted on its own over its
    hits and a copy of the previous bucket's.
    """
    micros = _micros(ts)
    width = seconds * 1_000_000
    placed = events.withColumn("_us", micros).withColumn("_bucket", _bucket_of("_us", width))
    copies = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_shift"))
    copies = copies.withColumn("_bucket", c("_bucket") + c("_shift"))
    w = Window.partitionBy(key, "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    counted = copies.withColumn("hits_in_window", F.count(F.lit(1)).over(w))
    return counted.where(c("_shift") == 0).select(*events.columns, "hits_in_window")


def _micros(ts: str):
    return F.unix_micros(c(ts).cast("timestamp"))


def _bucket_of(us: str, width: int):
    return ((c(us) - F.pmod(c(us), F.lit(width))) / width).cast("bigint")


def independent_runs(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Cut every key's events where a whole window-long bucket is empty: adds ``_us`` and ``_run``.

    Decisions before such a gap cannot matter after it, so runs are decided
    apart. Only the distinct buckets are ordered per key, not the events.
    """
    width = seconds * 1_000_000
    placed = events.withColumn("_us", _micros(ts)).withColumn("_bucket", _bucket_of("_us", width))
    buckets = placed.select(key, "_bucket").distinct()
    w = Window.partitionBy(key).orderBy("_bucket")
    starts = F.coalesce(c("_bucket") - F.lag("_bucket").over(w) > 1, F.lit(True))
    marked = buckets.withColumn("_start", F.when(starts, c("_bucket")))
    runs = marked.withColumn("_run", F.last("_start", ignorenulls=True).over(w)).drop("_start")
    return placed.join(runs, [key, "_bucket"]).drop("_bucket")


def rate_limit(
    events: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    limit: int = DEFAULT_LIMIT,
    seconds: int = DEFAULT_SECONDS,
) -> DataFrame:
    """Decide every hit: ``allowed``, ``remaining`` and ``reset_seconds``.

    A hit is denied when ``limit`` accepted hits lie in the window before it;
    denied hits do not count. Runs are streamed in time order through their
    tasks, with at most ``limit`` time stamps in memory.
    """
    width = seconds * 1_000_000
    runs = independent_runs(events.select(key, ts, row_id), key, ts, seconds)
    ordered = runs.select(
        c(key).cast("string").alias("_key"), "_run", "_us", c(row_id).cast("string").alias("_id")
    ).repartition("_key", "_run").sortWithinPartitions("_key", "_run", "_us", "_id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            allowed, remaining, reset = [], [], []
            for k, run, now in zip(batch["_key"], batch["_run"], batch["_us"]):
                if (k, run) != current:
                    current, accepted = (k, run), deque()
                while accepted and accepted[0] <= now - width:
                    accepted.popleft()
                ok = len(accepted) < limit
                if ok:
                    accepted.append(now)
                allowed.append(ok)
                remaining.append(limit - len(accepted) if ok else 0)
                wait = seconds if ok else max(1, -((now - width - accepted[0]) // 1_000_000))
                reset.append(int(wait))
            yield pd.DataFrame(
                {
                    "_key": batch["_key"], "_id": batch["_id"], "_us": batch["_us"],
                    "allowed": allowed, "remaining": remaining, "reset_seconds": reset,
                }
            )

    decided = ordered.mapInPandas(
        decide, "_key string, _id string, _us bigint, allowed boolean, remaining int, reset_seconds int"
    )
    types = dict(events.dtypes)
    return decided.select(
        c("_key").cast(types[key]).alias(key),
        c("_id").cast(types[row_id]).alias(row_id),
        F.timestamp_micros("_us").alias(ts),
        "allowed", "remaining", "reset_seconds",
    )


def latest_state(events: DataFrame, key: str, ts: str, row_id: str) -> DataFrame:
    """The last event of every key (progress snapshot), by partial aggregation."""
    values = [x for x in events.columns if x != key]
    return events.groupBy(key).agg(
        F.max_by(F.struct(*values), F.struct(ts, row_id)).alias("_last"), F.count(F.lit(1)).alias("n_events")
    ).select(key, "_last.*", "n_events")
