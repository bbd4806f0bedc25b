"""Per-key state on streams: sliding-window limiter and first-seen flags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.limits import DEFAULT_LIMIT, DEFAULT_SECONDS

c = F.col


def limit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    limit: int = DEFAULT_LIMIT,
    seconds: int = DEFAULT_SECONDS,
    lateness: str = "1 hour",
) -> DataFrame:
    """The sliding-window limiter on a stream; state per key is at most ``limit`` time stamps.

    Hits of one micro-batch are decided in time order. Idle keys lose their
    state once the watermark has passed their window.
    """
    width = seconds * 1_000_000
    stream = events.withColumn("_ts", c(ts).cast("timestamp")).withWatermark("_ts", lateness)
    hits = stream.select(
        c(key).cast("string").alias("key"), c(row_id).cast("string").alias("row_id"),
        F.unix_micros("_ts").alias("us"), "_ts",
    )

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accepted = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        # A micro-batch of one key; its size is set by the source's admission limit.
        rows = pd.concat(list(batches)).sort_values(["us", "row_id"])
        allowed = []
        for now in rows["us"].tolist():
            accepted = [t for t in accepted if t > now - width]
            ok = len(accepted) < limit
            if ok:
                accepted.append(now)
            allowed.append(ok)
        state.update((accepted,))
        last = int(rows["us"].max())
        state.setTimeoutTimestamp(max((last + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"key": rows["key"], "row_id": rows["row_id"], "us": rows["us"], "allowed": allowed}
        )

    decided = hits.groupBy("key").applyInPandasWithState(
        decide,
        "key string, row_id string, us bigint, allowed boolean",
        "accepted array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return decided


def flag_repeats_stream(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``is_repeat`` on every row of a stream whose key was seen before; state is one flag per key."""
    shaped = rows.select(c(key).cast("string").alias("key"), c(order).cast("bigint").alias("seq"))

    def flag(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Most keys have few rows, so what is done once a key decides the time: no sort, no copy of a single part.
        parts = list(batches)
        found = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        seq = found["seq"].to_numpy()
        repeats = np.ones(len(seq), dtype=bool)
        if not state.exists:
            repeats[seq.argmin()] = False
            state.update((True,))
        found["is_repeat"] = repeats
        yield found

    return shaped.where(c("key").isNotNull()).groupBy("key").applyInPandasWithState(
        flag, "key string, seq bigint, is_repeat boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def drop_repeats_stream(rows: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """First row per key on a stream, with state kept only ``within`` the watermark."""
    return rows.withColumn(ts, c(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)
