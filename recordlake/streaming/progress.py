"""Progress of batches: partial updates merged field by field, on tables and on streams, and row counts of running streams."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

c = F.col

# The stages after which nothing more is expected, and what a batch shows before its first update.
FINISHED = ("COMPLETED", "COMPLETED_WITH_WARNINGS", "FAILED")
INITIAL = {
    "percentage": 0, "current_stage": "QUEUED", "current_page": 0, "total_pages": 1, "records_detected": 0, "records_valid": 0,
    "warnings_count": 0, "errors_count": 0, "duplicates_count": 0, "current_file": "", "elapsed_ms": 0,
}


def merge_updates(updates: DataFrame, key: str, ts: str, row_id: str, fields: Sequence[str]) -> DataFrame:
    """Per key the last value of every field that was given, by time and then ``row_id``; ``n_updates`` and ``updated_at``.

    A null leaves a field as it was. Partial results merge in any order, so a hot key is reduced before the shuffle. A
    field that was never given has its value of ``INITIAL``, if it has one there. Rows without a key are left out.
    """
    at = F.struct(ts, row_id)
    last = [F.max_by(c(f), F.when(c(f).isNotNull(), at)).alias(f) for f in fields]
    merged = updates.where(c(key).isNotNull()).groupBy(key).agg(*last, F.count(F.lit(1)).alias("n_updates"), F.max(ts).alias("updated_at"))
    return merged.select(key, *[_or_initial(updates, f) for f in fields], "n_updates", "updated_at")


def _or_initial(df: DataFrame, field: str):
    first = INITIAL.get(field)
    return c(field) if first is None else F.coalesce(c(field), F.lit(first).cast(df.schema[field].dataType)).alias(field)


class _Merge(StatefulProcessor):
    """State of one key: per field its last value and the time and row that gave it.

    A timer drops the state ``keep`` after the last update of a finished batch, and ``idle`` after that of any other.
    """

    def __init__(self, key: str, fields: Sequence[str], stage: str, row_id: str, keep_ms: int, idle_ms: int) -> None:
        self.key, self.fields, self.stage, self.row_id = key, list(fields), stage, row_id
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.merged = handle.getValueState("merged", "fields string, n bigint, last_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.merged.get() if self.merged.exists() else ("{}", 0, 0)
        known, n, last = json.loads(held[0]), held[1], held[2]
        for part in rows:  # a part of the key's rows at a time
            n += len(part)
            last = max(last, int(part["update_us"].max()) // 1000)
            order = part.sort_values(["update_us", self.row_id])
            for f in self.fields:
                given = order[order[f].notna()]
                if len(given):
                    row = given.iloc[-1]
                    at = [int(row["update_us"]), str(row[self.row_id]).rjust(20)]
                    if f not in known or known[f][0] < at:
                        known[f] = [at, str(row[f])]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        finished = known.get(self.stage, [None, ""])[1] in FINISHED
        due = last + (self.keep_ms if finished else self.idle_ms)
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        self.merged.update((json.dumps(known), n, last))
        yield self._row(key, known, n, last, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.merged.exists():
            known, n, last = self.merged.get()
            self.merged.clear()
            yield self._row(key, json.loads(known), n, last, True)

    def _row(self, key: tuple, known: dict, n: int, last: int, expired: bool) -> pd.DataFrame:
        row = {self.key: [key[0]]} | {f: [known[f][1] if f in known else None] for f in self.fields}
        return pd.DataFrame(row | {"n_updates": [n], "last_ms": [last], "expired": [expired]})

    def close(self) -> None:
        pass


def merge_updates_stream(
    updates: DataFrame, key: str, ts: str, row_id: str, fields: Sequence[str], stage: str = "current_stage",
    lateness: str = "1 hour", keep_seconds: int = 3600, idle_seconds: int = 7 * 24 * 3600,
) -> DataFrame:
    """:func:`merge_updates` on a stream: a row per key and micro-batch with what is known by then, and one when its state expires.

    An update that comes late but within the watermark counts where its time puts it, field by field. ``n_updates``
    grows with each row of a key, so the row with the largest is the newest. State is as large as the fields of
    the batches that are not yet expired. The session needs the RocksDB state store (:func:`use_rocksdb`).
    """
    stream = updates.withColumn("update_ts", c(ts).cast("timestamp")).withWatermark("update_ts", lateness).where(c(key).isNotNull())
    shaped = stream.select(
        c(key).cast("string").alias(key), c(row_id).cast("bigint").alias(row_id), F.unix_micros("update_ts").alias("update_us"), "update_ts",
        *[c(f).cast("string").alias(f) for f in fields],
    )
    texts = ", ".join(f"`{f}` string" for f in fields)
    merged = shaped.groupBy(key).transformWithStateInPandas(
        _Merge(key, fields, stage, row_id, keep_seconds * 1000, idle_seconds * 1000),
        f"`{key}` string, {texts}, n_updates bigint, last_ms bigint, expired boolean", "Append", "EventTime",
    )
    typed = [c(f).cast(updates.schema[f].dataType).alias(f) for f in fields]
    return merged.select(c(key).cast(updates.schema[key].dataType).alias(key), *typed, "n_updates", F.timestamp_millis("last_ms").alias("updated_at"), "expired")


def use_rocksdb(spark) -> None:
    """Streams started from now on keep their state in RocksDB, which timers and several kinds of state need."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )


def counted(rows: DataFrame, name: str, **sums: str) -> DataFrame:
    """``rows`` that tell how many passed, and sums of columns, once per micro-batch (see :class:`ProgressListener`)."""
    return rows.observe(name, F.count(F.lit(1)).alias("n_rows"), *[F.sum(col).alias(out) for out, col in sums.items()])


class ProgressListener(StreamingQueryListener):
    """Keeps the counts of the last ``keep`` micro-batches that passed rows: dicts with query, micro_batch, name and the counts."""

    def __init__(self, keep: int = 1000) -> None:
        self.seen: deque[dict] = deque(maxlen=keep)
        self.ended: deque[tuple[str, str | None]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.seen.append({"query": str(event.progress.id), "micro_batch": event.progress.batchId, "name": name, **row.asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))

    def updates(self, spark, batch_id: str, name: str) -> DataFrame:
        """The counts of one observation as progress updates of a batch: n_rows becomes records_detected, in order of micro-batch."""
        schema = T._parse_datatype_string("batch_id string, micro_batch bigint, records_detected bigint")
        rows, total = [], 0
        for x in sorted((x for x in self.seen if x["name"] == name), key=lambda x: x["micro_batch"]):
            total += x["n_rows"]
            rows.append((batch_id, x["micro_batch"], total))
        return spark.createDataFrame(rows, schema)
