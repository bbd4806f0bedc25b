"""Field-wise progress against brute force, on tables and on streams, with late updates, expiry and row counts."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recordlake.streaming import ingest, progress

START = datetime(2024, 1, 1)
SCHEMA = "row_id bigint, batch_id string, ts timestamp, percentage int, current_stage string, current_file string"
FIELDS = ["percentage", "current_stage", "current_file"]


def brute(rows):
    out = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[2], r[0])):
        have = out.setdefault(r[1], [0, "QUEUED", ""])
        for i, v in enumerate(r[3:]):
            if v is not None:
                have[i] = v
    return {k: tuple(v) for k, v in out.items()}


def updates(seed, n=300):
    rng = random.Random(seed)
    return [
        (
            i, rng.choice(["a", "a", "b", "c", None]), START + timedelta(seconds=rng.randint(0, 200)),
            rng.choice([None, rng.randint(0, 99)]), rng.choice([None, "PARSING", "SAVING"]), rng.choice([None, "x.csv", "y.csv"]),
        )
        for i in range(n)
    ]


def test_merge_equals_brute_force(spark):
    rows = updates(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = progress.merge_updates(df, "batch_id", "ts", "row_id", FIELDS).collect()
    assert {r.batch_id: tuple(r[f] for f in FIELDS) for r in got} == brute(rows)
    assert sum(r.n_updates for r in got) == sum(r[1] is not None for r in rows)
    empty = spark.createDataFrame([(1, "z", START, None, None, None)], SCHEMA)
    assert progress.merge_updates(empty, "batch_id", "ts", "row_id", FIELDS).first()[1:4] == (0, "QUEUED", "")
    assert progress.merge_updates(df.limit(0), "batch_id", "ts", "row_id", FIELDS).isEmpty()


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    progress.use_rocksdb(spark)
    yield
    spark.conf.set(key, before)


def run(spark, tmp_path, parts, **options):
    path = str(tmp_path / "updates")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    stream = ingest.table_stream(spark, path, files_per_batch=1)
    return ingest.run_to_table(progress.merge_updates_stream(stream, "batch_id", "ts", "row_id", FIELDS, **options), "progress").collect()


def test_stream_with_late_updates_equals_brute_force(spark, tmp_path, rocksdb):
    rows = updates(2, 120)  # in no order of time: later micro-batches hold earlier updates
    got = run(spark, tmp_path, [rows[i : i + 40] for i in range(0, 120, 40)])
    newest = {}
    for r in got:
        if r.batch_id not in newest or r.n_updates > newest[r.batch_id].n_updates:
            newest[r.batch_id] = r
    want = {k: tuple(None if v == progress.INITIAL[f] else v for f, v in zip(FIELDS, x)) for k, x in brute(rows).items()}
    assert {k: tuple(r[f] for f in FIELDS) for k, r in newest.items()} == want
    assert not any(r.expired for r in got)


def test_state_of_finished_batches_expires(spark, tmp_path, rocksdb):
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [(1, "done", at(0), 100, "COMPLETED", None), (2, "open", at(0), 10, "PARSING", None)],
        [(3, "other", at(500), 1, None, None)],
        [(4, "other", at(600), 2, None, None)],
        [(5, "done", at(600), 5, None, None), (6, "open", at(600), 20, None, None)],
    ]
    got = run(spark, tmp_path, parts, lateness="1 second", keep_seconds=60, idle_seconds=100_000)
    assert [(r.batch_id, r.percentage, r.current_stage) for r in got if r.expired] == [("done", 100, "COMPLETED")]
    newest = {r.batch_id: r for r in sorted(got, key=lambda r: (r.updated_at, r.n_updates))}
    assert (newest["open"].percentage, newest["open"].current_stage, newest["open"].n_updates) == (20, "PARSING", 2)
    # what came behind the expiry starts anew
    assert (newest["done"].percentage, newest["done"].current_stage, newest["done"].n_updates) == (5, None, 1)


def test_counts_of_a_running_stream(spark, tmp_path):
    listener = progress.ProgressListener()
    spark.streams.addListener(listener)
    try:
        path = str(tmp_path / "updates")
        for part in (updates(3, 30), updates(4, 12)):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = progress.counted(ingest.table_stream(spark, path, files_per_batch=1), "rows", row_sum="row_id")
        assert ingest.run_to_table(stream, "counted").count() == 42
        for _ in range(50):
            if len(listener.seen) >= 2:
                break
            time.sleep(0.1)
        assert sum(x["n_rows"] for x in listener.seen) == 42
        assert sum(x["row_sum"] for x in listener.seen) == sum(range(30)) + sum(range(12))
        merged = progress.merge_updates(
            listener.updates(spark, "b", "rows").withColumn("ts", F.col("micro_batch")), "batch_id", "ts", "micro_batch", ["records_detected"]
        )
        assert merged.first().records_detected == 42
    finally:
        spark.streams.removeListener(listener)
