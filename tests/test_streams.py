"""Limiter against brute force, trailing counts, streams against batch results."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recordlake.operators import limits
from recordlake.streaming import ingest, logs, stateful

START = datetime(2024, 1, 1)


def events(spark, hits):
    rows = [(i, k, START + timedelta(seconds=s)) for i, (k, s) in enumerate(hits)]
    return spark.createDataFrame(rows, "event_id bigint, user_id string, ts timestamp")


def allowed(df):
    return {r.event_id: r.allowed for r in df.collect()}


def test_limiter_case(spark):
    df = events(spark, [("u", s) for s in (0, 1, 2, 3, 4, 5, 61)])
    decided = {r.event_id: r for r in limits.rate_limit(df, "user_id", "ts", "event_id", 5, 60).collect()}
    assert [decided[i].allowed for i in range(7)] == [True] * 5 + [False, True]
    assert decided[5].reset_seconds == 55 and decided[4].remaining == 0 and decided[6].remaining == 1


def brute(hits, limit, seconds):
    out, kept = {}, {}
    for i, (k, s) in sorted(enumerate(hits), key=lambda x: (x[1][0], x[1][1], str(x[0]))):
        window = [t for t in kept.get(k, []) if t > s - seconds]
        out[i] = len(window) < limit
        kept[k] = window + [s] * out[i]
    return out


def test_limiter_equals_brute_force_with_a_hot_key(spark):
    rng = random.Random(1)
    hits = [("hot" if rng.random() < 0.4 else f"u{rng.randint(1, 20)}", rng.randint(0, 3000)) for _ in range(2500)]
    df = events(spark, hits)
    assert allowed(limits.rate_limit(df, "user_id", "ts", "event_id", 4, 50)) == brute(hits, 4, 50)
    runs = limits.independent_runs(df, "user_id", "ts", 50)
    assert runs.where("user_id = 'u1'").select("_run").distinct().count() > 1


def test_trailing_count(spark):
    rng = random.Random(2)
    hits = [(rng.choice("ab"), rng.randint(0, 600)) for _ in range(300)]
    got = {r.event_id: r.hits_in_window for r in limits.trailing_count(events(spark, hits), "user_id", "ts", 60).collect()}
    for i, (k, s) in enumerate(hits):
        assert got[i] == sum(1 for k2, s2 in hits if k2 == k and s - 60 < s2 <= s)


def test_streams_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    hits = sorted([(rng.choice("abc"), rng.randint(0, 5000)) for _ in range(400)], key=lambda x: x[1])
    df = events(spark, hits)
    path = str(tmp_path / "events")
    for part in range(4):  # four micro-batches in time order
        df.where(F.floor(F.col("event_id") / 100) == part).coalesce(1).write.mode("append").parquet(path)
    stream = ingest.table_stream(spark, path, files_per_batch=1)
    got = ingest.run_to_table(stateful.limit_stream(stream, "user_id", "ts", "event_id", 3, 60), "limit")
    assert {int(r.row_id): r.allowed for r in got.collect()} == brute(hits, 3, 60)

    stream = ingest.table_stream(spark, path, files_per_batch=1)
    flags = ingest.run_to_table(stateful.flag_repeats_stream(stream, "user_id", "event_id"), "flags").collect()
    assert len(flags) == 400 and sum(not r.is_repeat for r in flags) == 3

    stream = ingest.table_stream(spark, path, files_per_batch=1)
    firsts = ingest.run_to_table(stateful.drop_repeats_stream(stream, ["user_id"], "ts", "1 day"), "firsts")
    assert firsts.count() == 3


def test_log_windows_on_streams(spark, tmp_path):
    df = events(spark, [("a", 10), ("a", 20), ("a", 4000), ("b", 30), ("b", 20000)]).withColumn("value", F.lit(1.5))
    path = str(tmp_path / "log")
    df.coalesce(1).write.parquet(path)
    static = logs.per_window(df, "ts", "value", "user_id").where("n = 2").first()
    assert (static.user_id, static.total) == ("a", 3)
    stream = logs.per_window(ingest.table_stream(spark, path), "ts", "value", "user_id", lateness="1 minute")
    closed = ingest.run_to_table(stream, "hourly")
    assert {(r.user_id, r.n) for r in closed.collect()} <= {("a", 2), ("a", 1), ("b", 1)}
    assert sorted(r.n for r in logs.sessions(df, "ts", "user_id", "30 minutes").collect()) == [1, 1, 1, 2]
    assert logs.latest_snapshot(df, "user_id", "ts").count() == 2


def test_ingest_is_repeatable(spark, tmp_path):
    folder, table = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    (folder / "a.csv").write_text("name,age\nAnita,30\nSeema,16\n")

    def run():
        ingest.ingest_files(spark, str(folder), ["name", "age"], table, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.name_lat, r.status) for r in spark.read.parquet(table).collect())

    assert run() == [("anita", "WARNING"), ("seema", "WARNING")]
    assert run() == run()
    (folder / "b.csv").write_text("name,age\nPooja,41\n,5\n")
    assert [x[0] for x in run()] == ["anita", "pooja", "seema"]
