import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from recordlake.operators import history as H
from recordlake.session import work_folder

SCHEMA = "id string, at timestamp, name string, gone boolean"


def _changes(spark, rows):
    return spark.createDataFrame(rows, "id string, t string, name string, gone boolean").select(
        "id", F.col("t").cast("timestamp").alias("at"), "name", "gone"
    )


def _apply(spark, path, rows, **more):
    return H.apply_changes(_changes(spark, rows), path, "id", "at", deleted=F.col("gone"), buckets=4, splits=2, **more)


def _files(path, version):
    return sorted(glob.glob(f"{path}/data/version={version}/*/*.parquet"))


def _brute(batches):
    """(id, from, to, name) of all states, by replaying the batches."""
    held = {}
    for rows in batches:
        batch = {}
        for i, t, name, gone in rows:
            key = (i, t)
            batch[key] = max(batch.get(key, ("", False)), (name, gone), key=lambda x: (x[0], x[1]))
        held.update(batch)
    out = set()
    for i, t in held:
        later = [u for j, u in held if j == i and u > t]
        out.add((i, t, min(later) if later else None, *held[i, t]))
    return out


def _stored(spark, path, version=None):
    rows = H.history(spark, path, version).select(
        "id", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"), "name", "deleted"
    )
    return [tuple(r) for r in rows.collect()]


def test_histories_equal_replayed_batches(spark):
    r = random.Random(5)
    path, batches = work_folder(spark, "history-test"), []
    for _ in range(3):
        # one key has a third of all changes; late, repeated and same-time changes
        ids = ["hot" if r.random() < 0.33 else f"k{r.randint(0, 9)}" for _ in range(150)]
        rows = [(i, f"2024-01-{r.randint(1, 6):02d} {r.randint(0, 5):02d}:00:00", f"n{r.randint(0, 3)}", r.random() < 0.2) for i in ids]
        batches.append(rows + rows[:5])
        _apply(spark, path, batches[-1])
    for v in (1, 2, 3):
        got = _stored(spark, path, v)
        assert len(got) == len(set(got)) and set(got) == _brute(batches[:v])
    for t in ("2023-12-31 00:00:00", "2024-01-03 02:00:00", "2024-01-09 00:00:00"):
        want = {(i, n) for i, a, b, n, gone in _brute(batches) if not gone and a <= t and (b is None or b > t)}
        got = H.as_of(spark, path, t).select("id", "name").collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_only_touched_buckets_are_rewritten(spark):
    path = work_folder(spark, "history-test")
    assert _apply(spark, path, [(f"k{i}", "2024-01-01 00:00:00", "a", False) for i in range(40)]) == 1
    before = {f: os.stat(f).st_mtime_ns for f in _files(path, 1)}
    assert _apply(spark, path, [("k7", "2024-01-02 00:00:00", "b", False)]) == 2
    assert {f: os.stat(f).st_mtime_ns for f in _files(path, 1)} == before
    buckets = {os.path.dirname(f).rsplit("=", 1)[1] for f in _files(path, 2)}
    assert len(buckets) == 1
    used = {r._f for r in H.history(spark, path).select(F.input_file_name().alias("_f")).distinct().collect()}
    assert sum("version=1/" in f for f in used) == len(before) - sum(f"/bucket={next(iter(buckets))}/" in f for f in before)
    assert len(_stored(spark, path)) == 41 and len(_stored(spark, path, 1)) == 40


def test_a_change_cut_off_leaves_the_version_before(spark):
    path = work_folder(spark, "history-test")
    _apply(spark, path, [("a", "2024-01-01 00:00:00", "x", False)])
    # data without a manifest, as a lost driver leaves it
    _changes(spark, [("a", "2024-01-05 00:00:00", "lost", False)]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(
        f"{path}/data/version=2"
    )
    assert [x[3] for x in _stored(spark, path)] == ["x"]
    assert _apply(spark, path, [("a", "2024-01-03 00:00:00", "y", False)]) == 2
    assert sorted(x[3] for x in _stored(spark, path)) == ["x", "y"]


def test_odd_changes(spark):
    path = work_folder(spark, "history-test")
    with pytest.raises(ValueError):
        H.history(spark, path)
    _apply(spark, path, [("a", "2024-01-01 00:00:00", None, None), ("b", "2024-01-01 00:00:00", "", True)])
    assert _apply(spark, path, []) == 1
    assert [r.id for r in H.as_of(spark, path, "2024-02-01").collect()] == ["a"]
    for bad in [(None, "2024-01-01 00:00:00", "x", False), ("a", None, "x", False)]:
        with pytest.raises(Exception, match="a change without"):
            _apply(spark, path, [bad])
    with pytest.raises(ValueError):
        H.history(spark, path, 2)
    with pytest.raises(ValueError):
        H.apply_changes(_changes(spark, []), path, "id", "at", buckets=8)
    with pytest.raises(ValueError):
        H.apply_changes(_changes(spark, []).withColumn("Version", F.lit(1)), path, "id", "at", buckets=4)


def test_as_of_is_a_filter_in_the_scan(spark):
    path = work_folder(spark, "history-test")
    _apply(spark, path, [("a", "2024-01-01 00:00:00", "x", False)])
    plan = H.as_of(spark, path, "2024-01-02")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "LessThanOrEqual(valid_from" in plan
