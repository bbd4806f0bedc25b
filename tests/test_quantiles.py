import math
import random

import pytest
from pyspark.sql import functions as F

from recordlake.session import work_folder
from recordlake.streaming import ingest, quantiles as Q

SHARES = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def _values():
    r = random.Random(8)
    some = [r.lognormvariate(0, 4) for _ in range(400)] + [-r.lognormvariate(2, 2) for _ in range(200)]
    return some + [0.0] * 30 + [7.5] * 300 + [5e-324, 1.7e308, -1.7e308]


@pytest.mark.parametrize("accuracy", [0.01, 0.1])
def test_within_the_stated_error_and_merging_loses_nothing(spark, accuracy):
    values = _values()
    rows = [("a" if i % 3 else "b", i % 24, v) for i, v in enumerate(values)]
    df = spark.createDataFrame([*rows, ("a", 1, None), ("a", 2, float("nan")), ("c", 1, None)], "k string, h int, v double")
    at_once = Q.sketch(df, ["k"], "v", accuracy)
    hours = Q.sketch(df, ["k", "h"], "v", accuracy)
    assert sorted(map(tuple, Q.merge(hours, ["k"]).collect())) == sorted(map(tuple, at_once.collect()))
    got = {r.k: r for r in Q.quantiles(hours, ["k"], SHARES, accuracy).collect()}
    assert set(got) == {"a", "b"}
    for k in got:
        ordered = sorted(v for kk, _, v in rows if kk == k)
        assert got[k].n == len(ordered)
        for name, share in SHARES.items():
            true = ordered[max(1, math.ceil(share * len(ordered))) - 1]
            assert math.isclose(got[k][name], true, rel_tol=accuracy * (1 + 1e-9), abs_tol=1e-323), (name, true, got[k][name])


def test_places_are_in_the_order_of_values(spark):
    values = sorted({*_values(), math.inf, -math.inf})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    places = [r.p for r in df.select("i", Q.place_of(F.col("v")).alias("p")).orderBy("i").collect()]
    assert places == sorted(places)
    with pytest.raises(ValueError):
        Q.place_of(F.col("v"), 1.0)


def test_empty_and_whole_tables(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert Q.quantiles(Q.sketch(none, ["k"], "v"), ["k"], SHARES).count() == 0
    one = spark.createDataFrame([("a", 3.0)], "k string, v double")
    assert math.isclose(Q.quantiles(Q.sketch(one, [], "v"), [], SHARES).first().p50, 3.0, rel_tol=0.01)


def test_windows_of_a_stream_equal_those_of_the_table(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    table = Q.window_sketch(spark.read.parquet(path), "ts", "value", ["event_type"])
    stream = Q.window_sketch(ingest.table_stream(spark, path), "ts", "value", ["event_type"])
    name = "sketch_" + work_folder(spark, "q")[-8:]
    run = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, table.collect()))
