import random
import re

import pytest
from pyspark.sql import functions as F

from recordlake.operators import ranked
from recordlake.session import work_folder

def _order():
    return [F.col("k").desc_nulls_last(), F.col("id")]


def _rows():
    r = random.Random(5)
    return [(i, None if i % 50 == 0 else 7 if i % 3 == 0 else r.randrange(40), f"t{i}") for i in range(3000)]


def _sorted(rows):
    return sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))


@pytest.fixture(scope="module")
def stored(spark):
    path = work_folder(spark, "ranked")
    df = spark.createDataFrame(_rows(), "id long, k int, t string").repartition(7)
    ranked.store(df, path, _order(), ranges=16)
    return path


def test_ranks_are_those_of_the_whole_sort(spark, stored):
    got = sorted(map(tuple, ranked.ranked(spark, stored).select("rank", "id", "k", "t").collect()))
    assert got == [(i, *x) for i, x in enumerate(_sorted(_rows()), 1)]
    assert ranked.total(spark, stored) == 3000


@pytest.mark.parametrize("number,size", [(1, 10), (2, 700), (37, 25), (120, 25), (121, 25), (1, 5000), (300, 10), (1, 1), (3000, 1)])
def test_any_page_equals_offset_and_limit(spark, stored, number, size):
    got = [tuple(x) for x in ranked.page(spark, stored, number, size).select("id", "k", "t").collect()]
    assert got == _sorted(_rows())[(number - 1) * size : number * size]


def test_a_frequent_value_lies_in_several_ranges_and_a_page_reads_few(spark, stored):
    rows = spark.read.parquet(f"{stored}/rows")
    assert rows.where("k = 7").select("range_no").distinct().count() > 3
    largest = rows.groupBy("range_no").count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 4
    plan = ranked.page(spark, stored, 150, 10)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*range_no", plan)
    assert re.search(r"PushedFilters: \[[^]]*place", plan)
    assert "Window" not in plan and "Offset" not in plan


def test_places_inside_a_range_follow_the_order_of_its_file(spark, stored):
    for r in (0, 5):
        kept = [x.place for x in spark.read.parquet(f"{stored}/rows/range_no={r}").collect()]
        assert kept == list(range(len(kept)))


def test_equal_rows_keep_one_rank_each(spark):
    path = work_folder(spark, "ranked")
    ranked.store(spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "k string"), path, [F.col("k")], ranges=8)
    got = [(x["rank"], x.k) for x in ranked.ranked(spark, path).orderBy("rank").collect()]
    assert got == [(i, "a" if i <= 50 else "b") for i in range(1, 101)]


def test_empty_results_and_refused_arguments(spark, stored):
    path = work_folder(spark, "ranked")
    none = spark.createDataFrame([], "id long, k int")
    ranked.store(none, path, _order(), ranges=4)
    assert ranked.total(spark, path) == 0
    assert ranked.page(spark, path, 1, 10).columns == ["rank", "id", "k"]
    assert ranked.page(spark, path, 1, 10).count() == ranked.ranked(spark, path).count() == 0
    with pytest.raises(ValueError):
        ranked.store(none.withColumn("rank", F.lit(1)), path + "x", _order())
    with pytest.raises(ValueError):
        ranked.store(none, path + "x", [])
    with pytest.raises(ValueError):
        ranked.page(spark, stored, 0, 10)
