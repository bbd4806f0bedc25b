"""Every registered query on the smallest tables, and the shape of the plans."""

import re

import pytest

from compare import compare, connect
from recordlake.plans import load

REGISTRY = load()
# May be empty on the smallest tables, where keys do not repeat.
MAY_BE_EMPTY = {
    "dup_exact_key", "dup_serial_scope", "dup_composite", "dup_members", "dup_cluster_files", "dup_age_range",
    "filter_structured", "filter_serial", "filter_house", "sorted_page", "search_id_partial", "audit_query", "unique_violations",
}
# The sequential limiter and state; redaction, which follows nesting to any depth in one pandas UDF.
NEEDS_PYTHON = {"rate_limit", "rate_limit_stream", "stream_flag_repeats", "redact_json"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, sf_dir, con, name):
    def check(plan):
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
        if name not in NEEDS_PYTHON:
            assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas", plan)

    problem = compare(spark, sf_dir, name, con, check)
    if name in MAY_BE_EMPTY and problem == "equal, but no rows":
        problem = ""
    assert problem == ""


def test_every_oracle_has_a_query():
    assert set(REGISTRY.ORACLES) <= set(REGISTRY.QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["record_id", "score"]


def test_filters_reach_a_stored_table(spark, sf_dir, tmp_path):
    from recordlake.operators.search import SearchFilters, search
    from recordlake.plans.views import register

    path = str(tmp_path / "records")
    register(spark, sf_dir).write.parquet(path)
    stored = spark.read.parquet(path)
    found = search(stored, SearchFilters(query="widget", gender="FEMALE", ward="Brand#3"))
    plan = found.matches.select("record_id", "score")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gender,FEMALE)" in plan and "EqualTo(ward,Brand#3)" in plan
    read = plan[plan.index("ReadSchema"):].splitlines()[0]
    assert "house_number" not in read and "norm_name_l" in read
    page = found.page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page or "CollectLimit" in page or "GlobalLimit" in page


@pytest.mark.parametrize("name", ["top_k_per_query", "first_errors", "retention_per_user"])
def test_top_n_is_limited_before_the_shuffle(spark, sf_dir, name):
    plan = REGISTRY.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_per_key_aggregate_is_computed_once(spark, sf_dir):
    df = REGISTRY.QUERIES["dup_id_in_batch"](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_replies_are_parsed_once_and_ids_not_joined(spark, sf_dir):
    plan = REGISTRY.QUERIES["json_items"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"^[ +:*()\d-]*Generate ", plan.split("\n\n")[0], re.M)) == 1
    assert "Join" not in plan
