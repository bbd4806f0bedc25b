"""Entities against brute force: chains, hubs, several rules, nulls."""

import random

from pyspark.sql import functions as F

from recordlake.operators import entities


def brute(edges):
    at = {}
    for m, k in edges:
        if m is not None and k is not None:
            at.setdefault(k, []).append(m)
    group = {m: {m} for m, _ in edges if m is not None}
    for members in at.values():
        whole = set().union(*(group[m] for m in members))
        for m in whole:
            group[m] = whole
    return {m: min(g) for m, g in group.items()}


def found(spark, edges):
    df = spark.createDataFrame(edges, "member bigint, cluster string")
    return {r.member: r.entity for r in entities.components(df).collect()}


def test_random_graphs_equal_brute_force(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 400), f"k{rng.randint(0, 350)}") for _ in range(420)] + [(7, None), (None, "k1"), (3, "k1"), (3, "k1")]
    want = brute(edges)
    got = found(spark, edges)
    assert got == {m: want[m] for m in got} and set(got) == {m for m, k in edges if m is not None and k is not None}
    assert found(spark, [(1, None)]) == {}


def test_a_chain_and_a_hub(spark):
    chain = [(i + d, f"c{i}") for i in range(600) for d in (0, 1)]  # neighbours only, in order
    hub = [(10_000 + i, "hub") for i in range(5_000)]
    got = found(spark, chain + hub)
    assert {got[i] for i in range(601)} == {0} and {got[10_000 + i] for i in range(5_000)} == {10_000}


def test_rules_join_into_one_entity(spark):
    rows = [(1, "A1", "f"), (2, "A1", None), (3, None, "f"), (4, "B1", None), (5, None, None), (6, "f", None)]
    df = spark.createDataFrame(rows, "record_id bigint, a string, b string")
    got = entities.entities(df, {"a": F.col("a"), "b": F.col("b")}).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
