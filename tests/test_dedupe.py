"""Clusters, age ranges, households and hot keys."""

from pyspark.sql import functions as F

from recordlake.operators import dedupe, keyed, lineage
from test_quality import make


def norm(df):
    return df.withColumns({"norm_name_lat": F.col("name_lat"), "norm_rel_lat": F.col("rel_name_lat"), "norm_house": F.col("house_number")})


def test_same_name_alone_is_no_duplicate(spark):
    df = norm(make(spark, [{}, {"rel_name_lat": "mahesh"}, {"age": 31}, {"house_number": "5"}]))
    clusters = dedupe.composite_clusters(df).collect()
    assert [(r.n_members, r.confidence) for r in clusters] == [(2, 0.75)]
    assert {r.record_id for r in dedupe.cluster_members(df, dedupe.composite_key()).collect()} == {"r1", "r3"}


def test_bracket_and_range_edges(spark):
    df = norm(make(spark, [{"age": 29}, {"age": 30}, {"age": 40, "part": "2"}, {"age": 41, "part": "2"}, {"age": 43, "part": "2"}]))
    members = {r.record_id for r in dedupe.cluster_members(df, dedupe.composite_key()).collect()}
    assert members == {"r3", "r4"}  # 29/30 fall into two brackets
    near = dedupe.age_range_matches(df, ["norm_name_lat", "norm_rel_lat", "norm_house", "part"])
    got = {r.record_id: (r.n_partners, r.partner) for r in near.collect()}
    assert got == {"r1": (1, "r2"), "r2": (1, "r1"), "r3": (1, "r4"), "r4": (1, "r3")}


def test_serial_scope_and_types(spark):
    df = norm(make(spark, [{"source_serial_number": 5}, {"source_serial_number": 5}, {"source_serial_number": 5, "source_file_id": "g"},
                           {"source_serial_number": 6, "source_file_id": None}, {"source_serial_number": 6, "source_file_id": None}]))
    clusters = dedupe.serial_clusters(df).collect()
    assert sorted(r.cluster_key for r in clusters) == ["file_f_s_5", "part_1_s_6"]
    files = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "i")], "source_file_id string, file_hash_sha256 string")
    summary = {r.duplicate_type: r.n_clusters for r in dedupe.cluster_summary(dedupe.all_clusters(df, files)).collect()}
    assert summary == {"DUPLICATE_EPIC": 0, "DUPLICATE_SERIAL_PART": 2, "POSSIBLE_DUPLICATE_RECORD": 1, "REPEATED_IMPORT": 1}
    assert dedupe.all_clusters(df, files, "REPEATED_IMPORT").count() == 1


def test_duplicate_of_needs_six_characters(spark):
    df = norm(make(spark, [{"id_code": "ABCDEF"}, {"id_code": "abcdef"}, {"id_code": "AB1"}, {"id_code": "AB1"}]))
    assert [r.duplicate_of for r in dedupe.mark_duplicate_of(df).orderBy("record_id").collect()] == [None, "r1", None, None]


def test_households(spark):
    df = norm(make(spark, [{"age": 46}, {"age": 50}, {"age": 50}, {"house_number": "-", "age": 70}, {"house_number": None}, {"age": None, "house_number": "9"}]))
    got = {r.record_id: (r.total_members, r.head_record_id, r.is_head) for r in dedupe.household_members(df).collect()}
    assert got == {"r1": (3, "r2", False), "r2": (3, "r2", True), "r3": (3, "r2", False), "r4": (1, "r4", True),
                   "r5": (1, "r5", True), "r6": (1, "r6", True)}
    assert sorted(r.total_members for r in dedupe.household_stats(df).collect()) == [1, 3]
    sizes = lineage.with_household_size(df).orderBy("record_id").collect()
    assert [r.household_count for r in sizes] == [3, 3, 3, 1, 1, 1]


def skewed(spark, n=30_000):
    """A third of all rows share one key, a tenth have none."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 500)
    return spark.range(n).select(F.col("id").alias("row"), key.alias("k"), (F.col("id") % 7).alias("v"))


def test_hot_keys_give_the_same_as_a_window(spark):
    df = skewed(spark)
    stats = {"n": F.count(F.lit(1)), "lo": F.min("row")}
    hot = keyed.with_key_stats(df, ["k"], stats, ["row"], hot_rows=1000)
    want = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("wn"), F.min("row").alias("wl"))
    checked = hot.join(want, "k", "left")
    assert checked.count() == 30_000
    assert checked.where(~(F.col("n").eqNullSafe(F.col("wn")) & F.col("lo").eqNullSafe(F.col("wl")))).count() == 0
    cold = keyed.with_key_stats(df, ["k"], stats, ["row"], hot_rows=10**9)
    assert cold.exceptAll(hot).count() == 0


def test_hot_rows_are_spread_over_tasks(spark):
    df = skewed(spark)
    per_key = keyed.key_stats(df, ["k"], {})
    joined = keyed.attach_by_key(df, per_key, ["k"], ["key_rows"], ["row"], hot_rows=1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "SortMergeJoin" in plan and "CartesianProduct" not in plan
    assert max(sizes) < 30_000 / 4


def test_carry_forward_over_blocks(spark):
    rows = [(g, i, f"h{i}" if i % 13 == 3 else None) for g in ("a", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "g string, i int, h string")
    got = {(r.g, r.i): r.out for r in keyed.carry_forward(df, "g", "i", "h", "out", block_rows=5).collect()}
    for g in ("a", "b"):
        last = None
        for i in range(100):
            last = f"h{i}" if i % 13 == 3 else last
            assert got[g, i] == last
