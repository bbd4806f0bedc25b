"""Lookups, lineage, group sizes and hierarchy subtotals on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage
from .registry import query
from .views import r_sql, register, table

c = F.col


@query(
    "lookup_left",
    """
    SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Electoral Roll') AS p_name
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey + 50
    """,
)
def lookup_left(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # Shifted keys leave some lines without a part.
    parts = table(spark, sf_dir, "part").select((c("p_partkey") + 50).alias("p_partkey"), "p_name")
    found = lineage.lookup(lines, parts, {"l_partkey": "p_partkey"}, {"p_name": lineage.DEFAULT_FILE_NAME})
    return found.drop("l_partkey")


@query(
    "lineage",
    """
    SELECT l_orderkey, l_linenumber, o_orderkey AS source_file, c_mktsegment AS batch_name, n_name
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey
    """,
)
def lineage_query(spark, sf_dir):
    records = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", c("l_orderkey").alias("source_file_id")
    )
    files = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("source_file_id"), c("o_custkey").alias("batch_id"),
        c("o_orderkey").alias("original_filename"), F.lit("").alias("file_hash_sha256"), F.lit("").alias("storage_name"),
    )
    batches = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("batch_id"), c("c_mktsegment").alias("batch_name"), c("c_nationkey").alias("status")
    )
    linked = lineage.provenance(records, files, batches)
    named = lineage.lookup(
        linked, table(spark, sf_dir, "nation"), {"batch_status": "n_nationkey"}, {"n_name": None}
    )
    return named.select("l_orderkey", "l_linenumber", c("original_filename").alias("source_file"), "batch_name", "n_name")


@query(
    "batch_files",
    """
    SELECT c_custkey AS batch_id, o_orderkey AS source_file_id, count(o_orderkey) OVER (PARTITION BY c_custkey) AS n_files
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey
    """,
)
def batch_files(spark, sf_dir):
    batches = table(spark, sf_dir, "customer").select(c("c_custkey").alias("batch_id"))
    files = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("batch_id"), c("o_orderkey").alias("source_file_id"),
        c("o_orderpriority").alias("original_filename"),
    )
    return lineage.batch_files(batches, files).select("batch_id", "source_file_id", "n_files")


@query(
    "group_size",
    r_sql("SELECT record_id, count(*) OVER (PARTITION BY coalesce(part, 'default'), norm_house) AS household_count FROM r"),
)
def group_size(spark, sf_dir):
    return lineage.with_household_size(register(spark, sf_dir)).select("record_id", "household_count")


@query(
    "hierarchy_rollup",
    """
    SELECT r_name, n_name, CAST((1 - grouping(r_name)) + (1 - grouping(n_name)) AS INTEGER) AS depth,
      count(*) AS customers, sum(CAST(c_acctbal AS DECIMAL(12, 2)))::DOUBLE AS balance
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)
    """,
)
def hierarchy_rollup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")
    )
    facts = table(spark, sf_dir, "customer").join(nations, c("c_nationkey") == c("n_nationkey"))
    balance = F.sum(c("c_acctbal").cast("decimal(12,2)")).cast("double")
    return lineage.hierarchy_rollup(
        facts, ["r_name", "n_name"], {"customers": F.count(F.lit(1)), "balance": balance}
    )
