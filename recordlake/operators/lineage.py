"""Lookups and joins: file names, provenance, errors of a batch, group sizes, hierarchy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import with_key_stats

c = F.col

DEFAULT_FILE_NAME = "Electoral Roll"  # Fixed value.


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], values: dict[str, object]) -> DataFrame:
    """Left lookup: ``values`` maps a looked-up column to the default where nothing is found.

    No broadcast hint: the size of the looked-up table decides, at run time.
    """
    wanted = table.select(
        *[c(right).alias(f"_k_{left}") for left, right in on.items()],
        *[c(v).alias(f"_v_{v}") for v in values],
    )
    joined = df.join(wanted, [c(left) == c(f"_k_{left}") for left in on], "left")
    return joined.select(
        *df.columns, *[F.coalesce(c(f"_v_{v}"), F.lit(d)).alias(v) for v, d in values.items()]
    )


def provenance(records: DataFrame, files: DataFrame, batches: DataFrame) -> DataFrame:
    """Every record with its source file and import batch; missing links stay NULL."""
    f = files.select(
        c("source_file_id").alias("_file"), c("batch_id").alias("_batch"),
        "original_filename", "file_hash_sha256", "storage_name",
    )
    b = batches.select(c("batch_id").alias("_b"), "batch_name", c("status").alias("batch_status"))
    linked = f.join(b, c("_batch") == c("_b"), "left").drop("_b")
    joined = records.join(linked, records["source_file_id"] == c("_file"), "left")
    return joined.drop("_file").withColumnRenamed("_batch", "file_batch_id")


def errors_of_batch(errors: DataFrame, files: DataFrame, batch_id: object) -> DataFrame:
    """Errors whose source file belongs to the batch."""
    ids = files.where(c("batch_id") == F.lit(batch_id)).select("source_file_id")
    return errors.join(ids, "source_file_id", "left_semi")


def one_to_many(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Left join of unique rows to any number of partners, safe for a key with very many.

    A left join cannot split a hot key of its right side. So rows with partners
    come from an inner join, which can, and the others from an anti join.
    """
    matched = many.join(one, key)
    partners = many.select(key).distinct()
    lonely = one.join(partners, key, "left_anti")
    columns = [*one.columns, *[x for x in many.columns if x != key]]
    filled = lonely.select(
        "*", *[F.lit(None).cast(t).alias(x) for x, t in many.dtypes if x != key]
    )
    return matched.select(columns).unionByName(filled.select(columns))


def record_errors(records: DataFrame, errors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every record with its errors, one row per error and one for a record without any."""
    listed = errors.select("record_id", "error_code", "severity", "is_resolved")
    return one_to_many(records.select(*keep), listed, "record_id")


def batch_files(batches: DataFrame, files: DataFrame) -> DataFrame:
    """Every batch with its files, one row per file, and the number of files."""
    counts = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_files"))
    sized = batches.join(counts, "batch_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return one_to_many(sized, files.select("batch_id", "source_file_id", "original_filename"), "batch_id")


def with_group_size(
    df: DataFrame, keys: Sequence[str], out: str, spread_by: Sequence[str]
) -> DataFrame:
    """Rows per key on every row; a row with a NULL key counts as a group of one."""
    sized = with_key_stats(df, keys, {"_size": F.count(F.lit(1))}, spread_by)
    return sized.select(*df.columns, F.coalesce("_size", F.lit(1)).alias(out))


def with_household_size(records: DataFrame) -> DataFrame:
    """``household_count``: records of the same part and house; 1 without a house."""
    keyed = records.withColumns(
        {
            "_part": F.coalesce(F.nullif(c("part"), F.lit("")), F.lit("default")),
            "_house": F.nullif(c("norm_house"), F.lit("")),
        }
    )
    sized = with_group_size(keyed, ["_part", "_house"], "household_count", ["record_id"])
    return sized.drop("_part", "_house")


def hierarchy_rollup(facts: DataFrame, levels: Sequence[str], measures: dict) -> DataFrame:
    """Subtotals for every prefix of ``levels`` plus the total, with the level number."""
    aggs = [m.alias(n) for n, m in measures.items()]
    rolled = facts.rollup(*levels).agg(F.grouping_id().alias("_g"), *aggs)
    # grouping_id has one bit per rolled-up level: 0 is the finest, all ones the total.
    depth = len(levels) - F.bit_count("_g")
    return rolled.withColumn("depth", depth.cast("int")).drop("_g")
