"""Per-key lookups and carry-forward that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1000  # at most this many keys take the broadcast path, whatever the data size
SPREAD = 256


def filter_late(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them twice.

    A plain filter is pushed below the projection that makes its columns and
    repeats their expressions there. Use it for cheap conditions on stored
    columns and this one for conditions on costly derived columns.
    """
    kept = df.select("*", F.explode(F.when(condition, F.array(F.lit(1)))).alias("_keep"))
    return kept.drop("_keep")


def key_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """One row per non-null key with the given aggregates and the row count ``key_rows``."""
    present = df
    for k in keys:
        present = present.where(F.col(k).isNotNull())
    return present.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("key_rows"), *[c.alias(n) for n, c in stats.items()]
    )


def attach_by_key(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    spread_by: Sequence[str],
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Left join one row per key onto many rows, without piling a hot key into one task.

    ``per_key`` comes from :func:`key_stats`. Keys with at least ``hot_rows``
    rows, the ``HOT_KEYS`` largest at most, are broadcast. Their rows, and rows
    with a null key, then carry a salt into the shuffle join that serves all
    remaining keys, so every key gets its values and none gathers in one task.
    """
    hot = (
        per_key.where(F.col("key_rows") >= hot_rows)
        .orderBy(F.col("key_rows").desc(), *keys)
        .limit(HOT_KEYS)
        .select(*[F.col(k).alias(f"_hot_{k}") for k in keys],
                F.struct(*values).alias("_hot"))
    )
    on_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    marked = df.join(F.broadcast(hot), on_hot, "left").drop(*[f"_hot_{k}" for k in keys])
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)) + 1
    marked = marked.withColumn(
        "_salt", F.when(F.col("_hot").isNotNull() | missing, spread).otherwise(F.lit(0).cast("long"))
    )
    # pmod(n, 1) is 0 for every row but not a literal, so the salt stays a join key.
    cold = per_key.select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys],
        F.pmod(F.col("key_rows"), F.lit(1)).cast("long").alias("_cold_salt"),
        F.struct(*values).alias("_cold"),
    )
    on_cold = [F.col(k) == F.col(f"_cold_{k}") for k in keys] + [F.col("_salt") == F.col("_cold_salt")]
    joined = marked.join(cold, on_cold, "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return joined.select(
        *[F.col(c) for c in df.columns], *[found[v].alias(v) for v in values]
    )


def with_key_stats(
    df: DataFrame,
    keys: Sequence[str],
    stats: Mapping[str, Column],
    spread_by: Sequence[str],
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Add per-key aggregates to every row: a window without its one-task-per-key sort."""
    per_key = key_stats(df, keys, stats)
    return attach_by_key(df, per_key, keys, list(stats), spread_by, hot_rows)


def carry_forward(
    df: DataFrame, group: str, order: str, value: str, out: str, block_rows: int = 10_000
) -> DataFrame:
    """Fill ``out`` with the last non-null ``value`` at or before the row's ``order`` number.

    A group is cut into blocks of consecutive order numbers. Each block is
    filled on its own; only the blocks' last values are ordered per group.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    in_block = (
        Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = blocked.withColumn("_local", F.last(value, ignorenulls=True).over(in_block))
    ends = blocked.groupBy(group, "_block").agg(
        F.max(
            F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
        )["v"].alias("_end")
    )
    earlier = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        group, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_before")
    )
    joined = local.join(before, [group, "_block"], "left")
    return joined.select(
        *[F.col(c) for c in df.columns], F.coalesce("_local", "_before").alias(out)
    )
