"""Deep paging: a sorted result is stored once by ranges of its sort keys, and any page is read from the ranges it touches.

``ORDER BY ... OFFSET n`` sorts the result on every call and passes n rows through one task. Here the rows are
dealt by sampled quantiles of their sort keys, sorted inside each range and numbered there; the number of rows
per range gives every row its rank over the whole result. Nothing is sorted or numbered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

RANGE, PLACE, RANK = "range_no", "place", "rank"


def store(result: DataFrame, path: str, order: Sequence[Column], ranges: int = 200) -> None:
    """Write ``result`` below the shared folder ``path``, once.

    ``order`` (as for ``orderBy``) should end in a unique key: then a sort value of any frequency is split over
    ranges. Rows that are equal in all of ``order`` stay in one range, in an order that is fixed by this write.
    At most ``ranges`` ranges; choose their number so that one range fits a task. The counts are written last,
    so a write that was cut off is no stored result and can be repeated into a new folder.
    """
    taken = {RANGE, PLACE, RANK} & set(result.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are needed for the ranks; rename them")
    if not order or ranges < 1:
        raise ValueError("a sort key and at least one range are needed")
    dealt = result.repartitionByRange(ranges, *order).withColumn(RANGE, F.spark_partition_id())
    # The id counts the rows of a partition in its lower 33 bits.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = dealt.sortWithinPartitions(RANGE, *order).withColumn(PLACE, inside)
    rows.write.partitionBy(RANGE).parquet(f"{path}/rows")
    spark = result.sparkSession
    spark.createDataFrame([], rows.schema).write.parquet(f"{path}/columns")  # a result without rows has no other file
    counts = _rows(spark, path).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.parquet(f"{path}/counts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def _starts(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """(range, rows before it, rows in it) in order; at most as many as there are ranges."""
    out, before = [], 0
    for r in spark.read.schema(f"{RANGE} int, n long").parquet(f"{path}/counts").orderBy(RANGE).collect():
        out.append((r[RANGE], before, r["n"]))
        before += r["n"]
    return out


def _with_rank(rows: DataFrame, starts: list[tuple[int, int, int]]) -> DataFrame:
    known = rows.sparkSession.createDataFrame([(r, before) for r, before, _ in starts], f"{RANGE} int, before long")
    rank = (c("before") + c(PLACE) + 1).alias(RANK)
    columns = [x for x in rows.columns if x not in (RANGE, PLACE)]
    return rows.join(F.broadcast(known), RANGE).select(rank, *columns)


def total(spark: SparkSession, path: str) -> int:
    """Number of rows of the stored result."""
    return sum(n for _, _, n in _starts(spark, path))


def ranked(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their ``rank`` from 1; a stored result without rows gives none."""
    starts = _starts(spark, path)
    return _nothing(spark, path) if not starts else _with_rank(_rows(spark, path), starts)


def rows_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Rows ranked ``first`` to ``last`` (both included, from 1), read from the ranges that hold them, in no order."""
    met = [s for s in _starts(spark, path) if s[1] < last and s[1] + s[2] >= first]
    if not met:
        return _nothing(spark, path)
    rows = _rows(spark, path).where(c(RANGE).between(met[0][0], met[-1][0]))
    if len(met) == 1:  # the usual page; the bounds reach the scan
        rows = rows.where(c(PLACE).between(first - 1 - met[0][1], last - 1 - met[0][1]))
    return _with_rank(rows, met).where(c(RANK).between(first, last))


def page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows in the stored order, with ``rank``; empty beyond the last page."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return rows_between(spark, path, (number - 1) * size + 1, number * size).orderBy(RANK)


def _nothing(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path)
    columns = [x for x in rows.columns if x not in (RANGE, PLACE)]
    return rows.where(F.lit(False)).select(F.lit(0).cast("long").alias(RANK), *columns)
