"""Statistics, histograms, import reports and batch totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

GENDERS = ["MALE", "FEMALE", "OTHER", "UNKNOWN"]  # Fixed values, zero counts included.
AGE_BANDS = ["18-25", "26-40", "41-60", "60+"]  # Fixed values.


def age_band(age: Column) -> Column:
    """Band of an age; NULL for a missing or zero age."""
    return (
        F.when(F.coalesce(age, F.lit(0)) == 0, F.lit(None))
        .when(age <= 25, AGE_BANDS[0])
        .when(age <= 40, AGE_BANDS[1])
        .when(age <= 60, AGE_BANDS[2])
        .otherwise(AGE_BANDS[3])
    )


def age_bands(records: DataFrame) -> DataFrame:
    """Records per age band."""
    banded = records.select(age_band(c("age")).alias("age_band")).where(c("age_band").isNotNull())
    return banded.groupBy("age_band").agg(F.count(F.lit(1)).alias("n"))


def average_confidence(confidence: Column) -> Column:
    """Average to three places; a missing or zero confidence counts as 1. Exact whatever the row order."""
    exact = F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(1.0)).cast("decimal(18,6)")
    return F.round(F.avg(exact), 3).cast("double")


def _count_map(names: Sequence[str], test) -> Column:
    pairs = [x for n in names for x in (F.lit(n), F.count_if(test(n)))]
    return F.create_map(*pairs)


def system_stats(records: DataFrame, batches: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """One row: totals, gender and age maps, distinct constituencies and wards, average confidence."""
    band = age_band(c("age"))
    place = F.coalesce(
        *[F.nullif(c(x), F.lit("")) for x in ("constituency", "constituency_id") if x in records.columns]
    )
    stats = records.agg(
        F.count(F.lit(1)).alias("total_records"),
        _count_map(GENDERS, lambda g: c("gender") == g).alias("gender_distribution"),
        _count_map(AGE_BANDS, lambda b: band == b).alias("age_groups"),
        # Exact distinct counts go through a two-step aggregate, never one task's set.
        F.count_distinct(place).alias("total_constituencies"),
        F.count_distinct(F.nullif(c("ward"), F.lit(""))).alias("total_wards"),
        F.coalesce(average_confidence(c("confidence")), F.lit(1.0)).alias("average_confidence"),
    )
    for name, table in (("total_batches", batches), ("total_source_files", files)):
        if table is not None:
            stats = stats.withColumn(name, table.agg(F.count(F.lit(1))).scalar())
    return stats


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    """Rows per value and their rounded share of all rows in percent."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per value: the aggregate is already small
    return counts.select(by, "n", F.round(c("n") * 100 / total, 0).cast("int").alias("percent"))


def batch_totals(checked: DataFrame) -> DataFrame:
    """Per batch: processed, valid, flagged, warnings and final status.

    Dropped rows are not processed; their errors do not make a warning.
    """
    kept = ~c("dropped")
    warnings = F.sum(
        F.size(F.filter("issues", lambda i: ~i["code"].isin("MISSING_MANDATORY_NAME", "DUPLICATE_EPIC_IN_BATCH")))
    )
    per_batch = checked.groupBy("batch_id").agg(
        F.count_if(kept).alias("records_processed"),
        F.count_if(kept & (c("status") == "VALID")).alias("records_valid"),
        F.count_if(kept & (c("status") != "VALID")).alias("records_flagged"),
        F.coalesce(warnings, F.lit(0)).alias("warnings"),
        F.count_if(c("dropped")).alias("errors"),
    )
    doubtful = (c("records_flagged") > 0) | (c("warnings") > 0)
    return per_batch.withColumn(
        "final_status", F.when(doubtful, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    )


def error_breakdown(errors: DataFrame) -> DataFrame:
    """Errors per batch and code."""
    return errors.groupBy("batch_id", "error_code").agg(F.count(F.lit(1)).alias("n"))


def import_report(checked: DataFrame, errors: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per batch: totals, valid share, average confidence, duplicates and the error map."""
    per_code = error_breakdown(errors).groupBy("batch_id").agg(
        # One entry per rule code: bounded by the rule set.
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_code", "n")))).alias("error_breakdown"),
        F.sum("n").alias("total_errors"),
    )
    kept = checked.where(~c("dropped"))
    confidence = kept.groupBy("batch_id").agg(
        average_confidence(c("confidence")).alias("avg_confidence")
    )
    report = batch_totals(checked).join(confidence, "batch_id", "left").join(per_code, "batch_id", "left")
    codes = c("error_breakdown")
    duplicates = F.coalesce(
        F.try_element_at(codes, F.lit("DUPLICATE_EPIC")),
        F.try_element_at(codes, F.lit("DUPLICATE_EPIC_IN_BATCH")),
        F.lit(0),
    )
    share = F.round(c("records_valid") * 100 / c("records_processed"), 1)
    report = report.withColumns(
        {
            "valid_pct": F.when(c("records_processed") > 0, share).otherwise(100.0),
            "avg_confidence": F.coalesce("avg_confidence", F.lit(0.98)),
            "duplicates_count": duplicates,
            "total_errors": F.coalesce("total_errors", F.lit(0)),
        }
    )
    if files is not None:
        per_batch = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
        report = report.join(per_batch, "batch_id", "left").withColumn("total_files", F.coalesce("_n", F.lit(0))).drop("_n")
    return report


def first_errors(errors: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` errors of every batch; tasks discard the rest before the shuffle."""
    w = Window.partitionBy("batch_id").orderBy("ingest_seq", "error_code")
    return errors.withColumn("error_no", F.row_number().over(w)).where(c("error_no") <= n)
