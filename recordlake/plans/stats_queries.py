"""Statistics over the record view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, stats
from .quality_queries import CHECKED_SQL, checked
from .registry import query
from .views import r_sql, register, table

c = F.col


@query(
    "system_stats",
    r_sql(
        """SELECT count(*) AS total_records, count(*) FILTER (gender = 'MALE') AS male,
        count(*) FILTER (gender = 'UNKNOWN') AS unknown_gender, count(*) FILTER (age <= 25) AS age_18_25,
        count(*) FILTER (age > 60) AS age_60_plus, count(DISTINCT constituency) AS total_constituencies,
        count(DISTINCT ward) AS total_wards,
        round(avg(CAST(confidence AS DECIMAL(18, 6))), 3)::DOUBLE AS average_confidence,
        (SELECT count(*) FROM orders) AS total_batches, (SELECT count(*) FROM documents) AS total_source_files FROM r"""
    ),
)
def system_stats(spark, sf_dir):
    found = stats.system_stats(
        register(spark, sf_dir), table(spark, sf_dir, "orders"), table(spark, sf_dir, "documents")
    )
    genders, ages = c("gender_distribution"), c("age_groups")
    return found.select(
        "total_records", genders["MALE"].alias("male"), genders["UNKNOWN"].alias("unknown_gender"),
        ages["18-25"].alias("age_18_25"), ages["60+"].alias("age_60_plus"), "total_constituencies", "total_wards",
        "average_confidence", "total_batches", "total_source_files",
    )


@query(
    "age_bands",
    r_sql(
        """SELECT CASE WHEN age <= 25 THEN '18-25' WHEN age <= 40 THEN '26-40' WHEN age <= 60 THEN '41-60' ELSE '60+' END
        AS age_band, count(*) AS n FROM r WHERE coalesce(age, 0) <> 0 GROUP BY age_band"""
    ),
)
def age_bands(spark, sf_dir):
    return stats.age_bands(register(spark, sf_dir))


@query(
    "share_of_total",
    r_sql(
        """SELECT gender, count(*) AS n, CAST(round(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE)) AS INTEGER) AS percent
        FROM r GROUP BY gender"""
    ),
)
def share_of_total(spark, sf_dir):
    return stats.share_of_total(register(spark, sf_dir), "gender")


@query(
    "error_breakdown",
    r_sql(CHECKED_SQL + "SELECT batch_id, error_code, count(*) AS n FROM e GROUP BY batch_id, error_code"),
)
def error_breakdown(spark, sf_dir):
    return stats.error_breakdown(quality.batch_errors(checked(spark, sf_dir)))
