"""Record, page and log views derived from the given tables.

The tables hold no register data, so names, codes and the rest of a record are
derived from ``part`` by arithmetic that Spark and DuckDB share. ``R_SQL`` is
the DuckDB text of :func:`register`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_devanagari, normalize_house, normalize_latin

c = F.col

LATIN_LETTERS = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI_LETTERS = "अबचदएफगहइजकलमनओपखरसतउवथयझठ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int) -> Column:
    return c("p_partkey") % n == 0


def _pick(n: int, *values: str) -> Column:
    out = None
    for i, v in enumerate(values[:-1]):
        test = c("p_partkey") % n == i
        out = F.when(test, v) if out is None else out.when(test, v)
    return out.otherwise(values[-1])


def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record view R of ``part``: one record per part."""
    key = c("p_partkey")
    drafts = table(spark, sf_dir, "part").select(
        key.alias("record_id"),
        key.alias("ingest_seq"),
        F.concat(F.lit("B"), (key % 7).cast("string")).alias("batch_id"),
        F.concat(F.lit("F"), (key % 20).cast("string")).alias("source_file_id"),
        F.lit(1).alias("source_page_number"),
        (key % 57).cast("int").alias("source_serial_number"),
        F.when(_every(17), None)
        .when(_every(29), "AB1")
        .otherwise(F.concat(F.lit("ABC"), F.lpad((key % 1900).cast("string"), 7, "0")))
        .alias("id_code"),
        F.when(~_every(53), c("p_name")).alias("name_lat"),
        F.when(~_every(53), F.translate("p_name", LATIN_LETTERS, DEVANAGARI_LETTERS)).alias("name_dev"),
        F.when(
            ~_every(23), F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.lower("p_type"))
        ).alias("rel_name_lat"),
        _pick(5, "MALE", "FEMALE", "OTHER", "UNKNOWN", "X").alias("gender"),
        _pick(4, "FATHER", "HUSBAND", "MOTHER", "UNKNOWN").alias("relation_type"),
        F.when(_every(31), None).when(_every(37), 125).otherwise(c("p_size") + 10).alias("age"),
        F.when(_every(41), "-").otherwise(F.concat(F.lit("H.No. "), (key % 7).cast("string"))).alias("house_number"),
        F.when(~_every(59), c("p_brand")).alias("ward"),
        F.when(~_every(59), c("p_type")).alias("part"),
        F.concat(F.lit("S"), (c("p_size") % 5).cast("string")).alias("area"),
        F.concat(F.lit("C"), (key % 9).cast("string")).alias("constituency"),
        ((key % 50).cast("double") / 100 + 0.5).alias("confidence"),
        F.lit("VALID").alias("status"),
    )
    null = F.lit(None).cast("string")
    return drafts.withColumns(
        {
            "rel_name_dev": F.translate("rel_name_lat", LATIN_LETTERS, DEVANAGARI_LETTERS),
            "norm_name_lat": normalize_latin(c("name_lat")),
            "norm_name_dev": normalize_devanagari(c("name_dev")),
            "norm_rel_lat": F.nullif(normalize_latin(c("rel_name_lat")), F.lit("")),
            "norm_rel_dev": null,
            "norm_house": normalize_house(c("house_number")),
        }
    )


R_SQL = f"""
WITH r0 AS (
  SELECT p_partkey AS record_id, p_partkey AS ingest_seq,
    'B' || CAST(p_partkey % 7 AS VARCHAR) AS batch_id,
    'F' || CAST(p_partkey % 20 AS VARCHAR) AS source_file_id,
    CAST(p_partkey % 57 AS INTEGER) AS source_serial_number,
    CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'AB1'
         ELSE 'ABC' || lpad(CAST(p_partkey % 1900 AS VARCHAR), 7, '0') END AS id_code,
    CASE WHEN p_partkey % 53 <> 0 THEN p_name END AS name_lat,
    CASE WHEN p_partkey % 53 <> 0
         THEN translate(p_name, '{LATIN_LETTERS}', '{DEVANAGARI_LETTERS}') END AS name_dev,
    CASE WHEN p_partkey % 23 <> 0
         THEN split_part(p_name, ' ', 2) || ' ' || lower(p_type) END AS rel_name_lat,
    CASE p_partkey % 5 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'OTHER'
         WHEN 3 THEN 'UNKNOWN' ELSE 'X' END AS gender,
    CASE p_partkey % 4 WHEN 0 THEN 'FATHER' WHEN 1 THEN 'HUSBAND' WHEN 2 THEN 'MOTHER'
         ELSE 'UNKNOWN' END AS relation_type,
    CASE WHEN p_partkey % 31 = 0 THEN NULL WHEN p_partkey % 37 = 0 THEN 125
         ELSE p_size + 10 END AS age,
    CASE WHEN p_partkey % 41 = 0 THEN '-' ELSE 'H.No. ' || CAST(p_partkey % 7 AS VARCHAR) END AS house_number,
    CASE WHEN p_partkey % 59 <> 0 THEN p_brand END AS ward,
    CASE WHEN p_partkey % 59 <> 0 THEN p_type END AS part,
    'S' || CAST(p_size % 5 AS VARCHAR) AS area,
    'C' || CAST(p_partkey % 9 AS VARCHAR) AS constituency,
    CAST(p_partkey % 50 AS DOUBLE) / 100 + 0.5 AS confidence,
    'VALID' AS status
  FROM part
), r AS (
  SELECT *, coalesce(lower(name_lat), '') AS norm_name_lat, coalesce(name_dev, '') AS norm_name_dev,
    rel_name_lat AS norm_rel_lat,
    CASE WHEN record_id % 41 = 0 THEN '-' ELSE CAST(record_id % 7 AS VARCHAR) END AS norm_house
  FROM r0
)
"""


def r_sql(select: str) -> str:
    """A query over R for DuckDB; may go on with more CTEs (start with ``, name AS (...)``)."""
    return R_SQL + select
