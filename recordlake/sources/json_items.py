"""JSON extracts: lenient recovery of an item array and items -> records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (
    code_by_rules,
    let,
    normalize_devanagari,
    normalize_house,
    normalize_id_code,
    normalize_latin,
    parse_int_prefix,
    trim_ws,
)
from ..functions.translit import to_latin
from ..operators.records import as_records, blank_null, record_key, with_defaults

# Keys an item may carry.
ITEM_KEYS = [
    "serial_number", "page_number", "epic_number", "epic", "voter_id",
    "name_hi", "name", "name_en", "relation_type", "relation_name_hi", "relation_name",
    "relation_name_en", "gender", "age", "house_number", "section_name", "area",
    "ward_number", "part_number", "is_deleted",
]
ITEM_SCHEMA = "array<struct<" + ",".join(f"{k}:string" for k in ITEM_KEYS) + ">>"


def item_array(c: Column) -> Column:
    """The JSON array of items inside a reply text, NULL when there is none.

    Takes an array, an object holding ``voters`` or ``records``, or a single
    object, with or without a code fence; a broken text is searched for the
    array inside it.
    """
    unfenced = F.regexp_replace(trim_ws(c), r"^```(?:json)?\s*|\s*```$", "")

    def valid(x: Column) -> Column:
        return F.when(F.try_parse_json(x).isNotNull(), x)

    def as_array(text: Column) -> Column:
        inner = F.coalesce(F.get_json_object(text, "$.voters"), F.get_json_object(text, "$.records"))
        wrapped = let(
            inner,
            lambda x: F.when(x.startswith("["), x).otherwise(F.concat(F.lit("["), text, F.lit("]"))),
        )
        return F.when(text.startswith("["), text).when(text.startswith("{"), wrapped)

    def find(text: Column) -> Column:
        inside = blank_null(F.regexp_extract(text, r"(?s)\[\s*\{.*\}\s*\]", 0))
        return F.coalesce(as_array(valid(text)), valid(inside))

    return let(unfenced, find)


def items_to_records(
    df: DataFrame, reply: str, page: str | None = None, metadata: Mapping[str, str] | None = None
) -> DataFrame:
    """One record per item of a reply; items marked deleted are REJECTED.

    The record id is made of what names the reply (its own record id, batch, file
    and page, as far as given), the reply and the item's position in it.
    """
    meta = metadata or {}
    exploded = df.select(
        *[c for c in df.columns if c != reply],
        F.xxhash64(reply).alias("_reply"),
        F.posexplode(F.from_json(item_array(F.col(reply)), ITEM_SCHEMA)).alias("_pos", "_item"),
    )

    def item(*names: str) -> Column:
        return F.coalesce(*[blank_null(F.col(f"_item.{n}")) for n in names])

    def default(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(meta.get(name)).cast("string"))

    position = F.col("_pos") + 1
    serial = parse_int_prefix(item("serial_number"))
    age = parse_int_prefix(item("age"))
    upper_rel = F.upper(F.coalesce(item("relation_type"), F.lit("")))
    upper_gen = F.upper(F.coalesce(item("gender"), F.lit("")))
    shaped = exploded.select(
        *[c for c in exploded.columns if not c.startswith("_") and c != "record_id"],
        record_key(
            *[F.col(x) for x in ("record_id", "batch_id", "source_file_id") if x in df.columns],
            F.col(page) if page else F.lit(1), F.col("_reply"), position,
        ).alias("record_id"),
        F.when(serial > 0, serial).otherwise(position).alias("source_serial_number"),
        F.coalesce(
            parse_int_prefix(item("page_number")), F.col(page).cast("int") if page else F.lit(1)
        ).alias("source_page_number"),
        blank_null(normalize_id_code(item("epic_number", "epic", "voter_id"))).alias("id_code"),
        blank_null(normalize_devanagari(item("name_hi", "name"))).alias("name_dev"),
        blank_null(normalize_latin(item("name_en"))).alias("_name_lat"),
        blank_null(normalize_devanagari(item("relation_name_hi", "relation_name"))).alias("rel_name_dev"),
        blank_null(normalize_latin(item("relation_name_en"))).alias("_rel_lat"),
        code_by_rules(upper_rel, fixed.JSON_RELATION_CODES, F.lit("OTHER")).alias("relation_type"),
        code_by_rules(upper_gen, fixed.JSON_GENDER_CODES, F.lit("UNKNOWN")).alias("gender"),
        F.when(age.between(1, 125), age).alias("age"),
        blank_null(normalize_house(item("house_number"))).alias("house_number"),
        default(item("section_name", "area"), "area").alias("area"),
        default(item("ward_number"), "ward").alias("ward"),
        default(item("part_number"), "part").alias("part"),
        F.coalesce(F.lower(item("is_deleted")) == "true", F.lit(False)).alias("_deleted"),
        F.to_json("_item").alias("raw"),
        position.cast("bigint").alias("ingest_seq"),
    )
    filled = shaped.withColumns(
        {
            "name_lat": F.coalesce("_name_lat", blank_null(to_latin(F.col("name_dev")))),
            "rel_name_lat": F.coalesce("_rel_lat", blank_null(to_latin(F.col("rel_name_dev")))),
            "confidence": F.lit(0.98),
            "photo_available": F.lit(True),
        }
    )
    complete = F.col("id_code").isNotNull() & F.coalesce("name_dev", "name_lat").isNotNull()
    status = F.when(F.col("_deleted"), "REJECTED").when(complete, "VALID").otherwise("WARNING")
    return as_records(with_defaults(filled.withColumn("status", status), meta))
