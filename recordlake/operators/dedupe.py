"""Duplicate clusters and household groups, as summary rows plus member rows.

A cluster may hold a large share of all records, so members are never gathered
into one array: clusters are partial aggregates, members are records that carry
their cluster's key and size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, normalize_house, normalize_id_code, normalize_latin
from .keyed import attach_by_key, key_stats, with_key_stats
from .records import blank_null

c = F.col

# Cluster types and their confidence.
EXACT_ID, SERIAL, COMPOSITE, FILE = (
    "DUPLICATE_EPIC",
    "DUPLICATE_SERIAL_PART",
    "POSSIBLE_DUPLICATE_RECORD",
    "REPEATED_IMPORT",
)
TYPES = [EXACT_ID, SERIAL, COMPOSITE, FILE]
EXACT_ID_CONFIDENCE, SERIAL_CONFIDENCE, FILE_CONFIDENCE = 0.99, 0.95, 1.0
COMPOSITE_SEVERAL_CODES, COMPOSITE_ONE_CODE = 0.75, 0.88


# -------------------------------------------------------------- cluster keys
def id_key() -> Column:
    """Normalised id code, NULL when blank."""
    return blank_null(normalize_id_code(c("id_code")))


def serial_key() -> Column:
    """Serial number within its file, or within its part where no file is known."""
    scope = F.when(c("source_file_id").isNotNull(), F.concat(F.lit("file_"), c("source_file_id").cast("string")))
    scope = F.coalesce(scope, F.concat(F.lit("part_"), F.coalesce(blank_null(c("part")), F.lit("default"))))
    serial = F.nullif(c("source_serial_number"), F.lit(0))
    return F.concat(scope, F.lit("_s_"), serial.cast("string"))


def composite_key() -> Column:
    """Name + relative + house + two-year age bracket; NULL unless both names have 3 characters."""
    name = joined(F.coalesce(blank_null(c("norm_name_lat")), normalize_latin(c("name_lat"))))
    rel = joined(F.coalesce(blank_null(c("norm_rel_lat")), normalize_latin(c("rel_name_lat"))))
    house = F.coalesce(blank_null(c("norm_house")), normalize_house(c("house_number")))
    bracket = F.coalesce((F.floor(F.nullif(c("age"), F.lit(0)) / 2) * 2).cast("string"), F.lit("noage"))
    key = F.concat(name, F.lit("_rel_"), rel, F.lit("_h_"), house, F.lit("_age_"), bracket)
    return F.when((F.length(name) >= 3) & (F.length(rel) >= 3), key)


# ------------------------------------------------------------------ clusters
def _clusters(
    df: DataFrame, key: Column, kind: str, confidence: Column, member: str, extra: Mapping[str, Column]
) -> DataFrame:
    grouped = key_stats(
        df.withColumn("cluster_key", key), ["cluster_key"], {"first_member": F.min(member), **extra}
    )
    return grouped.where(c("key_rows") > 1).select(
        F.lit(kind).alias("duplicate_type"),
        "cluster_key",
        c("key_rows").alias("n_members"),
        "first_member",
        confidence.cast("double").alias("confidence"),
    )


def exact_id_clusters(records: DataFrame) -> DataFrame:
    """Records that share a normalised id code."""
    return _clusters(records, id_key(), EXACT_ID, F.lit(EXACT_ID_CONFIDENCE), "record_id", {})


def serial_clusters(records: DataFrame) -> DataFrame:
    """Records that share a serial number in the same file or part."""
    return _clusters(records, serial_key(), SERIAL, F.lit(SERIAL_CONFIDENCE), "record_id", {})


def composite_clusters(records: DataFrame) -> DataFrame:
    """Records alike in name, relative, house and age bracket; same name alone never counts."""
    code = blank_null(c("id_code"))
    several = F.min(code) != F.max(code)  # more than one distinct code, without a distinct count
    confidence = F.when(F.coalesce(c("_several"), F.lit(False)), COMPOSITE_SEVERAL_CODES).otherwise(COMPOSITE_ONE_CODE)
    return _clusters(records, composite_key(), COMPOSITE, confidence, "record_id", {"_several": several})


def repeated_imports(files: DataFrame) -> DataFrame:
    """Source files with identical content."""
    return _clusters(files, c("file_hash_sha256"), FILE, F.lit(FILE_CONFIDENCE), "source_file_id", {})


def cluster_files(records: DataFrame, key: Column) -> DataFrame:
    """Distinct source files per cluster, one row each."""
    keyed = records.withColumn("cluster_key", key)
    sizes = key_stats(keyed, ["cluster_key"], {}).where(c("key_rows") > 1)
    pairs = keyed.where(c("cluster_key").isNotNull()).select("cluster_key", "source_file_id").distinct()
    return pairs.join(sizes.select("cluster_key"), "cluster_key", "left_semi")


def cluster_members(df: DataFrame, key: Column, member: str = "record_id") -> DataFrame:
    """One row per member of a cluster of two or more, with the cluster size and first member."""
    keyed = df.withColumn("cluster_key", key)
    stats = {"_n": F.count(F.lit(1)), "_first": F.min(member)}
    sized = with_key_stats(keyed, ["cluster_key"], stats, [member])
    return sized.where(c("_n") > 1).select(
        "cluster_key", member, c("_n").alias("n_members"), (c(member) == c("_first")).alias("is_first")
    )


def all_clusters(records: DataFrame, files: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Clusters of every type (or one) in one table."""
    parts = {
        EXACT_ID: exact_id_clusters(records),
        SERIAL: serial_clusters(records),
        COMPOSITE: composite_clusters(records),
    }
    for name, part in parts.items():
        parts[name] = part.withColumn("first_member", c("first_member").cast("string"))
    if files is not None:
        parts[FILE] = repeated_imports(files).withColumn("first_member", c("first_member").cast("string"))
    chosen = [p for name, p in parts.items() if kind in (None, name)]
    out = chosen[0]
    for p in chosen[1:]:
        out = out.unionByName(p)
    return out


def cluster_summary(clusters: DataFrame) -> DataFrame:
    """Clusters and members per type in one row each, zeros included."""
    kinds = clusters.sparkSession.createDataFrame([(t,) for t in TYPES], "duplicate_type string")
    counts = clusters.groupBy("duplicate_type").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("n_members").alias("_m")
    )
    return kinds.join(counts, "duplicate_type", "left").select(
        "duplicate_type",
        F.coalesce("_n", F.lit(0)).alias("n_clusters"),
        F.coalesce("_m", F.lit(0)).alias("n_members"),
    )


# --------------------------------------------------------- documented keys
def mark_duplicate_of(records: DataFrame, key: Column | None = None, order: str = "ingest_seq") -> DataFrame:
    """``duplicate_of``: the earliest record with the same id code (6 characters or more), else NULL."""
    code = F.upper(F.trim(c("id_code")))
    key = key if key is not None else F.when(F.length(code) >= 6, code)
    first = {"_first": F.min(F.struct(order, "record_id"))["record_id"]}
    marked = with_key_stats(records.withColumn("_key", key), ["_key"], first, ["record_id"])
    return marked.select(
        *records.columns, F.when(c("_first") != c("record_id"), c("_first")).alias("duplicate_of")
    )


def local_key() -> Column:
    """Constituency, part and serial: the documented second key."""
    parts = [c("constituency"), c("part"), c("source_serial_number").cast("string")]
    return F.when(
        parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull(), F.concat_ws("|", *parts)
    )


def age_range_matches(records: DataFrame, keys: Sequence[str], age: str = "age", within: int = 1) -> DataFrame:
    """Records with another record of equal keys and an age at most ``within`` years apart.

    Adds ``n_partners`` and one ``partner``: the smallest matching id, or for
    the record that has it the largest. Records are counted per key and age
    first and the neighbouring ages are added up, so no pairs are formed
    however many records share a key.
    """
    present = records.where(c(age).isNotNull())
    per_age = key_stats(
        present, [*keys, age], {"_lo": F.min("record_id"), "_hi": F.max("record_id")}
    )
    shifts = F.explode(F.array(*[F.lit(d) for d in range(-within, within + 1)]))
    spread = per_age.select(*keys, age, "key_rows", "_lo", "_hi", shifts.alias("_d")).select(
        *keys,
        (c(age) + c("_d")).alias(age),
        c("key_rows").alias("_rows"),
        F.when(c("_d") == 0, c("key_rows")).otherwise(0).alias("_own"),
        "_lo",
        "_hi",
    )
    near = spread.groupBy(*keys, age).agg(
        F.sum("_rows").alias("_near"),
        F.sum("_own").alias("key_rows"),
        F.min("_lo").alias("_first"),
        F.max("_hi").alias("_last"),
    )
    near = near.where((c("_near") > 1) & (c("key_rows") > 0))
    joined = attach_by_key(present, near, [*keys, age], ["_near", "_first", "_last"], ["record_id"])
    return joined.where(c("_near").isNotNull()).select(
        *records.columns,
        (c("_near") - 1).alias("n_partners"),
        F.when(c("_first") != c("record_id"), c("_first")).otherwise(c("_last")).alias("partner"),
    )


# --------------------------------------------------------------- households
NO_HOUSE = ["", "-", "0"]  # Fixed values: house numbers that name no house.


def _house_key() -> Column:
    house = c("norm_house")
    return F.when(~F.coalesce(house, F.lit("")).isin(NO_HOUSE), house)


def household_stats(records: DataFrame) -> DataFrame:
    """One row per (ward, part, house): members and head (oldest; ties and no ages: first by serial)."""
    oldest = F.struct(
        F.coalesce(c("age"), F.lit(0)), -c("source_serial_number"), -c("ingest_seq")
    )
    keyed = records.withColumn("norm_house", _house_key()).where(c("norm_house").isNotNull())
    return keyed.groupBy("ward", "part", "norm_house").agg(
        F.count(F.lit(1)).alias("total_members"),
        F.max_by("record_id", oldest).alias("head_record_id"),
        F.max("age").alias("head_age"),
    )


def household_members(records: DataFrame) -> DataFrame:
    """Every record with its household's size and head; without a house it stands alone."""
    keyed = records.withColumns(
        {
            "_house": _house_key(),
            "_ward": F.coalesce(c("ward"), F.lit("")),
            "_part": F.coalesce(c("part"), F.lit("")),
        }
    )
    oldest = F.struct(
        F.coalesce(c("age"), F.lit(0)), -c("source_serial_number"), -c("ingest_seq")
    )
    stats = {"_n": F.count(F.lit(1)), "_head": F.max_by("record_id", oldest)}
    joined = with_key_stats(keyed, ["_ward", "_part", "_house"], stats, ["record_id"])
    head = F.coalesce("_head", "record_id")
    return joined.select(
        *records.columns,
        F.coalesce("_n", F.lit(1)).alias("total_members"),
        head.alias("head_record_id"),
        (head == c("record_id")).alias("is_head"),
    )
