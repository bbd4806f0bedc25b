"""Rows of any layout -> canonical register records (header resolution, coding, defaults)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (
    blank_to_null,
    code_gender,
    code_relation,
    detect_script,
    let,
    normalize_devanagari,
    normalize_house,
    normalize_id_code,
    normalize_latin,
    parse_int_prefix,
    squash_text,
    trim_ws,
)
from ..functions.translit import first_devanagari, to_latin
from .keyed import filter_late

TABULAR_CONFIDENCE = 0.98  # Fixed value.

# Column name and type of the record table, in order.
RECORD_SCHEMA = {
    "record_id": "string",
    "batch_id": "string",
    "source_file_id": "string",
    "source_page_number": "int",
    "source_serial_number": "int",
    "id_code": "string",
    "name_lat": "string",
    "name_dev": "string",
    "norm_name_lat": "string",
    "norm_name_dev": "string",
    "relation_type": "string",
    "rel_name_lat": "string",
    "rel_name_dev": "string",
    "norm_rel_lat": "string",
    "norm_rel_dev": "string",
    "gender": "string",
    "age": "int",
    "house_number": "string",
    "norm_house": "string",
    "ward": "string",
    "part": "string",
    "area": "string",
    "polling_place": "string",
    "constituency": "string",
    "district": "string",
    "region": "string",
    "photo_available": "boolean",
    "confidence": "double",
    "status": "string",
    "raw": "string",
    "ingest_seq": "bigint",
}


def blank_null(c: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(c, F.lit(""))


def made_null(c: Column) -> Column:
    """NULL for the empty string of a costly expression, which ``nullif`` alone would evaluate twice inside other expressions."""
    return let(c, blank_null)


def as_records(df: DataFrame) -> DataFrame:
    """Exactly the record columns, typed; columns the input lacks become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
            for n, t in RECORD_SCHEMA.items()
        ]
    )


def record_key(*parts: Column) -> Column:
    """Deterministic record id: the same input row gets the same id on every retry."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


# ------------------------------------------------------- header resolution
def matching_columns(
    columns: Sequence[str], field: str, mapping: Mapping[str, str] | None = None
) -> list[str]:
    """Input columns that may hold a field: explicit, then exact alias, then squashed alias."""
    aliases = fixed.FIELD_ALIASES[field]
    squashed = {}
    for c in columns:
        squashed.setdefault(squash_text(c), []).append(c)
    found = [c for c in [(mapping or {}).get(field)] if c in columns]
    found += [a for a in aliases if a in columns]
    for a in aliases:
        found += squashed.get(squash_text(a), [])
    return list(dict.fromkeys(found))


def resolve(
    columns: Sequence[str], field: str, mapping: Mapping[str, str] | None = None
) -> Column:
    """First non-blank value among the columns that may hold the field, else NULL."""
    names = matching_columns(columns, field, mapping)
    values = [blank_to_null(F.col("`" + n.replace("`", "``") + "`").cast("string")) for n in names]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def suggest_mapping(headers: Sequence[str]) -> dict[str, str]:
    """Suggested field -> header, for a preview."""
    out: dict[str, str] = {}
    for h in headers:
        field = _hinted_field(h)
        if field:
            out.setdefault(field, h)
    return out


def _hinted_field(header: str) -> str | None:
    clean = squash_text(header)
    words = header.lower().replace("_", " ").replace("-", " ").replace(".", " ").split()
    for field, hints in fixed.HEADER_WORD_HINTS:
        if any(h in words for h in hints):
            return field
    return next((f for f, hints in fixed.HEADER_HINTS if any(h in clean for h in hints)), None)


def suggest_fields(headers: DataFrame, column: str = "header") -> DataFrame:
    """The same suggestion for a whole table of headers: adds ``field`` (NULL when none)."""
    clean = F.regexp_replace(F.lower(column), r"[\s_\-.]", "")
    words = F.split(F.lower(column), r"[\s_\-.]+")
    field = None
    for name, hints in fixed.HEADER_WORD_HINTS:
        hit = F.arrays_overlap(words, F.array(*[F.lit(h) for h in hints]))
        field = F.when(hit, name) if field is None else field.when(hit, name)
    for name, hints in fixed.HEADER_HINTS:
        field = field.when(clean.rlike("|".join(hints)), name)
    return headers.withColumn("field", field)


# -------------------------------------------------------- canonical records
def complete_names(lat: Column, dev: Column, auto: Column) -> Column:
    """struct(lat, dev): each script as given, the missing one transliterated."""
    given = F.struct(
        lat.alias("lat"), dev.alias("dev"), auto.alias("auto"),
        (detect_script(auto) == "devanagari").alias("auto_is_dev"),
    )

    def sources(g: Column) -> Column:
        from_dev = F.coalesce(g["dev"], F.when(g["lat"].isNull() & g["auto_is_dev"], g["auto"]))
        from_lat = F.coalesce(g["lat"], F.when(g["dev"].isNull() & ~g["auto_is_dev"], g["auto"]))
        return F.struct(
            made_null(normalize_devanagari(from_dev)).alias("dev"),
            made_null(normalize_latin(from_lat)).alias("lat"),
        )

    def filled(n: Column) -> Column:
        return F.struct(
            F.coalesce(n["lat"], F.when(n["dev"].isNotNull(), made_null(to_latin(n["dev"])))).alias("lat"),
            F.coalesce(
                n["dev"], F.when(n["lat"].isNotNull(), made_null(first_devanagari(n["lat"]))), n["lat"]
            ).alias("dev"),
        )

    return let(let(given, sources), filled)


def canonical_records(
    df: DataFrame,
    mapping: Mapping[str, str] | None = None,
    metadata: Mapping[str, str] | None = None,
    seq: str = "ingest_seq",
    keep: Sequence[str] = ("batch_id", "source_file_id"),
) -> DataFrame:
    """Turn tabular rows of any header layout into records; rows without a name are dropped.

    ``seq`` is the 1-based position of the row in its file, used as serial
    number where none is given. ``metadata`` fills fields the row leaves out.
    """
    meta = metadata or {}
    carried = [c for c in keep if c in df.columns]
    columns = [c for c in df.columns if c not in (*carried, seq)]

    def pick(field: str) -> Column:
        return resolve(columns, field, mapping)

    def pick_or_meta(field: str) -> Column:
        return F.coalesce(pick(field), F.lit(meta.get(field)).cast("string"))

    picked = df.select(
        *carried,
        F.col(seq).cast("bigint").alias("ingest_seq"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("raw"),
        *[
            pick(f).alias(f"_{f}")
            for f in (
                "serial", "id_code", "name_auto", "name_dev", "name_lat", "relation_type",
                "rel_auto", "rel_dev", "rel_lat", "father", "husband", "mother",
                "gender", "age", "house",
            )
        ],
        *[pick_or_meta(f).alias(f) for f in ("ward", "part", "area", "constituency", "district")],
    )
    c = F.col
    # A pair of relative names is used as given; otherwise one value decides by its script.
    both = c("_rel_dev").isNotNull() & c("_rel_lat").isNotNull()
    rel_one = F.when(~both, F.coalesce("_rel_auto", "_rel_dev", "_rel_lat"))
    named_by = complete_names(c("_name_lat"), c("_name_dev"), trim_ws(c("_name_auto")))
    related_by = complete_names(
        F.when(both, c("_rel_lat")), F.when(both, c("_rel_dev")), trim_ws(rel_one)
    )
    picked = picked.withColumns({"_name": named_by, "_rel": related_by})
    coded = picked.select(
        *carried, "ingest_seq", "raw", "ward", "part", "area", "constituency", "district",
        parse_int_prefix(c("_serial"), c("ingest_seq").cast("int")).alias("source_serial_number"),
        made_null(normalize_id_code(c("_id_code"))).alias("id_code"),
        c("_name.lat").alias("name_lat"),
        c("_name.dev").alias("name_dev"),
        code_relation(c("_relation_type"), c("_father"), c("_husband"), c("_mother")).alias("relation_type"),
        c("_rel.lat").alias("rel_name_lat"),
        c("_rel.dev").alias("rel_name_dev"),
        code_gender(c("_gender")).alias("gender"),
        parse_int_prefix(c("_age")).alias("age"),
        made_null(normalize_house(c("_house"))).alias("house_number"),
    )
    named = filter_late(coded, c("name_lat").isNotNull() | c("name_dev").isNotNull())
    return as_records(with_defaults(named, meta).withColumn("status", tabular_status()))


def tabular_status() -> Column:
    """First status of a tabular record: WARNING without an id code or an adult age."""
    doubtful = F.col("id_code").isNull() | F.coalesce(F.col("age") < 18, F.lit(True))
    return F.when(doubtful, "WARNING").otherwise("VALID")


def with_defaults(df: DataFrame, metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Fill what storage always holds: normalised columns, page and serial, region, confidence."""
    meta = metadata or {}
    have = set(df.columns)
    c = F.col

    def text(name: str) -> Column:
        return blank_null(c(name)) if name in have else F.lit(None).cast("string")

    def number(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(c(name), F.lit(0)), default) if name in have else default

    name_lat = F.coalesce(text("name_lat"), made_null(to_latin(text("name_dev"))))
    out = df.withColumns(
        {
            "name_lat": name_lat,
            "relation_type": F.coalesce(text("relation_type"), F.lit("UNKNOWN")),
            "gender": F.coalesce(text("gender"), F.lit("UNKNOWN")),
            "source_page_number": number("source_page_number", F.lit(1)),
            "source_serial_number": number("source_serial_number", F.lit(1)),
            "polling_place": F.coalesce(text("polling_place"), F.lit(meta.get("polling_place")).cast("string")),
            "region": F.coalesce(text("region"), F.lit(meta.get("region", "INDIA"))),
            "photo_available": F.coalesce(c("photo_available"), F.lit(False))
            if "photo_available" in have
            else F.lit(False),
            "confidence": F.coalesce(c("confidence"), F.lit(1.0))
            if "confidence" in have
            else F.lit(TABULAR_CONFIDENCE),
        }
    )
    have_after = set(out.columns)
    if "ingest_seq" in have_after and "record_id" not in have_after:
        parts = [c(x) for x in ("batch_id", "source_file_id") if x in have_after]
        out = out.withColumn("record_id", record_key(*parts, c("ingest_seq")))

    def norm(existing: str, made: Column) -> Column:
        return F.coalesce(blank_null(c(existing)), made) if existing in have else made

    null = F.lit(None).cast("string")
    rel_lat = c("rel_name_lat") if "rel_name_lat" in have else null
    rel_dev = c("rel_name_dev") if "rel_name_dev" in have else null
    return out.withColumns(
        {
            "norm_name_lat": norm("norm_name_lat", normalize_latin(c("name_lat"))),
            "norm_name_dev": norm("norm_name_dev", normalize_devanagari(c("name_dev"))),
            "norm_rel_lat": norm("norm_rel_lat", made_null(normalize_latin(rel_lat))),
            "norm_rel_dev": norm("norm_rel_dev", made_null(normalize_devanagari(rel_dev))),
            "norm_house": norm("norm_house", made_null(normalize_house(c("house_number")))),
        }
    )
