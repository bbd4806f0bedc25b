"""Audit and search logs, redaction, masked export, record changes with their audit rows."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from ..functions import fixed
from ..functions.text import mask_house, mask_id_code, normalize_devanagari, normalize_house, normalize_id_code, normalize_latin

c = F.col

KEEP_AUDIT, KEEP_SEARCHES, DEFAULT_LIMIT = 500, 200, 100  # Fixed values.


# ------------------------------------------------------------------ reading
def keep_latest(log: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of a log (retention)."""
    return log.orderBy(*order).limit(n)


def keep_latest_per(log: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key; tasks discard the rest before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def query_log(
    log: DataFrame,
    action: str | None = None,
    entity_type: str | None = None,
    user_id: object | None = None,
    at: str = "created_at",
    row_id: str = "id",
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Newest matching entries: action and entity without regard to case, user as is."""
    if action is not None:
        log = log.where(F.lower("action") == action.lower())
    if entity_type is not None:
        log = log.where(F.lower("entity_type") == entity_type.lower())
    if user_id is not None:
        log = log.where(c("user_id") == F.lit(user_id))
    return log.orderBy(c(at).desc(), c(row_id).desc()).limit(limit)


def search_log(log: DataFrame, text: str) -> DataFrame:
    """Entries whose action, entity or changes contain a text."""
    hit = F.lit(False)
    for name in ("action", "entity_type", "entity_id", "changes"):
        hit = hit | F.lower(F.coalesce(c(name).cast("string"), F.lit(""))).contains(text.lower())
    return log.where(hit)


# Fixed values: (class, fragments of the action), tried in this order.
ACTION_CLASSES = [
    ("auth", ["LOGIN", "AUTH"]),
    ("destructive", ["DELETE", "REJECT", "FAILED"]),
    ("validation", ["VALIDATION", "VERIFIED"]),
    ("import", ["UPLOAD", "IMPORT"]),
]


def action_class(action: Column) -> Column:
    """auth, destructive, validation, import or other."""
    upper = F.upper(action)
    out = None
    for name, parts in ACTION_CLASSES:
        hit = upper.rlike("|".join(parts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


# ---------------------------------------------------------------- redaction
def redact_columns(df: DataFrame) -> DataFrame:
    """Redact secrets in every nested column of a table, driven by the schema."""
    out = []
    for f in df.schema.fields:
        if _is_secret(f.name):
            out.append(F.lit(fixed.REDACTED).alias(f.name))
        else:
            out.append(_redact(c(f"`{f.name}`"), f.dataType).alias(f.name))
    return df.select(*out)


def _is_secret(name: str) -> bool:
    import re

    return re.search(fixed.SECRET_KEYS, name, re.IGNORECASE) is not None


def _redact(value: Column, dtype: DataType) -> Column:
    if isinstance(dtype, StructType):
        fields = [
            (F.lit(fixed.REDACTED) if _is_secret(f.name) else _redact(value[f.name], f.dataType)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, ArrayType):
        return F.transform(value, lambda x: _redact(x, dtype.elementType))
    if isinstance(dtype, MapType):
        secret = lambda k: k.cast("string").rlike(f"(?i){fixed.SECRET_KEYS}")
        if dtype.valueType.simpleString() == "string":
            return F.transform_values(value, lambda k, v: F.when(secret(k), fixed.REDACTED).otherwise(v))
        # A typed map cannot hold the replacement text, so a secret becomes NULL.
        return F.transform_values(
            value, lambda k, v: F.when(~secret(k), _redact(v, dtype.valueType))
        )
    if isinstance(dtype, VariantType):
        return F.try_parse_json(redact_json(F.to_json(value)))
    return value


_PIECE = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]|[^"\[\]{}\s,:]+|[\s,:]+', re.S)


def redact_text(text: str | None, keys: str = fixed.SECRET_KEYS) -> str | None:
    """A JSON text in which the value of every key that names a secret is replaced, at any depth.

    Keys are compared as they read, escapes undone. All else stays as written; a text that is not
    JSON, or too deep to be read, is replaced whole.
    """
    if text is None:
        return None
    hidden = json.dumps(fixed.REDACTED)
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return hidden
    secret, out, pieces = re.compile(keys, re.I), [], _PIECE.findall(text)
    at = 0
    while at < len(pieces):
        piece = pieces[at]
        out.append(piece)
        at += 1
        is_key = piece[0] == '"' and at < len(pieces) and ":" in pieces[at]
        if is_key and secret.search(json.loads(piece, strict=False)):
            out += [pieces[at], hidden]
            at, depth = at + 1, 0
            while True:
                depth += (pieces[at] in "{[") - (pieces[at] in "}]")
                at += 1
                if not depth:
                    break
    return "".join(out)


def redact_json(c_json: Column, keys: str = fixed.SECRET_KEYS) -> Column:
    """:func:`redact_text` on a column, in Arrow batches: no built-in function follows nesting to any depth."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact_text(t, keys), na_action="ignore")

    return redacted(c_json)


# --------------------------------------------------------------- export
# Export headers and the record column behind each.
EXPORT_COLUMNS = {
    "Serial No": "source_serial_number",
    "EPIC Number": "id_code",
    "Name (Hindi)": "name_dev",
    "Name (English)": "name_lat",
    "Relation": "relation_type",
    "Relative Name (Hindi)": "rel_name_dev",
    "Relative Name (English)": "rel_name_lat",
    "Gender": "gender",
    "Age": "age",
    "House No": "house_number",
    "Ward": "ward",
    "Part No": "part",
    "Assembly Constituency": "constituency",
    "Validation Status": "status",
}


def export_projection(records: DataFrame, masked: bool = True, headers: bool = True) -> DataFrame:
    """The export columns as text, blanks for missing values; codes and houses masked by default."""
    values: Mapping[str, Column] = {
        name: F.coalesce(
            (F.nullif(c(name), F.lit(0)) if name == "age" else c(name)).cast("string"), F.lit("")
        )
        for name in EXPORT_COLUMNS.values()
    }
    if masked:
        values = {**values, "id_code": mask_id_code(values["id_code"]), "house_number": mask_house(values["house_number"])}
    return records.select(
        *[values[name].alias(header if headers else name) for header, name in EXPORT_COLUMNS.items()]
    )


def write_export(records: DataFrame, path: str, masked: bool = True) -> None:
    """Write the export as CSV part files, each with the header and CRLF line ends."""
    (
        export_projection(records, masked)
        .write.mode("overwrite")
        .option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("lineSep", "\r\n")
        .option("emptyValue", "")
        .csv(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write a report as JSON lines."""
    report.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# --------------------------------------------------------------- changes
def apply_changes(
    records: DataFrame, changes: DataFrame, fields: Sequence[str], key: str = "record_id"
) -> tuple[DataFrame, DataFrame]:
    """Create, update and delete records from a change table; returns (records, audit rows).

    ``changes`` has the key, ``op`` (CREATE, UPDATE, DELETE), ``changed_at``,
    ``change_id`` and any of ``fields`` (NULL leaves a field as it is). The
    latest change per record and field counts; a delete as latest change wins.
    """
    at = F.struct("changed_at", "change_id")
    latest = changes.groupBy(key).agg(
        F.max_by("op", at).alias("_op"),
        *[
            F.max_by(F.when(c(f).isNotNull(), c(f)), F.when(c(f).isNotNull(), at)).alias(f"_{f}")
            for f in fields
        ],
    )
    known = records.withColumn("_known", F.lit(True))
    joined = known.join(latest, key, "full")
    changed = joined.where(
        F.coalesce(c("_op") != "DELETE", F.lit(True)) & (c("_known") | (c("_op") == "CREATE"))
    )
    updated = changed.select(
        *[F.coalesce(c(f"_{x}"), c(x)).alias(x) if x in fields else c(x) for x in records.columns]
    )
    entry = F.struct(*[c(f) for f in fields])
    audit = changes.select(
        c("change_id").cast("string").alias("id"),
        F.concat(F.lit("VOTER_"), c("op"), F.when(c("op").endswith("E"), "D").otherwise("ED")).alias("action"),
        F.lit("voter").alias("entity_type"),
        c(key).cast("string").alias("entity_id"),
        redact_json(F.to_json(entry)).alias("changes"),
        c("changed_at").alias("created_at"),
    )
    return updated, audit


def renormalize(records: DataFrame) -> DataFrame:
    """Recompute the normalised columns after names, houses or codes changed."""
    return records.withColumns(
        {
            "id_code": F.nullif(normalize_id_code(c("id_code")), F.lit("")),
            "norm_name_lat": normalize_latin(c("name_lat")),
            "norm_name_dev": normalize_devanagari(c("name_dev")),
            "norm_house": F.nullif(normalize_house(c("house_number")), F.lit("")),
        }
    )
