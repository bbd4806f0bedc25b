"""Data-quality rules as data, issue tables, status changes, duplicates at ingest, decisions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, normalize_id_code, trim_ws
from .keyed import attach_by_key, key_stats, with_key_stats

c = F.col


@dataclass(frozen=True)
class Rule:
    """One check: where ``fails`` is true the row gets an issue."""

    code: str
    field: str
    severity: str
    fails: Column
    message: Column
    confidence: float = 1.0
    flags: bool = True  # a failing row is promoted from VALID to WARNING


def issues_column(rules: Sequence[Rule]) -> Column:
    """array<struct(code, field, severity, confidence, message)> of the failing rules, in order."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(r.fails, F.lit(False)),
                    F.struct(
                        F.lit(r.code).alias("code"),
                        F.lit(r.field).alias("field"),
                        F.lit(r.severity).alias("severity"),
                        F.lit(r.confidence).alias("confidence"),
                        r.message.alias("message"),
                    ),
                )
                for r in rules
            ]
        )
    )


def explode_issues(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """One row per failing rule of a record."""
    exploded = df.select(*keep, F.posexplode(issues_column(rules)).alias("issue_no", "_i"))
    return exploded.select(*keep, "issue_no", "_i.*")


# ------------------------------------------------------------ ingest rules
# Rule codes, limits and severities of the two rule sets.
def ingest_rules() -> list[Rule]:
    """Row checks made while a batch is read in."""
    return [
        Rule(
            "MISSING_MANDATORY_NAME", "name", "ERROR",
            blank_to_null(c("name_lat")).isNull() & blank_to_null(c("name_dev")).isNull(),
            F.lit("record discarded: no name in either script"),
        ),
        Rule(
            "INVALID_AGE", "age", "WARNING", ~c("age").between(18, 130),
            F.concat(F.lit("age "), c("age").cast("string"), F.lit(" is outside 18-130")),
        ),
        Rule(
            "MISSING_EPIC_ID", "id_code", "INFO", blank_to_null(c("id_code")).isNull(),
            F.lit("record has no id code"),
        ),
        Rule(
            "MALFORMED_EPIC_FORMAT", "id_code", "WARNING", F.length("id_code").between(1, 4),
            F.concat(F.lit('id code "'), c("id_code"), F.lit('" is unusually short')),
        ),
        Rule(
            "LOW_OCR_CONFIDENCE", "confidence", "WARNING", c("confidence") < 0.75,
            F.concat(
                F.lit("confidence "), F.round(c("confidence") * 100, 0).cast("int").cast("string"),
                F.lit("% is below the baseline"),
            ),
        ),
    ]


REPEATED_ID = "DUPLICATE_EPIC_IN_BATCH"
REPEATED_SERIAL = "DUPLICATE_SERIAL_IN_PART"
STORED_ID = "DUPLICATE_EPIC"


def flag_repeats(
    df: DataFrame, keys: Sequence[str], out: str,
    order: Sequence[str] = ("ingest_seq", "source_file_id", "record_id"), spread_by: Sequence[str] = ("record_id",),
) -> DataFrame:
    """``out`` is true on every row after the first that shares the key.

    Positions restart in every file, so rows are put in a total order: position,
    then file, then record id (of these, the columns that ``df`` has).
    """
    at = F.struct(*[x for x in order if x in df.columns])
    marked = with_key_stats(df, keys, {"_first": F.min(at)}, spread_by)
    return marked.select(*df.columns, F.coalesce(at > c("_first"), F.lit(False)).alias(out))


def check_batch(drafts: DataFrame) -> DataFrame:
    """Every draft with its ``issues``, ``status`` and ``dropped`` flag.

    Row rules, repeated id codes and repeated serials of a part are evaluated
    together. A repeated serial is reported but does not change the status.
    """
    nameless = blank_to_null(c("name_lat")).isNull() & blank_to_null(c("name_dev")).isNull()
    keyed = drafts.withColumns(
        {
            "dropped": nameless,
            "_id": F.when(~nameless, F.upper(blank_to_null(c("id_code")))),
            "_part": F.when(~nameless, F.coalesce(blank_to_null(c("part")), F.lit("0"))),
        }
    )
    keyed = flag_repeats(keyed, ["batch_id", "_id"], "_repeated_id")
    keyed = flag_repeats(keyed, ["batch_id", "_part", "source_serial_number"], "_repeated_serial")
    rules = ingest_rules()
    rules += [
        Rule(
            REPEATED_ID, "id_code", "WARNING", c("_repeated_id"),
            F.concat(F.lit('id code "'), c("id_code"), F.lit('" appears more than once in the batch')),
        ),
        Rule(
            REPEATED_SERIAL, "serial", "WARNING", c("_repeated_serial"),
            F.concat(F.lit("serial "), c("source_serial_number").cast("string"), F.lit(" repeated in part")),
            flags=False,
        ),
    ]
    only_name = F.filter(c("_all"), lambda i: i["code"] == "MISSING_MANDATORY_NAME")
    flagging = [r.code for r in rules if r.flags]
    flagged = F.exists(c("issues"), lambda i: i["code"].isin(flagging))
    status = (
        F.when(c("_repeated_id"), "DUPLICATE")
        .when((c("status") == "VALID") & flagged, "WARNING")
        .otherwise(c("status"))
    )
    checked = keyed.withColumn("_all", issues_column(rules))
    checked = checked.withColumn("issues", F.when(c("dropped"), only_name).otherwise(c("_all")))
    checked = checked.withColumn("status", status)
    return checked.drop("_id", "_part", "_repeated_id", "_repeated_serial", "_all")


def batch_errors(checked: DataFrame) -> DataFrame:
    """Stored errors of a checked batch: one row per issue."""
    errors = checked.select("batch_id", "source_file_id", "record_id", "ingest_seq", F.explode("issues").alias("_i"))
    return errors.select(
        "batch_id", "source_file_id", "record_id", "ingest_seq",
        c("_i.code").alias("error_code"), c("_i.message").alias("error_message"),
        c("_i.severity").alias("severity"), F.lit(False).alias("is_resolved"),
    )


def flag_against_master(
    batch: DataFrame, master: DataFrame, key: Column | None = None, order: str = "ingest_seq"
) -> DataFrame:
    """Mark batch records whose id code is already stored or came earlier in the batch.

    Adds ``duplicate_of`` (the first record with the key) and sets the status
    to DUPLICATE. Only id codes of the batch are looked up in the master.
    """
    key = key if key is not None else blank_to_null(normalize_id_code(c("id_code")))
    new = batch.withColumn("_key", key)

    def first_seen(df: DataFrame, rank: int) -> DataFrame:
        return df.select(
            "_key", F.struct(F.lit(rank).alias("rank"), c(order).alias("seq"), c("record_id")).alias("_at")
        )

    stored = master.withColumn("_key", key).join(
        new.select("_key").where(c("_key").isNotNull()).distinct(), "_key", "left_semi"
    )
    seen = first_seen(stored, 0).unionByName(first_seen(new, 1))
    firsts = key_stats(seen, ["_key"], {"_first": F.min("_at")["record_id"]})
    joined = attach_by_key(new, firsts, ["_key"], ["_first"], ["record_id"])
    repeated = F.coalesce(c("_first") != c("record_id"), F.lit(False))
    return joined.select(
        *[
            F.when(repeated, "DUPLICATE").otherwise(c("status")).alias("status") if x == "status" else c(x)
            for x in batch.columns
        ],
        F.when(repeated, c("_first")).alias("duplicate_of"),
    )


def insert_counts(inserted: DataFrame) -> DataFrame:
    """Rows inserted, flagged (status not VALID) and duplicate."""
    return inserted.agg(
        F.count(F.lit(1)).alias("inserted"),
        F.count_if(c("status") != "VALID").alias("flagged"),
        F.count_if(c("status") == "DUPLICATE").alias("duplicates"),
    )


# --------------------------------------------------------- field validator
def field_rules() -> list[Rule]:
    """Checks of a stored record, field by field. INFO issues do not invalidate it."""
    code = trim_ws(c("id_code"))
    missing_code = blank_to_null(c("id_code")).isNull()
    accepted = "(?i)^[A-Z]{3}[0-9]{7}$|^[A-Z]{2,4}/[0-9/]{3,12}$|^[0-9]{6,12}$"
    house = trim_ws(F.coalesce(c("house_number"), F.lit("")))
    serial = F.coalesce(c("source_serial_number"), F.lit(0))
    none = F.lit(None).cast("string")

    def absent(name: str) -> Column:
        return F.coalesce(c(name), F.lit("")) == ""

    def rule(code_, field, severity, confidence, fails, message):
        return Rule(code_, field, severity, fails, message, confidence)

    age_text = c("age").cast("string")
    return [
        rule("ID_CODE_MISSING", "id_code", "WARNING", 0.5, missing_code, F.lit("id code is missing")),
        rule("ID_CODE_FORMAT", "id_code", "WARNING", 0.7, ~missing_code & ~code.rlike(accepted),
             F.concat(F.lit('non-standard id code: "'), code, F.lit('"'))),
        rule("AGE_MISSING", "age", "WARNING", 0.4, c("age").isNull(), F.lit("age is missing")),
        rule("AGE_UNDER_18", "age", "ERROR", 0.85, c("age") < 18, F.concat(F.lit("under age: "), age_text)),
        rule("AGE_OVER_120", "age", "WARNING", 0.6, c("age") > 120, F.concat(F.lit("improbable age: "), age_text)),
        rule("GENDER_UNKNOWN", "gender", "WARNING", 0.5,
             ~F.coalesce(c("gender"), F.lit("")).isin("MALE", "FEMALE", "OTHER"),
             F.lit("unrecognised or missing gender")),
        rule("SERIAL_INVALID", "serial", "ERROR", 0.5, serial <= 0, F.lit("invalid or missing serial number")),
        rule("HOUSE_MISSING", "house_number", "INFO", 0.6, house.isin("", "-", "0"), F.lit("house number is missing")),
        rule("HIERARCHY_MISSING", "part", "WARNING", 0.6, absent("part") & absent("ward"),
             F.lit("neither part nor ward is given")),
        rule("RELATION_TYPE", "relation_type", "WARNING", 0.6,
             ~F.coalesce(c("relation_type"), F.lit("")).isin("FATHER", "HUSBAND", "MOTHER", "OTHER"),
             F.lit("unclear or missing relation type")),
        rule("RELATION_NAME_MISSING", "relation_name", "WARNING", 0.5,
             blank_to_null(F.coalesce(F.nullif(c("rel_name_dev"), F.lit("")), c("rel_name_lat"), none)).isNull(),
             F.lit("relative's name is missing")),
        rule("NAME_MISSING", "name", "CRITICAL", 0.2,
             blank_to_null(c("name_dev")).isNull() & blank_to_null(c("name_lat")).isNull(),
             F.lit("name is completely blank")),
    ]


def field_verdict(records: DataFrame) -> DataFrame:
    """``is_valid``, ``suggested_status`` and issue count per record, without a shuffle."""
    with_issues = records.withColumn("_issues", issues_column(field_rules()))
    serious = F.exists("_issues", lambda i: i["severity"] != "INFO")
    return with_issues.select(
        "record_id",
        (~serious).alias("is_valid"),
        F.when(serious, "WARNING").otherwise("VALID").alias("suggested_status"),
        F.size("_issues").alias("n_issues"),
    )


# ------------------------------------------------------------------- queue
QUEUE_COLUMNS = ["record_id", "source_file_id", "field", "issue", "severity", "confidence", "is_resolved"]


def validation_queue(
    records: DataFrame,
    stored_errors: DataFrame,
    severity: str | None = None,
    field: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Rule issues of all records together with stored errors, first one per (record, field, issue).

    ``stored_errors`` has record_id, source_file_id, error_code, error_message,
    severity, is_resolved. ``status`` is open, resolved, all or None; resolved
    errors are only read for the last two named.
    """
    live = explode_issues(records, field_rules(), ["record_id", "source_file_id"]).select(
        "record_id", "source_file_id", "field", c("message").alias("issue"), "severity", "confidence",
        F.lit(False).alias("is_resolved"), F.lit(0).alias("_rank"), c("issue_no").cast("string").alias("_seq"),
    )
    errors = stored_errors
    if status not in ("all", "resolved"):
        errors = errors.where(~c("is_resolved"))
    context = records.select("record_id", c("confidence").alias("_confidence"))
    on_field = F.when(F.lower("error_code").contains("epic"), "id_code").otherwise("name")
    stored = errors.join(context, "record_id", "left").select(
        "record_id", "source_file_id", on_field.alias("field"), c("error_message").alias("issue"),
        F.coalesce("severity", F.lit("WARNING")).alias("severity"),
        F.coalesce(F.nullif(c("_confidence"), F.lit(0.0)), F.lit(0.8)).alias("confidence"),
        "is_resolved", F.lit(1).alias("_rank"), c("error_code").alias("_seq"),
    )
    key = ["record_id", "field", "issue"]
    rest = [x for x in QUEUE_COLUMNS if x not in key]
    first = F.min(F.struct("_rank", "_seq", *rest))
    queue = live.unionByName(stored).groupBy(*key).agg(first.alias("_first"))
    queue = queue.select(*key, *[c(f"_first.{x}").alias(x) for x in rest]).select(QUEUE_COLUMNS)
    if severity:
        queue = queue.where(F.lower("severity") == severity.lower())
    if field:
        queue = queue.where(F.lower("field") == field.lower())
    if status == "open":
        queue = queue.where(~c("is_resolved"))
    if status == "resolved":
        queue = queue.where(c("is_resolved"))
    return queue


def queue_counts(queue: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, open and resolved issues and the quality score (100 - 30 * open share)."""
    total, open_ = F.count(F.lit(1)), F.count_if(~c("is_resolved"))
    score = F.greatest(F.lit(0.0), 100 - open_ / F.greatest(total, F.lit(1)) * 30)
    return queue.groupBy(*by).agg(
        total.alias("total"),
        open_.alias("open_count"),
        F.count_if(c("is_resolved")).alias("resolved_count"),
        F.round(score, 1).alias("quality_score"),
    )


def search_queue(queue: DataFrame, text: str, extra: Sequence[str] = ()) -> DataFrame:
    """Case-insensitive text filter over the issue and any other given columns."""
    hit = F.lower("issue").contains(text.lower())
    for x in extra:
        hit = hit | F.lower(F.coalesce(c(x).cast("string"), F.lit(""))).contains(text.lower())
    return queue.where(hit)


# --------------------------------------------------------------- decisions
EDITABLE = [
    "name_lat", "name_dev", "rel_name_lat", "rel_name_dev", "relation_type", "gender", "age",
    "house_number", "ward", "part", "area", "id_code",
]


def apply_decisions(
    records: DataFrame, errors: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Fold reviewer decisions into records and errors; returns both.

    A decision resolves its error. REJECT_RECORD rejects the record, ACCEPT
    makes it VALID, EDIT sets a field; EDIT and MARK_REVIEWED make it VALID
    once no other error of it is open. The latest decision counts.
    """
    at = F.struct("decided_at", "error_id")
    latest = decisions.groupBy("error_id").agg(
        F.max_by(F.struct("action", "notes", "resolved_by", "decided_at"), at).alias("resolution")
    )
    new_errors = errors.join(latest, "error_id", "left").withColumn(
        "is_resolved", c("is_resolved") | c("resolution").isNotNull()
    )
    still_open = new_errors.where(~c("is_resolved")).groupBy("record_id").agg(F.count(F.lit(1)).alias("_open"))
    sets_status = c("action").isin("REJECT_RECORD", "ACCEPT")
    per_record = decisions.groupBy("record_id").agg(
        F.max_by("action", at).alias("_last"),
        F.max_by(F.when(sets_status, c("action")), F.when(sets_status, at)).alias("_last_set"),
    )
    edits = decisions.where(c("action") == "EDIT").groupBy("record_id", "field").agg(
        F.max_by("new_value", at).alias("value")
    )
    # At most one entry per editable field, so the collected list is short by construction.
    edits = edits.where(c("field").isin(EDITABLE)).groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits")
    )
    touched = per_record.join(still_open, "record_id", "left").join(edits, "record_id", "left")

    def named(action: Column) -> Column:
        return F.when(action == "REJECT_RECORD", "REJECTED").when(action == "ACCEPT", "VALID")

    settled = F.when(F.coalesce("_open", F.lit(0)) == 0, "VALID")
    status = F.when(
        c("_last").isNotNull(), F.coalesce(named(c("_last")), settled, named(c("_last_set")), c("status"))
    ).otherwise(c("status"))

    def edited(name: str, dtype: str) -> Column:
        value = F.try_element_at("_edits", F.lit(name))
        if name == "id_code":
            value = normalize_id_code(value)
        has = F.coalesce(F.array_contains(F.map_keys("_edits"), name), F.lit(False))
        return F.when(has, value.try_cast(dtype)).otherwise(c(name))

    joined = records.join(touched, "record_id", "left")
    types = dict(records.dtypes)
    new_records = joined.select(
        *[
            status.alias(x) if x == "status" else edited(x, types[x]).alias(x) if x in EDITABLE else c(x)
            for x in records.columns
        ]
    )
    return new_records, new_errors


# ------------------------------------------------- declared constraints
def constraint_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failing rows per check, zeros included, in one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(r.fails, F.lit(False))).alias(r.code) for r in rules])
    pairs = F.array(
        *[F.struct(F.lit(r.code).alias("rule"), c(r.code).alias("violations")) for r in rules]
    )
    return counts.select(F.inline(pairs))


def stored_checks() -> list[Rule]:
    """CHECK constraints of the record table. Allowed codes and ranges."""
    none = F.lit(None).cast("string")

    def outside(name: str, allowed: list[str]) -> Column:
        return ~c(name).isin(allowed)

    return [
        Rule("gender_code", "gender", "ERROR",
             outside("gender", ["MALE", "FEMALE", "OTHER", "THIRD_GENDER", "UNKNOWN"]), none),
        Rule("age_range", "age", "ERROR", ~c("age").between(18, 130), none),
        Rule("relation_code", "relation_type", "ERROR",
             outside("relation_type", ["FATHER", "MOTHER", "HUSBAND", "OTHER", "UNKNOWN"]), none),
        Rule("confidence_range", "confidence", "ERROR", ~c("confidence").between(0.0, 1.0), none),
        Rule("status_code", "status", "ERROR",
             outside("status", ["VALID", "WARNING", "DUPLICATE", "REJECTED"]), none),
    ]


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return key_stats(df, keys, {}).where(c("key_rows") > 1).withColumnRenamed("key_rows", "n_rows")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    refs = child.where(c(child_key).isNotNull())
    parents = parent.select(c(parent_key).alias("_parent"))
    return refs.join(parents, refs[child_key] == parents["_parent"], "left_anti")
