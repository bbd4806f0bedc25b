"""Ingest rules, field issues, verdicts, queue, decisions, constraints, orphans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality, stats
from .registry import query
from .views import r_sql, register, table

c = F.col

# Every issue of a checked batch in SQL: rule rows, then the status each record ends with.
CHECKED_SQL = """, m AS (
  SELECT *, name_lat IS NULL AS dropped,
    CASE WHEN name_lat IS NOT NULL AND id_code IS NOT NULL THEN
      row_number() OVER (PARTITION BY batch_id, name_lat IS NULL, upper(id_code) ORDER BY ingest_seq) > 1
      ELSE false END AS rep_id,
    CASE WHEN name_lat IS NOT NULL THEN
      row_number() OVER (PARTITION BY batch_id, name_lat IS NULL, coalesce(part, '0'), source_serial_number
        ORDER BY ingest_seq) > 1 ELSE false END AS rep_serial
  FROM r), e AS (
  SELECT batch_id, record_id, ingest_seq, 'MISSING_MANDATORY_NAME' AS error_code, 'ERROR' AS severity FROM m WHERE dropped
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'INVALID_AGE', 'WARNING' FROM m WHERE NOT dropped AND (age < 18 OR age > 130)
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'MISSING_EPIC_ID', 'INFO' FROM m WHERE NOT dropped AND id_code IS NULL
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'MALFORMED_EPIC_FORMAT', 'WARNING' FROM m WHERE NOT dropped AND length(id_code) < 5
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'LOW_OCR_CONFIDENCE', 'WARNING' FROM m WHERE NOT dropped AND confidence < 0.75
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'DUPLICATE_EPIC_IN_BATCH', 'WARNING' FROM m WHERE rep_id
  UNION ALL SELECT batch_id, record_id, ingest_seq, 'DUPLICATE_SERIAL_IN_PART', 'WARNING' FROM m WHERE rep_serial
), ck AS (
  SELECT *, CASE WHEN rep_id THEN 'DUPLICATE' WHEN dropped OR (age < 18 OR age > 130) OR id_code IS NULL
    OR length(id_code) < 5 OR confidence < 0.75 THEN 'WARNING' ELSE 'VALID' END AS new_status FROM m)
"""


def checked(spark, sf_dir):
    return quality.check_batch(register(spark, sf_dir))


@query("ingest_rule_errors", r_sql(CHECKED_SQL + "SELECT record_id, error_code, severity FROM e"))
def ingest_rule_errors(spark, sf_dir):
    return quality.batch_errors(checked(spark, sf_dir)).select("record_id", "error_code", "severity")


@query("row_status", r_sql(CHECKED_SQL + "SELECT record_id, dropped, new_status AS status FROM ck"))
def row_status(spark, sf_dir):
    return checked(spark, sf_dir).select("record_id", "dropped", "status")


@query(
    "dup_id_in_batch",
    r_sql(
        """SELECT record_id, coalesce(id_code IS NOT NULL AND row_number() OVER (
        PARTITION BY batch_id, upper(id_code) ORDER BY ingest_seq) > 1, false) AS is_repeat FROM r"""
    ),
)
def dup_id_in_batch(spark, sf_dir):
    keyed = register(spark, sf_dir).withColumn("_id", F.upper("id_code"))
    return quality.flag_repeats(keyed, ["batch_id", "_id"], "is_repeat").select("record_id", "is_repeat")


@query(
    "dup_id_across_files",
    r_sql(
        """SELECT record_id, coalesce(id_code IS NOT NULL AND row_number() OVER (
        PARTITION BY batch_id, upper(id_code) ORDER BY ingest_seq // 20, source_file_id, record_id) > 1, false) AS is_repeat FROM r"""
    ),
)
def dup_id_across_files(spark, sf_dir):
    """Positions restart in every file, as they do in files that are read in."""
    keyed = register(spark, sf_dir).withColumn("_id", F.upper("id_code"))
    keyed = keyed.withColumn("ingest_seq", F.floor(c("ingest_seq") / 20).cast("bigint"))
    return quality.flag_repeats(keyed, ["batch_id", "_id"], "is_repeat").select("record_id", "is_repeat")


@query(
    "dup_serial_in_part",
    r_sql(
        """SELECT record_id, row_number() OVER (PARTITION BY batch_id, coalesce(part, '0'), source_serial_number
        ORDER BY ingest_seq) > 1 AS is_repeat FROM r"""
    ),
)
def dup_serial_in_part(spark, sf_dir):
    keyed = register(spark, sf_dir).withColumn("_part", F.coalesce("part", F.lit("0")))
    keys = ["batch_id", "_part", "source_serial_number"]
    return quality.flag_repeats(keyed, keys, "is_repeat").select("record_id", "is_repeat")


def _insert(spark, sf_dir):
    """Half of R is stored already, the other half arrives as a batch."""
    r = register(spark, sf_dir)
    return quality.flag_against_master(r.where(c("record_id") % 2 == 1), r.where(c("record_id") % 2 == 0))


_INSERT_SQL = """, f AS (SELECT *, row_number() OVER w AS rn, first_value(record_id) OVER w AS first_id FROM r
    WINDOW w AS (PARTITION BY CASE WHEN id_code IS NULL THEN 'r' || record_id ELSE id_code END
      ORDER BY record_id % 2, ingest_seq)), b AS (
  SELECT record_id, CASE WHEN rn > 1 THEN first_id END AS duplicate_of,
    CASE WHEN rn > 1 THEN 'DUPLICATE' ELSE status END AS status FROM f WHERE record_id % 2 = 1)
"""


@query("dup_vs_master", r_sql(_INSERT_SQL + "SELECT record_id, duplicate_of, status FROM b"))
def dup_vs_master(spark, sf_dir):
    return _insert(spark, sf_dir).select("record_id", "duplicate_of", "status")


@query(
    "insert_counts",
    r_sql(
        _INSERT_SQL
        + """SELECT count(*) AS inserted, count(*) FILTER (status <> 'VALID') AS flagged,
        count(*) FILTER (status = 'DUPLICATE') AS duplicates FROM b"""
    ),
)
def insert_counts(spark, sf_dir):
    return quality.insert_counts(_insert(spark, sf_dir))


# ---------------------------------------------------------------- fields
_FIELD_SQL = """, i AS (
  SELECT record_id, source_file_id, 'ID_CODE_MISSING' AS code, 'id_code' AS field, 'WARNING' AS severity, 0.5 AS confidence,
    'id code is missing' AS message FROM r WHERE id_code IS NULL
  UNION ALL SELECT record_id, source_file_id, 'ID_CODE_FORMAT', 'id_code', 'WARNING', 0.7,
    'non-standard id code: "' || id_code || '"' FROM r WHERE NOT regexp_matches(id_code, '(?i)^[A-Z]{3}[0-9]{7}$')
  UNION ALL SELECT record_id, source_file_id, 'AGE_MISSING', 'age', 'WARNING', 0.4, 'age is missing' FROM r WHERE age IS NULL
  UNION ALL SELECT record_id, source_file_id, 'AGE_UNDER_18', 'age', 'ERROR', 0.85, 'under age: ' || age FROM r WHERE age < 18
  UNION ALL SELECT record_id, source_file_id, 'AGE_OVER_120', 'age', 'WARNING', 0.6, 'improbable age: ' || age FROM r WHERE age > 120
  UNION ALL SELECT record_id, source_file_id, 'GENDER_UNKNOWN', 'gender', 'WARNING', 0.5, 'unrecognised or missing gender'
    FROM r WHERE gender NOT IN ('MALE', 'FEMALE', 'OTHER')
  UNION ALL SELECT record_id, source_file_id, 'SERIAL_INVALID', 'serial', 'ERROR', 0.5, 'invalid or missing serial number'
    FROM r WHERE source_serial_number <= 0
  UNION ALL SELECT record_id, source_file_id, 'HOUSE_MISSING', 'house_number', 'INFO', 0.6, 'house number is missing'
    FROM r WHERE house_number IN ('', '-', '0')
  UNION ALL SELECT record_id, source_file_id, 'HIERARCHY_MISSING', 'part', 'WARNING', 0.6, 'neither part nor ward is given'
    FROM r WHERE part IS NULL AND ward IS NULL
  UNION ALL SELECT record_id, source_file_id, 'RELATION_TYPE', 'relation_type', 'WARNING', 0.6, 'unclear or missing relation type'
    FROM r WHERE relation_type NOT IN ('FATHER', 'HUSBAND', 'MOTHER', 'OTHER')
  UNION ALL SELECT record_id, source_file_id, 'RELATION_NAME_MISSING', 'relation_name', 'WARNING', 0.5, 'relative''s name is missing'
    FROM r WHERE rel_name_lat IS NULL
  UNION ALL SELECT record_id, source_file_id, 'NAME_MISSING', 'name', 'CRITICAL', 0.2, 'name is completely blank'
    FROM r WHERE name_lat IS NULL)
"""


@query(
    "field_issues",
    r_sql(_FIELD_SQL + "SELECT record_id, code, field, severity, confidence::DOUBLE AS confidence, message FROM i"),
)
def field_issues(spark, sf_dir):
    return quality.explode_issues(register(spark, sf_dir), quality.field_rules(), ["record_id"]).drop("issue_no")


@query(
    "field_verdict",
    r_sql(
        _FIELD_SQL
        + """, v AS (SELECT record_id, count(*) AS n, count(*) FILTER (severity <> 'INFO') AS serious FROM i GROUP BY record_id)
        SELECT r.record_id, coalesce(serious, 0) = 0 AS is_valid,
          CASE WHEN coalesce(serious, 0) > 0 THEN 'WARNING' ELSE 'VALID' END AS suggested_status,
          coalesce(n, 0)::INTEGER AS n_issues FROM r LEFT JOIN v USING (record_id)"""
    ),
)
def field_verdict(spark, sf_dir):
    return quality.field_verdict(register(spark, sf_dir))


# ------------------------------------------------------------------ queue
def stored_errors(spark, sf_dir):
    """Errors of the checked batch as stored, every third one resolved already."""
    errors = quality.batch_errors(checked(spark, sf_dir))
    return errors.withColumn("is_resolved", c("record_id") % 3 == 0)


_QUEUE_SQL = CHECKED_SQL + _FIELD_SQL + """, s AS (
  SELECT e.record_id, r.source_file_id, CASE WHEN contains(lower(error_code), 'epic') THEN 'id_code' ELSE 'name' END AS field,
    error_code, severity, e.record_id % 3 = 0 AS is_resolved
  FROM e JOIN r USING (record_id)), q AS (
  SELECT record_id, field, severity, false AS is_resolved, 'live' AS origin FROM i
  UNION ALL SELECT record_id, field, severity, is_resolved, 'stored' FROM s)
"""


@query(
    "validation_queue",
    r_sql(
        _QUEUE_SQL
        + """SELECT field, severity, is_resolved, count(*) AS n FROM q GROUP BY field, severity, is_resolved"""
    ),
)
def validation_queue(spark, sf_dir):
    queue = quality.validation_queue(register(spark, sf_dir), stored_errors(spark, sf_dir), status="all")
    return queue.groupBy("field", "severity", "is_resolved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "open_queue",
    r_sql(
        _QUEUE_SQL
        + """SELECT record_id, count(*) AS n FROM q WHERE NOT is_resolved AND severity = 'WARNING' AND field = 'id_code'
        GROUP BY record_id"""
    ),
)
def open_queue(spark, sf_dir):
    queue = quality.validation_queue(
        register(spark, sf_dir), stored_errors(spark, sf_dir), severity="warning", field="id_code", status="open"
    )
    return queue.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quality_score",
    r_sql(
        _QUEUE_SQL
        + """SELECT field, count(*) AS total, count(*) FILTER (NOT is_resolved) AS open_count,
        count(*) FILTER (is_resolved) AS resolved_count,
        round(greatest(0.0, 100 - count(*) FILTER (NOT is_resolved)::DOUBLE / greatest(count(*), 1) * 30), 1)::DOUBLE
          AS quality_score FROM q GROUP BY field"""
    ),
)
def quality_score(spark, sf_dir):
    queue = quality.validation_queue(register(spark, sf_dir), stored_errors(spark, sf_dir), status="all")
    return quality.queue_counts(queue, ["field"])


# -------------------------------------------------------------- decisions
def _decisions(spark, sf_dir):
    """Errors of R and reviewer decisions taken from the order table (one per order of a record)."""
    errors = quality.batch_errors(checked(spark, sf_dir)).select(
        "record_id", "error_code", "is_resolved", F.concat("record_id", F.lit("/"), "error_code").alias("error_id")
    )
    key = c("l_partkey")
    decided = table(spark, sf_dir, "lineitem").select(
        key.alias("record_id"), c("l_shipdate").alias("decided_at"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("n"),
        F.when(c("l_linenumber") == 1, "REJECT_RECORD").when(c("l_linenumber") == 2, "ACCEPT")
        .when(c("l_linenumber") <= 4, "EDIT").otherwise("MARK_REVIEWED").alias("action"),
        F.concat(F.lit("W"), c("l_quantity").cast("int").cast("string")).alias("new_value"),
    )
    # A decision is made on the record's errors in turn.
    codes = F.array(*[F.lit(x) for x in ("INVALID_AGE", "MISSING_EPIC_ID", "LOW_OCR_CONFIDENCE", "DUPLICATE_SERIAL_IN_PART")])
    code = F.get(codes, (c("n") % 4).cast("int"))
    decisions = decided.select(
        F.concat("record_id", F.lit("/"), code).alias("error_id"), "record_id", "action",
        F.lit("ward").alias("field"), "new_value", F.lit(None).cast("string").alias("notes"),
        F.lit("reviewer").alias("resolved_by"), F.struct("decided_at", "n").alias("decided_at"),
    )
    return errors, decisions


_DECISION_SQL = CHECKED_SQL + """, dd AS (
  SELECT l_partkey AS record_id, l_shipdate AS decided_at, l_orderkey * 10 + l_linenumber AS n,
    CASE WHEN l_linenumber = 1 THEN 'REJECT_RECORD' WHEN l_linenumber = 2 THEN 'ACCEPT'
      WHEN l_linenumber <= 4 THEN 'EDIT' ELSE 'MARK_REVIEWED' END AS action,
    'W' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS new_value,
    (l_orderkey * 10 + l_linenumber) % 4 AS code_no,
    l_partkey || '/' || ['INVALID_AGE', 'MISSING_EPIC_ID', 'LOW_OCR_CONFIDENCE', 'DUPLICATE_SERIAL_IN_PART'][
      CAST((l_orderkey * 10 + l_linenumber) % 4 AS INTEGER) + 1] AS error_id
  FROM lineitem), ee AS (
  SELECT record_id, record_id || '/' || error_code AS error_id FROM e), st AS (
  SELECT ee.*, ee.error_id IN (SELECT error_id FROM dd) AS resolved FROM ee), o AS (
  SELECT record_id, count(*) FILTER (NOT resolved) AS open FROM st GROUP BY record_id), l AS (
  SELECT record_id, arg_max(action, (decided_at, n, error_id)) AS last,
    arg_max(action, (decided_at, n, error_id)) FILTER (action IN ('REJECT_RECORD', 'ACCEPT')) AS last_set,
    arg_max(new_value, (decided_at, n, error_id)) FILTER (action = 'EDIT') AS new_ward FROM dd GROUP BY record_id)
"""


@query(
    "apply_decisions",
    r_sql(
        _DECISION_SQL
        + """SELECT r.record_id, coalesce(new_ward, ward) AS ward, CASE WHEN last IS NULL THEN r.status
          WHEN last = 'REJECT_RECORD' THEN 'REJECTED' WHEN last = 'ACCEPT' THEN 'VALID'
          WHEN coalesce(open, 0) = 0 THEN 'VALID' WHEN last_set = 'REJECT_RECORD' THEN 'REJECTED'
          WHEN last_set = 'ACCEPT' THEN 'VALID' ELSE r.status END AS status
        FROM (SELECT record_id, ward, new_status AS status FROM ck) r
        LEFT JOIN l USING (record_id) LEFT JOIN o USING (record_id)"""
    ),
)
def apply_decisions(spark, sf_dir):
    errors, decisions = _decisions(spark, sf_dir)
    records = checked(spark, sf_dir).drop("issues", "dropped")
    new_records, _ = quality.apply_decisions(records, errors, decisions)
    return new_records.select("record_id", "ward", "status")


@query(
    "resolved_errors",
    r_sql(_DECISION_SQL + "SELECT resolved AS is_resolved, count(*) AS n FROM st GROUP BY resolved"),
)
def resolved_errors(spark, sf_dir):
    errors, decisions = _decisions(spark, sf_dir)
    _, new_errors = quality.apply_decisions(checked(spark, sf_dir), errors, decisions)
    return new_errors.groupBy("is_resolved").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ constraints
@query(
    "constraint_report",
    r_sql(
        """SELECT unnest(['gender_code', 'age_range', 'relation_code', 'confidence_range', 'status_code']) AS rule,
        unnest([count(*) FILTER (gender NOT IN ('MALE', 'FEMALE', 'OTHER', 'THIRD_GENDER', 'UNKNOWN')),
          count(*) FILTER (age NOT BETWEEN 18 AND 130),
          count(*) FILTER (relation_type NOT IN ('FATHER', 'MOTHER', 'HUSBAND', 'OTHER', 'UNKNOWN')),
          count(*) FILTER (confidence NOT BETWEEN 0 AND 1),
          count(*) FILTER (status NOT IN ('VALID', 'WARNING', 'DUPLICATE', 'REJECTED'))]) AS violations FROM r"""
    ),
)
def constraint_report(spark, sf_dir):
    return quality.constraint_report(register(spark, sf_dir), quality.stored_checks())


@query(
    "unique_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def unique_violations(spark, sf_dir):
    return quality.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphans",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey + 50 FROM orders)
    """,
)
def orphans(spark, sf_dir):
    # Shifted keys leave some lines without an order.
    orders = table(spark, sf_dir, "orders").select((c("o_orderkey") + 50).alias("o_orderkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return quality.orphans(lines, orders, "l_orderkey", "o_orderkey")


# ---------------------------------------------------------------- reports
@query(
    "batch_status",
    r_sql(
        CHECKED_SQL
        + """, w AS (SELECT batch_id, count(*) FILTER (error_code NOT IN ('MISSING_MANDATORY_NAME',
            'DUPLICATE_EPIC_IN_BATCH')) AS warnings FROM e GROUP BY batch_id), t AS (
        SELECT batch_id, count(*) FILTER (NOT dropped) AS records_processed,
          count(*) FILTER (NOT dropped AND new_status = 'VALID') AS records_valid,
          count(*) FILTER (NOT dropped AND new_status <> 'VALID') AS records_flagged,
          count(*) FILTER (dropped) AS errors FROM ck GROUP BY batch_id)
        SELECT t.*, coalesce(warnings, 0) AS warnings, CASE WHEN records_flagged > 0 OR coalesce(warnings, 0) > 0
          THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS final_status FROM t LEFT JOIN w USING (batch_id)"""
    ),
)
def batch_status(spark, sf_dir):
    return stats.batch_totals(checked(spark, sf_dir))


_REPORT_SQL = CHECKED_SQL + """, t AS (
  SELECT batch_id, count(*) AS processed, count(*) FILTER (new_status = 'VALID') AS valid,
    round(avg(CAST(confidence AS DECIMAL(18, 6))), 3)::DOUBLE AS avg_confidence FROM ck WHERE NOT dropped GROUP BY batch_id),
  b AS (SELECT batch_id, count(*) AS total_errors, count(*) FILTER (error_code = 'DUPLICATE_EPIC_IN_BATCH') AS dups,
    count(*) FILTER (error_code = 'INVALID_AGE') AS bad_ages, count(DISTINCT error_code) AS n_codes FROM e GROUP BY batch_id)
"""


_REPORT_ROWS_SQL = r_sql(
    _REPORT_SQL
    + """SELECT batch_id, processed AS records_processed, avg_confidence,
    round(valid * 100 / CAST(processed AS DOUBLE), 1)::DOUBLE AS valid_pct, dups AS duplicates_count, total_errors,
    bad_ages, n_codes::INTEGER AS n_codes FROM t JOIN b USING (batch_id)"""
)


def _report_rows(report):
    return report.select(
        "batch_id", "records_processed", "avg_confidence", "valid_pct", "duplicates_count", "total_errors",
        F.coalesce(F.try_element_at("error_breakdown", F.lit("INVALID_AGE")), F.lit(0)).alias("bad_ages"),
        F.size("error_breakdown").alias("n_codes"),
    )


@query("import_report", _REPORT_ROWS_SQL)
def import_report(spark, sf_dir):
    batch = checked(spark, sf_dir)
    return _report_rows(stats.import_report(batch, quality.batch_errors(batch)))


@query("report_json", _REPORT_ROWS_SQL)
def report_json(spark, sf_dir):
    from ..operators import audit
    from ..session import work_folder

    batch = checked(spark, sf_dir)
    folder = work_folder(spark, "report")
    report = stats.import_report(batch, quality.batch_errors(batch))
    audit.write_report(report, folder)
    return _report_rows(spark.read.schema(report.schema).json(folder))


@query(
    "first_errors",
    r_sql(
        CHECKED_SQL
        + """SELECT batch_id, record_id, error_code, CAST(error_no AS INTEGER) AS error_no FROM (
        SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ingest_seq, error_code) AS error_no FROM e)
        WHERE error_no <= 50"""
    ),
)
def first_errors(spark, sf_dir):
    errors = quality.batch_errors(checked(spark, sf_dir))
    return stats.first_errors(errors).select("batch_id", "record_id", "error_code", "error_no")


@query(
    "errors_by_batch",
    r_sql(CHECKED_SQL + "SELECT record_id, error_code FROM e WHERE record_id % 20 % 4 = 2"),
)
def errors_by_batch(spark, sf_dir):
    from ..operators import lineage

    errors = quality.batch_errors(checked(spark, sf_dir)).drop("batch_id")
    # Files F0 .. F19 belong to four import batches.
    files = register(spark, sf_dir).select(
        "source_file_id", (c("record_id") % 20 % 4).alias("batch_id")
    ).distinct()
    return lineage.errors_of_batch(errors, files, 2).select("record_id", "error_code")


@query(
    "record_errors",
    r_sql(
        CHECKED_SQL
        + "SELECT r.record_id, e.error_code, e.severity FROM r LEFT JOIN e ON r.record_id = e.record_id"
    ),
)
def record_errors(spark, sf_dir):
    from ..operators import lineage

    r = register(spark, sf_dir)
    errors = quality.batch_errors(quality.check_batch(r))
    return lineage.record_errors(r, errors, ["record_id"]).drop("is_resolved")
