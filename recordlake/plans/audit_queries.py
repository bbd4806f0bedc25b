"""Audit and search logs, redaction, record changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit
from .registry import query
from .views import r_sql, register, table

c = F.col


def audit_log(spark, sf_dir):
    """The event table as an audit log."""
    return table(spark, sf_dir, "events").select(
        c("event_id").alias("id"), "user_id", F.upper("event_type").alias("action"), F.lit("Voter").alias("entity_type"),
        c("user_id").cast("string").alias("entity_id"), c("props").alias("changes"), c("ts").alias("created_at"),
    )


@query("retention_last_n", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def retention_last_n(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    return audit.keep_latest(log, [c("ts").desc(), c("event_id").desc()], audit.KEEP_AUDIT).select("event_id")


@query(
    "retention_per_user",
    """
    SELECT event_id, user_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, user_id,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3
    """,
)
def retention_per_user(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return audit.keep_latest_per(log, ["user_id"], [c("ts").desc(), c("event_id").desc()], 3).drop("ts")


@query(
    "audit_query",
    """
    SELECT event_id AS id, user_id, ts AS created_at FROM events WHERE lower(event_type) = 'click' AND user_id = 7
    ORDER BY ts DESC, event_id DESC LIMIT 100
    """,
)
def audit_query(spark, sf_dir):
    found = audit.query_log(audit_log(spark, sf_dir), action="Click", entity_type="VOTER", user_id=7)
    return found.select("id", "user_id", "created_at")


@query(
    "audit_search",
    """
    SELECT event_id AS id FROM events WHERE contains(lower(event_type), '"k": 6') OR contains(lower(props), '"k": 6')
    """,
)
def audit_search(spark, sf_dir):
    return audit.search_log(audit_log(spark, sf_dir), '"K": 6').select("id")


_ACTION_SQL = """CASE event_type WHEN 'signup' THEN 'LOGIN' WHEN 'error' THEN 'IMPORT_FAILED' WHEN 'click' THEN 'validation_decision'
  WHEN 'purchase' THEN 'FILE_UPLOAD' ELSE 'SOURCE_ACCESS' END"""


@query(
    "audit_classes",
    f"""
    WITH a AS (SELECT {_ACTION_SQL} AS action FROM events)
    SELECT action, CASE WHEN regexp_matches(upper(action), 'LOGIN|AUTH') THEN 'auth'
      WHEN regexp_matches(upper(action), 'DELETE|REJECT|FAILED') THEN 'destructive'
      WHEN regexp_matches(upper(action), 'VALIDATION|VERIFIED') THEN 'validation'
      WHEN regexp_matches(upper(action), 'UPLOAD|IMPORT') THEN 'import' ELSE 'other' END AS action_class, count(*) AS n
    FROM a GROUP BY action, action_class
    """,
)
def audit_classes(spark, sf_dir):
    actions = {"signup": "LOGIN", "error": "IMPORT_FAILED", "click": "validation_decision", "purchase": "FILE_UPLOAD"}
    action = F.lit("SOURCE_ACCESS")
    for event, name in actions.items():
        action = F.when(c("event_type") == event, name).otherwise(action)
    events = table(spark, sf_dir, "events").select(action.alias("action"))
    return events.groupBy("action", audit.action_class(c("action")).alias("action_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "redact_json",
    """
    SELECT event_id, CASE event_id % 3
      WHEN 0 THEN '{"k": "[REDACTED_SECRET]"}'
      WHEN 1 THEN '{"user":"u' || user_id || '","api_key":"[REDACTED_SECRET]","n":' || user_id || '}'
      ELSE '{"a":{"Session_Token":"[REDACTED_SECRET]","kept":[1,2]},"b":"x"}' END AS redacted FROM events
    """,
)
def redact_json(spark, sf_dir):
    user = c("user_id").cast("string")
    keyed = F.concat(F.lit('{"user":"u'), user, F.lit('","api_key":{"v":["s,\\"}",'), user, F.lit(']},"n":'), user, F.lit("}"))
    nested = F.lit('{"a":{"Session_Token":"t\\"x","kept":[1,2]},"b":"x"}')
    kind = c("event_id") % 3
    # The plain props of every third event are redacted by their own key.
    own = audit.redact_json(c("props"), "^k$|k")
    other = audit.redact_json(F.when(kind == 1, keyed).otherwise(nested))
    return table(spark, sf_dir, "events").select("event_id", F.when(kind == 0, own).otherwise(other).alias("redacted"))


# ------------------------------------------------------------------ changes
def _changes(spark, sf_dir):
    """Order lines as changes of the records they name; a few records are new."""
    lines = table(spark, sf_dir, "lineitem")
    fresh = c("l_linenumber") == 7
    return lines.select(
        F.when(fresh, -c("l_partkey") - 1).otherwise(c("l_partkey")).alias("record_id"),
        F.when(fresh, "CREATE").when(c("l_quantity") == 50, "DELETE").otherwise("UPDATE").alias("op"),
        c("l_shipdate").alias("changed_at"),
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("change_id"),
        F.when(c("l_returnflag") == "A", F.concat(F.lit("W"), c("l_linestatus"))).alias("ward"),
        F.when(c("l_returnflag") == "R", F.concat(F.lit("name "), c("l_linestatus"))).alias("name_lat"),
    )


_CHANGES_SQL = """, ch AS (SELECT CASE WHEN l_linenumber = 7 THEN -l_partkey - 1 ELSE l_partkey END AS record_id,
    CASE WHEN l_linenumber = 7 THEN 'CREATE' WHEN l_quantity = 50 THEN 'DELETE' ELSE 'UPDATE' END AS op,
    l_shipdate AS changed_at, l_orderkey * 10 + l_linenumber AS change_id,
    CASE WHEN l_returnflag = 'A' THEN 'W' || l_linestatus END AS ward,
    CASE WHEN l_returnflag = 'R' THEN 'name ' || l_linestatus END AS name_lat FROM lineitem),
  l AS (SELECT record_id, arg_max(op, (changed_at, change_id)) AS op,
    arg_max(ward, (changed_at, change_id)) FILTER (ward IS NOT NULL) AS ward,
    arg_max(name_lat, (changed_at, change_id)) FILTER (name_lat IS NOT NULL) AS name_lat FROM ch GROUP BY record_id)
"""


@query(
    "apply_updates",
    r_sql(
        _CHANGES_SQL
        + """SELECT coalesce(r.record_id, l.record_id) AS record_id, coalesce(l.ward, r.ward) AS ward,
        coalesce(l.name_lat, r.name_lat) AS name_lat FROM r FULL JOIN l ON r.record_id = l.record_id
        WHERE coalesce(l.op <> 'DELETE', true) AND (r.record_id IS NOT NULL OR l.op = 'CREATE')"""
    ),
)
def apply_updates(spark, sf_dir):
    records, _ = audit.apply_changes(register(spark, sf_dir), _changes(spark, sf_dir), ["ward", "name_lat"])
    return records.select("record_id", "ward", "name_lat")


@query(
    "change_audit",
    r_sql(
        _CHANGES_SQL
        + """SELECT CASE op WHEN 'CREATE' THEN 'VOTER_CREATED' WHEN 'UPDATE' THEN 'VOTER_UPDATED' ELSE 'VOTER_DELETED' END
        AS action, count(*) AS n FROM ch GROUP BY op"""
    ),
)
def change_audit(spark, sf_dir):
    _, log = audit.apply_changes(register(spark, sf_dir), _changes(spark, sf_dir), ["ward", "name_lat"])
    return log.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
