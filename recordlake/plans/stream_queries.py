"""Limits, windows and streaming jobs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, limits
from ..session import work_folder
from ..streaming import ingest, ledger, logs, progress, stateful
from .registry import query
from .views import r_sql, register, table

c = F.col

DAY = 24 * 3600
# Events of one user are hours apart, so the limiter is shown with 3 hits per day.
LIMIT = 3


@query(
    "trailing_count",
    """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
      RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS hits_in_window FROM events
    """,
)
def trailing_count(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return limits.trailing_count(events, "user_id", "ts", DAY).select("event_id", "hits_in_window")


# The decision about a hit depends on the decisions before it: one step per hit of a user.
_LIMIT_SQL = f"""
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS n FROM events),
  d AS (SELECT event_id, user_id, n, us, true AS allowed, [us] AS acc FROM o WHERE n = 1
    UNION ALL SELECT o.event_id, o.user_id, o.n, o.us,
      len(list_filter(d.acc, lambda t: t > o.us - {DAY}000000)) < {LIMIT},
      CASE WHEN len(list_filter(d.acc, lambda t: t > o.us - {DAY}000000)) < {LIMIT}
        THEN list_append(list_filter(d.acc, lambda t: t > o.us - {DAY}000000), o.us)
        ELSE list_filter(d.acc, lambda t: t > o.us - {DAY}000000) END
    FROM d JOIN o ON o.user_id = d.user_id AND o.n = d.n + 1)
"""


@query(
    "rate_limit",
    _LIMIT_SQL
    + f"""SELECT event_id, user_id, allowed, CAST(CASE WHEN allowed THEN {LIMIT} - len(acc) ELSE 0 END AS INTEGER) AS remaining
    FROM d""",
)
def rate_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    decided = limits.rate_limit(events, "user_id", "ts", "event_id", LIMIT, DAY)
    return decided.select("event_id", "user_id", "allowed", "remaining")


@query("rate_limit_stream", _LIMIT_SQL + "SELECT event_id, allowed FROM d")
def rate_limit_stream(spark, sf_dir):
    events = ingest.table_stream(spark, f"{sf_dir}/events.parquet")
    decided = ingest.run_to_table(
        stateful.limit_stream(events, "user_id", "ts", "event_id", LIMIT, DAY), "rate-limit"
    )
    return decided.select(c("row_id").cast("bigint").alias("event_id"), "allowed")


@query(
    "latest_state",
    """
    SELECT user_id, event_id, event_type, value, n_events FROM (SELECT *,
      count(*) OVER (PARTITION BY user_id) AS n_events,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def latest_state(spark, sf_dir):
    found = limits.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return found.select("user_id", "event_id", "event_type", "value", "n_events")


@query(
    "log_hourly",
    """
    SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n,
      sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS total, max(value) AS largest
    FROM events GROUP BY ALL
    """,
)
def log_hourly(spark, sf_dir):
    found = logs.per_window(table(spark, sf_dir, "events"), "ts", "value", "event_type")
    return found.withColumns(
        {"window_start": c("window_start").cast("timestamp_ntz"), "total": c("total").cast("double")}
    )


@query(
    "log_sessions",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM g)
    SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, no
    """,
)
def log_sessions(spark, sf_dir):
    found = logs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return found.select(
        "user_id", c("first_ts").cast("timestamp_ntz").alias("first_ts"), c("last_ts").cast("timestamp_ntz").alias("last_ts"), "n"
    )


@query(
    "stream_dedupe",
    """
    SELECT user_id, event_type, count(*) AS n_first FROM (SELECT DISTINCT user_id, event_type FROM events)
    GROUP BY user_id, event_type
    """,
)
def stream_dedupe(spark, sf_dir):
    events = ingest.table_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    firsts = ingest.run_to_table(
        stateful.drop_repeats_stream(events, ["user_id", "event_type"], "ts", "400 days"), "first-seen"
    )
    return firsts.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_first"))


@query(
    "stream_flag_repeats",
    """
    SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS is_repeat FROM events
    """,
)
def stream_flag_repeats(spark, sf_dir):
    events = ingest.table_stream(spark, f"{sf_dir}/events.parquet")
    keyed = events.withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    flagged = ingest.run_to_table(stateful.flag_repeats_stream(keyed, "key", "event_id"), "flag-repeats")
    return flagged.select(c("seq").alias("event_id"), "is_repeat")


# The rows of a file are numbered as written: by record id. Repeats are decided by that number, then by file.
_STATUS_SQL = """CASE WHEN id_code IS NULL OR age IS NULL OR age < 18 OR age > 130 OR length(id_code) < 5 THEN 'WARNING' ELSE 'VALID' END"""


def _delivery(spark, sf_dir):
    """Rows of register files: the file number f changes every hundred records, so id codes repeat across files."""
    return register(spark, sf_dir).select(
        c("record_id").cast("string").alias("serial_no"), c("id_code").alias("epic_no"), c("name_lat").alias("name_en"),
        c("age").cast("string").alias("age"), (F.floor(c("record_id") / 100) % 20).cast("int").alias("f"), "record_id",
    )


def _deliver(rows, folder, names):
    """One CSV file of sorted rows per f, in folders named by ``names``; equal rows give equal files."""
    files = rows.withColumn("file", names).where(c("file").isNotNull()).repartition("file").sortWithinPartitions("file", "record_id")
    files.drop("f", "record_id").write.mode("append").partitionBy("file").option("header", True).option("escape", '"').csv(folder)


@query(
    "stream_ingest",
    r_sql(
        f""", n AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY record_id) AS seq FROM (
          SELECT *, (record_id // 100) % 20 AS f FROM r)),
        k AS (SELECT *, row_number() OVER (PARTITION BY id_code ORDER BY seq, 'file=F' || f) AS nth FROM n WHERE name_lat IS NOT NULL)
        SELECT record_id, id_code, norm_name_lat AS name_lat, age,
          CASE WHEN id_code IS NOT NULL AND nth > 1 THEN 'DUPLICATE' ELSE {_STATUS_SQL} END AS status FROM k"""
    ),
)
def stream_ingest(spark, sf_dir):
    base = work_folder(spark, "stream-ingest")
    _deliver(_delivery(spark, sf_dir), f"{base}/in", F.concat(F.lit("F"), "f"))
    columns = ["serial_no", "epic_no", "name_en", "age"]
    ingest.ingest_files(
        spark, f"{base}/in/*", columns, f"{base}/table", f"{base}/checkpoint"
    ).awaitTermination()
    # Serial 0 falls back to the row position, so the record is known by its id in the raw row.
    key = F.get_json_object("raw", "$.serial_no").cast("bigint")
    return spark.read.parquet(f"{base}/table").select(key.alias("record_id"), "id_code", "name_lat", "age", "status")


_ONCE_SQL = f""", n AS (SELECT *, CASE WHEN f < 10 THEN 0 ELSE 1 END AS micro_batch, row_number() OVER (PARTITION BY f ORDER BY record_id) AS seq
    FROM (SELECT *, (record_id // 100) % 20 AS f FROM r)),
  k AS (SELECT *, row_number() OVER w AS nth, min(micro_batch) OVER (PARTITION BY id_code) AS first_batch,
      first_value(record_id) OVER w AS first_id
    FROM n WHERE name_lat IS NOT NULL WINDOW w AS (PARTITION BY id_code ORDER BY micro_batch, seq, 'file=F' || f)),
  i AS (SELECT *, id_code IS NOT NULL AND nth > 1 AS repeated, id_code IS NOT NULL AND first_batch < micro_batch AS stored FROM k)
"""


def _ingest_twice(spark, sf_dir):
    """Half of the files, then the other half with copies of a third of all files under other names."""
    base = work_folder(spark, "ingest-once")
    rows = _delivery(spark, sf_dir)
    for names in (
        [F.when(c("f") < 10, F.concat(F.lit("F"), "f"))],
        [F.when(c("f") >= 10, F.concat(F.lit("F"), "f")), F.when(c("f") % 3 == 0, F.concat(F.lit("copy of F"), "f"))],
    ):
        for name in names:
            _deliver(rows, f"{base}/in", name)
        ledger.ingest_once(spark, f"{base}/in/*", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return f"{base}/table"


@query(
    "ingest_once",
    r_sql(
        _ONCE_SQL
        + f"""SELECT record_id, micro_batch, id_code, norm_name_lat AS name_lat, age,
          CASE WHEN repeated THEN 'DUPLICATE' ELSE {_STATUS_SQL} END AS status, CASE WHEN stored THEN first_id END AS duplicate_of FROM i"""
    ),
)
def ingest_once(spark, sf_dir):
    stored = ledger.stored_records(spark, _ingest_twice(spark, sf_dir))
    key = F.get_json_object("raw", "$.serial_no").cast("bigint")
    numbered = stored.withColumn("key", key)
    firsts = numbered.select(c("record_id").alias("duplicate_of"), c("key").alias("first_key"))
    return numbered.join(firsts, "duplicate_of", "left").select(
        c("key").alias("record_id"), "micro_batch", "id_code", "name_lat", "age", "status", c("first_key").alias("duplicate_of")
    )


@query(
    "ingest_ledger",
    r_sql(
        _ONCE_SQL
        + """, s AS (SELECT f, micro_batch, count(*) AS n FROM i GROUP BY f, micro_batch)
        SELECT 'F' || f AS file, micro_batch, 'STORED' AS outcome, n AS n_records FROM s
        UNION ALL SELECT 'copy of F' || f, 1, 'SAME_CONTENT', 0 FROM s WHERE f % 3 = 0"""
    ),
)
def ingest_ledger(spark, sf_dir):
    found = ledger.ledger(spark, _ingest_twice(spark, sf_dir))
    name = F.url_decode(F.regexp_extract("source_path", "/file=([^/]*)/", 1))
    return found.select(name.alias("file"), "micro_batch", "outcome", "n_records")


# Every event updates some fields of its user's progress and leaves the others as they were.
_PROGRESS_FIELDS = ["percentage", "current_stage", "current_file"]
_PROGRESS_SQL = """
WITH u AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN (event_id % 101)::INTEGER END AS percentage,
    CASE WHEN event_id % 3 = 0 THEN upper(event_type) END AS current_stage,
    CASE WHEN event_id % 7 = 0 THEN 'file-' || event_id % 13 END AS current_file FROM events)
SELECT user_id, coalesce(last(percentage ORDER BY ts, event_id) FILTER (percentage IS NOT NULL), 0) AS percentage,
  coalesce(last(current_stage ORDER BY ts, event_id) FILTER (current_stage IS NOT NULL), 'QUEUED') AS current_stage,
  coalesce(last(current_file ORDER BY ts, event_id) FILTER (current_file IS NOT NULL), '') AS current_file,
  count(*) AS n_updates, max(ts) AS updated_at
FROM u GROUP BY user_id
"""


def _progress_updates(events):
    event = c("event_id")
    return events.select(
        "user_id", "event_id", "ts", F.when(event % 2 == 0, (event % 101).cast("int")).alias("percentage"),
        F.when(event % 3 == 0, F.upper("event_type")).alias("current_stage"),
        F.when(event % 7 == 0, F.concat(F.lit("file-"), event % 13)).alias("current_file"),
    )


@query("progress_merge", _PROGRESS_SQL)
def progress_merge(spark, sf_dir):
    updates = _progress_updates(table(spark, sf_dir, "events"))
    found = progress.merge_updates(updates, "user_id", "ts", "event_id", _PROGRESS_FIELDS)
    return found.withColumn("updated_at", c("updated_at").cast("timestamp_ntz"))


@query("progress_stream", _PROGRESS_SQL.replace("max(ts) AS", "date_trunc('millisecond', max(ts)) AS"))
def progress_stream(spark, sf_dir):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    progress.use_rocksdb(spark)
    try:
        updates = _progress_updates(ingest.table_stream(spark, f"{sf_dir}/events.parquet"))
        rows = ingest.run_to_table(
            progress.merge_updates_stream(updates, "user_id", "ts", "event_id", _PROGRESS_FIELDS, idle_seconds=400 * DAY), "progress"
        )
    finally:
        spark.conf.set(key, before)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct(*_PROGRESS_FIELDS, "n_updates", "updated_at"), "n_updates").alias("p"))
    shown = {f: F.coalesce(c(f"p.{f}"), F.lit(progress.INITIAL[f])).alias(f) for f in _PROGRESS_FIELDS}
    return last.select("user_id", *shown.values(), "p.n_updates", c("p.updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("search_log", "SELECT event_id, 'q' || event_type AS query FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def search_log(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("q"), "event_type").alias("query"))
    kept = audit.keep_latest(log, [c("ts").desc(), c("event_id").desc()], audit.KEEP_SEARCHES)
    return kept.select("event_id", "query")


