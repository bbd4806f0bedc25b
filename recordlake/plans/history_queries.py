"""Histories of records and percentiles that merge, over the event table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import history
from ..session import cut_lineage, work_folder
from ..streaming import logs, quantiles
from .registry import query
from .views import table

c = F.col

_TIMES = ["2024-01-08 00:00:00", "2024-01-16 12:00:00", "2024-02-01 00:00:00"]
# The first change brings all events but the purchases, the second all purchases (most of them late), the third the first one again.
_STATES_SQL = """WITH s AS (SELECT user_id, ts AS valid_from, event_type = 'error' AS deleted, event_id, event_type, value,
    row_number() OVER (PARTITION BY user_id, ts ORDER BY event_type <> 'purchase' DESC, event_id DESC) AS nth FROM events),
  h AS (SELECT user_id, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to, deleted,
    event_id, event_type, value FROM s WHERE nth = 1)
"""


def _stored(spark, sf_dir):
    path = work_folder(spark, "history")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    bought = c("event_type") == "purchase"
    for changes in (events.where(~bought), events.where(bought), events.where(~bought)):
        history.apply_changes(changes, path, "user_id", "ts", deleted=c("event_type") == "error", buckets=8, splits=2)
    return path


def _plain(states):
    return states.withColumns({x: c(x).cast("timestamp_ntz") for x in ("valid_from", "valid_to")})


@query("record_history", _STATES_SQL + "SELECT * FROM h")
def record_history(spark, sf_dir):
    states = history.history(spark, _stored(spark, sf_dir))
    return _plain(states).select("user_id", "valid_from", "valid_to", "deleted", "event_id", "event_type", "value")


@query(
    "record_as_of",
    _STATES_SQL
    + f"""SELECT t AS at, user_id, event_id, event_type, value FROM h, (SELECT unnest({_TIMES}) AS t)
    WHERE NOT deleted AND valid_from <= CAST(t AS TIMESTAMP) AND (valid_to IS NULL OR valid_to > CAST(t AS TIMESTAMP))""",
)
def record_as_of(spark, sf_dir):
    path = _stored(spark, sf_dir)
    found = [history.as_of(spark, path, t).select(F.lit(t).alias("at"), "user_id", "event_id", "event_type", "value") for t in _TIMES]
    return found[0].unionByName(found[1]).unionByName(found[2])


_WIDTH = math.log((1 + quantiles.ACCURACY) / (1 - quantiles.ACCURACY))
_SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _middle(value: str) -> str:
    """The middle of the bin of a true percentile, above 0."""
    return f"round(exp(ceil(ln({value}) / {_WIDTH!r}) * {_WIDTH!r}) * {2 / (1 + math.exp(_WIDTH))!r}, 6)"


def _exact_sql(rows: str, by: str, value: str, shares: dict[str, float]) -> str:
    """Percentiles by sorting all values, then each brought to the middle of its bin."""
    picked = ", ".join(f"{_middle(f'min(CASE WHEN nth >= greatest(1, ceil({q} * n)) THEN v END)')} AS {name}" for name, q in shares.items())
    return f"""WITH v AS ({rows}),
    k AS (SELECT {by}, {value} AS v, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS nth, count(*) OVER (PARTITION BY {by}) AS n FROM v)
    SELECT {by}, any_value(n) AS n, {picked} FROM k GROUP BY {by}"""


def _rounded(found, shares):
    return found.withColumns({name: F.round(name, 6) for name in shares})


@query("log_percentiles", _exact_sql("SELECT *, CAST(ts AS DATE) AS day FROM events WHERE value > 0", "day, event_type", "value", _SHARES))
def log_percentiles(spark, sf_dir):
    """Hours are counted and stored; days come from the stored hours."""
    events = table(spark, sf_dir, "events").where("value > 0")
    hours = cut_lineage(quantiles.window_sketch(events, "ts", "value", ["event_type"]), "hours")
    days = hours.select(F.to_date("window_start").alias("day"), "event_type", "place", "n")
    return _rounded(quantiles.quantiles(days, ["day", "event_type"], _SHARES), _SHARES)


_SESSION_SHARES = {"p50": 0.5, "p90": 0.9}
_SESSIONS_SQL = """SELECT CAST(first_ts AS DATE) AS day, date_diff('microsecond', first_ts, last_ts) / 1e6 + 1 AS seconds FROM (
  SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM (
    SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, no)"""


@query("session_percentiles", _exact_sql(_SESSIONS_SQL, "day", "seconds", _SESSION_SHARES))
def session_percentiles(spark, sf_dir):
    """How long sessions last, a session of one entry one second, by the day they begin."""
    found = logs.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    lasting = found.select(
        F.to_date("first_ts").alias("day"), (F.expr("unix_micros(last_ts) - unix_micros(first_ts)") / 1e6 + 1).alias("seconds")
    )
    sketches = quantiles.sketch(lasting, ["day"], "seconds")
    return _rounded(quantiles.quantiles(sketches, ["day"], _SESSION_SHARES), _SESSION_SHARES)
