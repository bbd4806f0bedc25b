"""Run a registered query and its DuckDB counterpart on the same tables and compare all rows.

As a script: ``python tests/compare.py [scale] [query ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return f"{type(value).__name__}:{value}"


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, con=None, on_plan=None) -> str:
    """Empty when equal, else what differs. ``on_plan`` is given the plan before it runs."""
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, sf_dir)
    if on_plan:
        on_plan(df._jdf.queryExecution().executedPlan().toString())
    got = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = (con or connect(sf_dir)).execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return "" if a else "equal, but no rows"
    left = [x for x in a if x not in set(b)][:2]
    right = [x for x in b if x not in set(a)][:2]
    return f"{len(a)} rows, expected {len(b)}; only Spark: {str(left)[:600]}; only DuckDB: {str(right)[:600]}"


if __name__ == "__main__":
    from recordlake.session import local_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/{scale}"
    con = connect(sf_dir)
    bad = []
    for q in sys.argv[2:] or list(queries()):
        start = time.time()
        try:
            problem = compare(spark, sf_dir, q, con)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        mark = "ok " if not problem else "BAD"
        print(f"{mark} {time.time() - start:6.1f}s {'O' if q in oracle_sql() else 'R'} {q} {problem}", flush=True)
        if problem:
            bad.append(q)
    print(f"{len(bad)} of {len(sys.argv[2:] or queries())} differ: {bad}")
