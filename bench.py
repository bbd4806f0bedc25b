"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_RUNS (timed runs per
query after one warm-up; the median counts), BENCH_QUERIES (names, comma separated).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from recordlake.plans import load
from recordlake.session import local_session

HEADLINE = [
    "norm_latin", "norm_devanagari", "translit_to_dev", "token_search",
    "canonical_records", "card_fields", "content_hash", "json_items",
    "ingest_rule_errors", "field_issues", "validation_queue", "apply_decisions", "import_report", "orphans",
    "lookup_left", "lineage", "group_size", "hierarchy_rollup",
    "dup_summary", "dup_members", "dup_age_range", "household_of",
    "search_fuzzy", "search_text", "facets", "search_batch", "top_k_per_query", "trigram_search", "trigram_join",
    "system_stats", "age_bands", "audit_query", "redact_json", "apply_updates",
    "trailing_count", "rate_limit", "latest_state", "log_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=max(8, int(cores) if cores.isdigit() else 8), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load().QUERIES

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        warm = run(name)
        timed = [run(name) for _ in range(runs)]
        seconds[name] = round(statistics.median(timed or [warm]), 3)
        print(f"{name}: first {warm:.2f}s, then {seconds[name]:.2f}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
