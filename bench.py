"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     runs per query, the fastest counts (default 2)
BENCH_QUERIES  comma-separated names instead of the default list
BENCH_SQL      1: also time the same SQL in DuckDB, for comparison
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sojourn import catalog  # noqa: E402
from sojourn.session import build_session  # noqa: E402

HEADLINE = (
    "episode_match", "episode_horizons", "episode_cohorts", "orders_reentry", "modeling_dataset",
    "prior_volume", "rolling_daily_requests", "context_features",
    "cohort_summary", "adopted_timing", "archetypes", "profile_contrasts", "cohort_finder", "similar_cases",
    "price_quantiles", "classification_report", "ranking_areas", "threshold_grid", "operating_points",
    "frozen_thresholds", "cohort_reliability", "error_slices_regression", "bootstrap_intervals",
    "survival_of_lines", "product_limit_points", "missingness", "attrition",
    "target_encode_oof", "winsorize", "expanding_folds", "text_rules", "coefficients", "boosting_models", "parameter_search",
)


def sql_seconds(folder: str, names: list[str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads TO {os.environ.get('BENCH_CPUS', '8')}")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    out = {}
    for name in names:
        if name in catalog.all_sql():
            start = time.perf_counter()
            con.sql(catalog.all_sql()[name]).fetchall()
            out[name] = round(time.perf_counter() - start, 3)
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    result = {
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    if os.environ.get("BENCH_SQL") == "1":
        result["sql_queries"] = sql_seconds(folder, names)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
