"""Time the headline queries; prints one JSON line.

Every query is run to its last row (no-op sink), after one warm-up query on the same tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from weekpanel.session import build_session
from weekpanel.workload import load

HEADLINE = [
    "weekly_bars", "price_features", "company_frames", "correlation_report", "price_quantiles",
    "select_universe", "pit_fundamentals", "panel_merge",
    "news_bounds_dedup", "summary_classes", "market_week_counts", "weekly_news_features", "granger_weekly_score",
    "modeling_table", "scores_with_cache", "balanced_sample", "confusion_report", "best_vs_baselines", "tfidf_long", "knn_vote",
    "var_coefficients", "granger_pvalues", "fact_market", "star_top_up", "stream_weekly_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load()
    registry["weekly_volume"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
