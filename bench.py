"""Time the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spendlens.plans import catalog  # noqa: E402
from spendlens.session import local_session  # noqa: E402

HEADLINE = (
    "campaign_performance", "executive_dashboard_all_months", "campaign_summary_range", "trend_cpl_month", "partner_pipeline_health",
    "churn_probability", "risk_drivers", "flare_scores", "churn_waterfall", "partner_rollup", "partner_opportunities",
    "campaign_rollup", "trajectories", "diagnosis", "metric_panel", "clean_amounts", "unicode_text_compat", "upsert",
    "unseen_rows", "benchmark_file_rows", "last_executions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session("spendlens-bench", os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # Two queries warm up the session; then every query runs once for code and file caches, and the best later run counts.
    for name in names[:2]:
        run(name)
    timings = {}
    for name in names:
        runs = [run(name) for _ in range(repeats)]
        timings[name] = round(min(runs[1:] or runs), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries, warm",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "median": round(statistics.median(timings.values()), 3),
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": os.environ.get("BENCH_CPUS", "8"),
            }
        )
    )


if __name__ == "__main__":
    main()
