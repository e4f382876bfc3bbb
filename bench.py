"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's plan is executed in full with the `noop` sink (no collect to the driver); the time includes
any fit passes the query runs before returning its DataFrame.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "composite_risk", "spatial_density", "risk_summary", "prep_pipeline", "clip_iqr", "impute_median",
    "scale_robust", "split_stratified", "fold_assign", "validate_issues", "roc_auc", "average_precision",
    "classification_report", "chart_map_grid", "isolation_forest_score", "score_new",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    from riskflow.session import get_spark
    from riskflow.plans.registry import load_all
    spark = get_spark(f"local[{cpus}]", int(cpus))
    reg = load_all()
    times = {}
    for name in names:
        fn = reg[name][0]
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
