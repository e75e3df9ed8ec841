"""Benchmark the headline operators.

Runs each operator over the role views of ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is fully executed into Spark's ``noop`` sink (all stages run, no
rows are brought to the driver). Every query runs ``$BENCH_REPEAT`` times
(default 3) after one warm-up of the session; the best time is reported.
``BENCH_KEYS=all`` times every registry key instead of the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.registry import QUERIES  # noqa: E402
from ledgerlens.session import local_session, scratch_tables  # noqa: E402

HEADLINE = [
    "activation_curve",
    "checkout_funnel",
    "cohort_retention",
    "product_engagement",
    "cart_abandonment",
    "mrr_movements",
    "trial_conversion",
    "revenue_retention",
    "feature_adoption",
    "expansion_revenue",
    "active_paying_accounts",
    "plan_breakdown",
    "first_events",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    keys = list(QUERIES) if os.environ.get("BENCH_KEYS") == "all" else HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="ledgerlens-bench")

    QUERIES["plan_breakdown"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up

    times: dict[str, float] = {}
    for key in keys:
        best = float("inf")
        for _ in range(repeat):
            with scratch_tables(spark):
                t0 = time.perf_counter()
                QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - t0)
        times[key] = round(best, 3)
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {
        "metric": "total_seconds_headline_operators" if keys is HEADLINE else "total_seconds_all_keys",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
