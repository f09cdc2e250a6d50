"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Bars and labels are built first (their own times are reported as `bars` and `triple_barrier`)
and kept, as stored tables are in a deployment. Every query is run twice with all rows computed;
the better time counts, so JVM warm-up is left out.
"""

from __future__ import annotations

import json
import os
import time

from barwright.plans.catalog import QUERIES, bars, labels
from barwright.session import build_session

HEADLINE = [
    "bars", "normalized_bars", "merged_bars", "missing_ranges", "daily_vol", "triple_barrier", "triple_barrier_hourly",
    "feat_realized_vol_multi", "feat_volume_context", "feat_vwap_distance", "feat_technical_indicators",
    "feat_order_flow_proxies", "feature_matrix", "uniqueness_weights", "fit_weights", "daytrade_window", "daytrade_cap",
    "trades", "threshold_sweep", "policy_compare", "confusion_report", "session_rollup", "runlog_flat", "leaderboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    bars(spark, sf_dir).count()
    labels(spark, sf_dir).count()
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
