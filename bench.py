"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paneltide.plans import catalog  # noqa: E402
from paneltide.session import get_session  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ["a1_correlation_matrix", "x1_engle_granger_all_brands", "x4_half_life", "w3_engine_zscore", "w12_monthly_ols", "w10_rolling_cointegration", "k4_kalman_hedge", "k12_pair_selection", "k9_simulation", "a5_trade_metrics", "j7_daily_pnl", "x17_cscv_pbo"]


def main() -> None:
    spark = get_session(f"local[{CPUS}]", int(CPUS), os.environ.get("BENCH_MEMORY", "12g"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.time()
            catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
