"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) with
local[$BENCH_CPUS]. Each query is executed in full through the ``noop`` sink (no collect);
after one warm-up pass the median of $BENCH_RUNS timed runs is reported. Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_features",        # flagship: leak-free feature table (windows, pivot, h2h)
    "pit_win_perc",
    "pit_rolling_50",
    "pit_matches_7d",
    "lagged_range_count",
    "pit_h2h",
    "asof_rank_join",
    "first_last_runner",
    "join_winner_loser",
    "backtest",
    "summary_by_category",
    "kpi_by_strategy",
    "elo_ratings",
    "bankroll_sim",
    "map_cascade",
    "pricing",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from courtline.plans.catalog import REGISTRY
    from courtline.session import build_session

    spark = build_session(f"local[{cpus}]", app="courtline-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    names = only or HEADLINE
    timings = {}
    for name in names:
        fn = REGISTRY[name].fn

        def once():
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        once()  # warm-up (JIT, Python workers, file listing)
        timings[name] = round(statistics.median(once() for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
