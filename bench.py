"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all), BENCH_RUNS (default 3).
Every query is run once to warm up and then BENCH_RUNS times into a no-op sink, which computes
every row and column without moving them to the driver; the median is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from marketlake.queries import REGISTRY
from marketlake.session import build_session

HEADLINE = [
    "session_volume",
    "silver_bars",
    "daily_bars",
    "history_bars",
    "prev_close_by_bar",
    "trading_dates",
    "market_status",
    "market_status_history",
    "reference_closes",
    "performance",
    "close_of_day_cache",
    "seed_cache",
    "tracked_universe",
    "watchlist_report",
    "positions_report",
    "portfolio_totals",
    "normalize_ticks",
    "enriched_ticks",
    "latest_tick",
    "cache_merge",
    "tick_direction",
    "apply_watchlist_changes",
    "apply_position_changes",
    "missing_sessions",
    "csv_to_bronze",
    "silver_overwrite",
    "stream_cache",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or [q for q in HEADLINE if q in REGISTRY]
    spark = build_session(
        "marketlake-bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE", "8"),
            "spark.driver.memory": "8g",
            # tiny shuffles on one machine: keep a partition per core instead of merging to 1 MB
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:] or seconds), 3)
        print(name, timings[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
