"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs its whole plan into a no-op sink. The first query is run once
untimed, so that JVM start-up is not counted.
"""

from __future__ import annotations

import json
import os
import time

from barloom.session import local_session
from suite import QUERIES

HEADLINE = [
    "C01_daily_bar_build", "C10_seed_factors", "weights_top20_momentum", "W10_indicator_table", "J04_interval_join",
    "J07_visible_items_all_days", "J09_index_size_history", "W16_member_intervals", "A07_factor_coverage", "A08_factor_distribution",
    "A14_quintile_forward_returns", "W13_market_percentile", "C12_target_weights", "C17_portfolio_series", "C19_experiment_matrix",
    "C21_security_cards", "C28_blocked_days", "ST4_window_bars_tumbling",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["W01_daily_return"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
