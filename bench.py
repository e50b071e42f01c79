"""Time the headline queries and print one JSON line.

Every query is run once to compile its plan and then for the clock, into a sink
that takes all rows and keeps none: three times if it is quick, of which the
median counts, else once.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from checks.queries import queries
from checks.session import local_session

HEADLINES = (
    "dedup_latest_version", "anchor_times", "anchor_calls_tied", "registry_membership", "order_rollup",
    "call_mart", "call_mart_fan_out", "month_files_parquet", "filter_options", "filtered_population",
    "kpi_totals", "funnel_daily", "funnel_weekly", "funnel_monthly", "funnel_table_weekly",
    "funnel_from_extract", "week_cards", "period_comparison", "trend_weekly", "trend_by_center",
    "snapshot_by_tenure", "agent_scorecard", "agent_distribution", "lift_weekly", "lift_summary",
    "lift_trend_swing_by_mover",
    "mart_from_tables", "call_mart_one", "anchor_calls_one", "month_refresh_midmonth", "funnel_from_written_rollup",
    "month_refresh_moved_calls", "mart_over_a_seam", "anchor_classes", "default_window_of_mart", "lift_weekly_from_table",
)

QUICK = 4  # seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    registered, seconds = queries(), {}
    for name in HEADLINES:
        timed: list[float] = []
        while len(timed) < 2 or (len(timed) < 4 and timed[1] < QUICK):
            began = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - began)
        seconds[name] = round(median(timed[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
