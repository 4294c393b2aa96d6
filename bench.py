"""Time the headline queries on local Spark and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the number of threads and
``BENCH_QUERIES`` (comma-separated) replaces the list below. Raw and clean trips are
landed first, timed as ``land_trips``; every query is then run twice in full
(written to the noop sink) and the faster run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tripflow.plans import inputs  # noqa: E402
from tripflow.plans.catalog import QUERIES  # noqa: E402
from tripflow.session import build_session  # noqa: E402

HEADLINE = [
    "clean_yellow", "clean_fhvhv", "clean_rejects", "profile_nulls", "profile_percentiles",
    "zone_demand", "zone_demand_by_service", "pickups_by_band", "monthly_trips", "heatmap_hour_dow",
    "market_share", "wait_trend", "tip_dist_borough", "od_tip_matrix", "zone_period",
    "cost_by_zone_hour", "od_flows", "demand_levels", "wealth_index", "join_weather", "rain_demand",
    "spatial_within", "events_by_zone", "event_road_match", "text_normalize", "keyword_category",
    "demand_panel", "feature_panel", "sliding_windows", "multi_horizon_error", "tip_baseline",
    "top_n_accuracy", "stratified_sample_exact", "insights_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    threads = os.cpu_count() if cpus == "*" else int(cpus)
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": str(threads), "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings: dict[str, float] = {}
    start = time.perf_counter()
    inputs.yellow_trips(spark, sf_dir)
    inputs.fhvhv_trips(spark, sf_dir)
    timings["land_trips"] = round(time.perf_counter() - start, 3)
    for name in names:
        timings[name] = round(min(run(name), run(name)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
