"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query is planned and
run in full into a sink that discards rows, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from almanac.queries import REGISTRY  # noqa: E402
from almanac.queries.base import Tables  # noqa: E402
from almanac.session import local_session  # noqa: E402

HEADLINE = [
    "daily_risk",
    "api_analysis_summary",
    "a3_ingest_csv",
    "b6_read_sanitize",
    "c2_anti_join_dedup",
    "c8_last_use_join",
    "d12_trigger_usage_all",
    "d13_medication_usage",
    "d17_weather_daily_rollup",
    "e1_dense_timeline",
    "e12_inference_lags",
    "e13_circadian_prior",
    "e14_logging_streak",
    "i1_build_features",
    "i3_correlation_pairs",
    "j1_heuristic_daily",
    "j5_hourly_forecast",
    "j7_weekly_forecast",
    "l5_rename_cascade",
    "k1_train_hurdle",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    # Start the executors and the Parquet reader before the clock does.
    spark.read.parquet(f"{directory}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        REGISTRY[name].run(Tables(spark, directory)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    scale = directory.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
