"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the `noop` sink (every row computed, nothing
collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.registry import queries  # noqa: E402
from ledgerlens.session import get_spark  # noqa: E402

HEADLINE = [
    "clean_sales_view",
    "daily_gapfilled",
    "kpi_snapshot",
    "kpi_by_product_region",
    "growth_short_series",
    "rollup_any",
    "weekday_by_region",
    "top_products_by_region",
    "product_region",
    "heatmap",
    "data_quality",
    "anomalies_by_region",
    "insights_by_region",
    "executive_summary_by_product",
    "risk",
    "answers",
    "screen_signups",
    "active_sessions",
    "moving_average_forecast",
    "forecast_metrics",
    "supervised_features",
    "ets_forecast",
    "arima_forecast",
    "model_comparison",
    "forest_forecast",
    "boosting_forecast",
    "parse_date_layouts",
    "screen_odd_signups",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    event_dir = tempfile.mkdtemp(prefix="ledgerlens-events-")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir})
    qs = queries()
    # warm-up: JVM, parquet footers and Python workers, not timed
    qs["daily_revenue"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        spark.catalog.clearCache()  # else a later query reads what an earlier one persisted
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None,
                      "cpus": int(cpus), "event_log": event_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
