"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pathweave.plans import catalog  # noqa: E402
from pathweave.plans.session import configure  # noqa: E402

HEADLINE = (
    "lookback_uid",
    "lookback_bucketed",
    "merge_matches_4",
    "lookback_intent_30d",
    "lookback_session_14d",
    "lookback_curve",
    "cumulative_by_channel",
    "avg_clicks_by_window",
    "channels_per_path",
    "dedup_clicks",
    "dedup_volume",
    "resolve_session_xid",
    "anonymous_sessions",
    "vertical_counts",
    "category_breadth",
    "specificity_volume",
    "session_enrich",
    "pairs_unordered",
    "pairs_ordered",
    "weighted_edges",
    "presence_string",
    "channel_mask",
    "pair_lift",
    "two_key_join",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)

    def timed(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)  # generated code is compiled once
        seconds[name] = round(timed(name), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
