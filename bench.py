"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from quotemill.plans.queries import QUERIES
from quotemill.session import build_session

HEADLINE = (
    "ticks",
    "daily_bars",
    "daily_bars_traded",
    "minute_bars",
    "five_minute_rollup",
    "latest_by_symbol",
    "tick_direction",
    "running_high_low",
    "market_board",
    "prices_with_sentiment",
    "training_view",
    "mention_pairs",
    "related_companies",
    "recursive_indicators",
    "feature_frame",
    "alpha_scores",
    "prediction_accuracy",
    "latency_quantiles",
    "counter_rates",
    "article_links",
    "stream_daily",
    "warehouse_daily",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "quotemill-bench",
        cores,
        **{
            "spark.sql.shuffle.partitions": cores,
            # the benchmark files are small: smaller splits let every core read
            "spark.sql.files.maxPartitionBytes": "4m",
            "spark.sql.files.openCostInBytes": "1m",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
