"""Time the headline queries; prints one JSON line.

Every query is run to a sink that discards rows. ``ledger_build`` is the
derivation of the ledger tables, which the other queries read as Parquet;
``lineage`` walks the chains anew, the queries after it read the written table.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))

from lotwise.plans.catalogue import QUERIES, Inputs  # noqa: E402
from lotwise.session import configure, release  # noqa: E402

HEADLINE = [
    "open_lots",
    "portfolio",
    "account_transfers",
    "distributor_switches",
    "quote_variation",
    "lineage",
    "gain_report",
    "enriched_lineage",
    "portfolio_between",
    "portfolio_report",
    "evolution",
    "evolution_weeks",
    "return_series",
    "resolve_subscriptions",
    "resolve_transfers",
    "backfill_on_quote",
    "append_quotes",
    "assign_order_ids",
    "fifo_allocate_shares",
    "fifo_allocate_lots",
    "validate_ledger",
    "replay_ledger",
    "layout_subscription",
    "read_quote_csv_feed",
    "stream_quote_ingest",
]


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lotwise-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    inputs = Inputs(configure(spark), folder)
    spark.range(1).collect()
    seconds = {"ledger_build": timed(lambda: inputs.ledger.tables())}
    names = sys.argv[1:] or HEADLINE
    for name in names:
        if name == "gain_report":
            # The written table is part of no single query's time.
            seconds["lineage_table"] = timed(lambda: inputs.lineage)
        seconds[name] = timed(
            lambda: QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        )
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
