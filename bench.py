"""Time the engine's queries: one JSON line with the median seconds of each.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4) and
BENCH_RUNS (default 3, after a warm-up run) set the input, threads and repeats.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from blocklog.operators import compaction, log, runs
from blocklog.plans.catalogue import QUERIES
from blocklog.sources.tables import BATCH, event_log

#: Streams run to their end once each; they start files and threads of their own.
ONCE = ("stream_ingest", "stream_put")


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, repeats = os.environ.get("BENCH_CPUS", "4"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name, query in QUERIES.items():
        if name in ONCE:
            found[name] = round(timed(lambda q=query: drain(q(spark, d))), 4)
            continue
        drain(query(spark, d))
        found[name] = round(statistics.median(timed(lambda q=query: drain(q(spark, d))) for _ in range(repeats)), 4)
    rows = event_log(spark, d)
    written, placed = rows.count(), log.place(rows, BATCH).count()
    inputs = runs.event_runs(rows)
    kept = compaction.merge_runs([inputs]).count()
    extra = {"write_amplification": round(placed / written, 6), "compaction_survivors": round(kept / inputs.count(), 6)}
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "sf": d.rsplit("sf", 1)[-1]} | extra))
    spark.stop()


if __name__ == "__main__":
    main()
