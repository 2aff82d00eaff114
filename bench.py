"""Times of the headline queries, as one line of JSON: median of three runs after one to warm up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loomtrace.operators import index, search  # noqa: E402
from loomtrace.plans import catalogue, scratch  # noqa: E402

SHAPES = {"common": "the", "medium": "with", "rare": "license", "long": "worthless", "either": r"worthless\|license", "none": "xyzzy_nonexistent_qqq"}
RUNS = 3


def run(df: DataFrame) -> float:
    at = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - at


def timed(make) -> float:
    run(make())
    return round(statistics.median(run(make()) for _ in range(RUNS)), 4)


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = scratch.folder(spark, "bench")
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    none = lambda kind: F.lit(None).cast(kind)
    parts = [table("documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.lit(1).alias("step_id"), "text"), table("conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("path"), (F.col("turn") + 1).cast("int").alias("step_id"), "text")]
    steps = parts[0].unionByName(parts[1]).select("path", "step_id", F.col("text").alias("message"), none("string").alias("reasoning_content"), none("array<struct<arguments_json:string>>").alias("tool_calls"), none("array<struct<content:string>>").alias("results"))
    steps.write.parquet(f"{folder}/steps")
    steps = spark.read.parquet(f"{folder}/steps")
    records = steps.groupBy("path").agg(F.min_by("message", "step_id").alias("first_msg")).select("path", "first_msg", F.col("path").alias("id"), F.lit("bench").alias("agent"), F.lit("").alias("timestamp"), F.monotonically_increasing_id().alias("disc_ord"), F.lit(1.0).alias("mtime"))
    records.write.parquet(f"{folder}/records")
    records = spark.read.parquet(f"{folder}/records")
    times: dict[str, float] = {}
    at = time.perf_counter()
    index.build(records, steps, f"{folder}/index")
    build = round(time.perf_counter() - at, 3)
    for name, query in SHAPES.items():
        times[f"grep_{name}"] = timed(lambda: search.grep(records, steps, query))
        times[f"index_{name}"] = timed(lambda: index.lookup(spark, f"{folder}/index", query))
        times[f"capped_{name}"] = timed(lambda: index.capped(index.lookup(spark, f"{folder}/index", query, snippets=False), records, steps, query))
    for name in ("conv_records", "token_estimate", "session_stats", "event_summary", "programs", "blame_write", "roundtrip_claude", "roundtrip_codex", "result_pairing", "snapshot_diff"):
        times[name] = timed(lambda: catalogue.QUERIES[name](spark, sf))
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "sum of medians of the headline queries", "value": total, "unit": "sec", "queries": times, "index_build_sec": build, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
