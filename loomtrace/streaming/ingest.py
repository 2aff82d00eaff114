"""Session lines as a stream, for stores that only ever gain files.

Spark's file source takes each file once, so files that are still written to belong to the batch refresh. Finished
sessions that are dropped into a landing folder can be ingested as they come.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import decode, text
from ..operators import sessions


def landed(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """(path, value) of files in a landing folder, each whole, as a stream."""
    read = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", per_batch).format("text").load(folder)
    return read.select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), "value")


def _run(spark: SparkSession, checkpoint: str) -> str:
    """A name for a checkpoint's life: its first moment, then the id that Spark gave the query."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/metadata")
    since = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    return f"{since:015d}-{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}"


def ingest(spark: SparkSession, folder: str, fmt: str, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Parse landed sessions to ``out``/steps and ``out``/trajectories. Each micro-batch parses its own files by the batch plan.

    Batches are numbered below the name of their checkpoint: a batch that is repeated after a failure writes to its own
    folder again, and one of a later checkpoint, whose numbers begin anew, to another. ``ingested`` reads what they wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        run = _run(spark, checkpoint)
        lines = batch.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("line_no", "value"))
        step, traj = sessions.parse(lines, fmt)
        for name, df in (("steps", step), ("trajectories", traj)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/run={run}/batch={number}")

    return landed(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    """``steps`` or ``trajectories`` as they were ingested: of a session that several checkpoints read, what the last one made of it."""
    read = spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}").withColumn("run", F.col("run").cast("string"))
    last = read.groupBy("path").agg(F.max("run").alias("run"))
    return read.join(last, ["path", "run"], "left_semi").drop("run", "batch")


def matches(stream: DataFrame, query: str, column: str = "value") -> DataFrame:
    """A standing search: rows of a stream whose text matches, with their surroundings. Stateless, so it needs no watermark."""
    clauses = text.parse_query(query)
    return stream.where(text.matches(F.col(column), clauses)).withColumn("snippet", text.snippet(F.col(column), [w for c in clauses for w in c]))


def event_counts(stream: DataFrame, fmt: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by name and time window of a stream of (path, line_no, value); what is later than ``late`` is left out."""
    ev = stream.mapInArrow(decode.batches(fmt), f"path string, line_no long, {decode.EVENT}")
    timed = ev.withColumn("at", F.try_to_timestamp("ts")).where("at is not null and name is not null")
    return timed.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "name").count().select(F.col("w.start").alias("start"), "name", "count")
