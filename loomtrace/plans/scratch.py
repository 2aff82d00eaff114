"""Folders for written intermediate tables, deleted when the driver ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}
_LOCAL: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="loomtrace-"))
        _MADE[_LOCAL[0]] = spark
    return _LOCAL[0]


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What is written there stays until ``drop`` or the end of the driver."""
    where = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE[where] = spark
    return where


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read from there: nothing before it is computed again, wherever executors are lost."""
    where = folder(df.sparkSession, name)
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out._loomtrace_folder = where
    return out


def drop(made: DataFrame | str) -> None:
    """Delete a table of ``keep`` (or a folder) that no result reads any more."""
    where = made if isinstance(made, str) else made._loomtrace_folder
    spark = _MADE.pop(where, None)
    if spark is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _end() -> None:
    for where in list(_MADE):
        try:
            drop(where)
        except Exception:  # the session has ended before: what it made is left to the shared folder's own upkeep
            pass
