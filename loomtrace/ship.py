"""The package itself as an archive for executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def archive(folder: str | None = None) -> str:
    """The package's modules as a zip file that Python can import from; its path."""
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(folder or tempfile.mkdtemp(prefix="loomtrace-"), "loomtrace.zip")
    with zipfile.ZipFile(out, "w") as z:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(root)))
    return out


def ship(spark: SparkSession) -> None:
    """Send the package to all executors of a session, for its functions that run in Python there. Not needed where it is installed."""
    spark.sparkContext.addPyFile(archive())
