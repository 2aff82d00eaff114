"""Session files as lines.

Files are listed by the driver through Hadoop's file system, since which folders count is a rule of paths and not of
content; folders of the local file system are walked without it. Files are dealt to tasks by their number and size, which
neither lists a folder again nor takes a task per file. ``line_no`` counts physical lines from 0, blank ones included.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode


@dataclass(frozen=True)
class Store:
    """Where a kind of sessions is kept, below the home folder. ``globs``: patterns below ``root``, ``**`` for any depth."""

    agent: str
    prefix: str
    root: str
    globs: tuple[str, ...]
    fmt: str | None  # None: found, but never read


STORES = {
    "claude": Store("claude", "cl", ".claude/projects", ("**/*.jsonl",), "claude"),
    "codex": Store("codex", "cx", ".codex/sessions", ("**/rollout-*.jsonl",), "codex"),
    "codex_all": Store("codex", "cx", ".codex/sessions", ("**/*.jsonl",), "codex"),
    "copilot": Store("copilot", "cp", ".copilot/session-state", ("*/events.jsonl",), "copilot"),
    "agent_probe": Store("agent_probe", "ap", ".local/share/agent_probe", ("*/*/*.jsonl",), "agent_probe"),
    "pi": Store("pi", "pi", ".pi/agent/sessions", ("**/*.jsonl",), None),
    "cursor": Store("cursor", "cu", ".cursor", ("sessions/**/*.jsonl", "projects/**/*.jsonl"), None),
}
SCHEMA = "path string, mtime double, size long, ord long"

#: Files and bytes that a task reads, and signs of lines that it hands on at a time.
FILES, BYTES, SIGNS = 1000, 32 << 20, 4 << 20


def _pattern(glob: str) -> re.Pattern:
    parts = [re.escape(p).replace(r"\*", "[^/]*") if p != "**" else "**" for p in glob.split("/")]
    return re.compile("/".join(parts).replace("**/", "(?:.*/)?") + r"\Z")


def _listed(spark: SparkSession, root: str) -> tuple[str, list[tuple[str, float, int]]]:
    """A folder's path and all files below it, by Hadoop's file system."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = base.toUri().getPath().rstrip("/")
    found: list[tuple[str, float, int]] = []
    if fs.exists(base):
        it = fs.listFiles(base, True)
        while it.hasNext():
            f = it.next()
            found.append((f.getPath().toUri().getPath(), f.getModificationTime() / 1000, f.getLen()))
    return top, found


def _walked(top: str) -> Iterator[tuple[str, float, int]]:
    """All files below a local folder, through links too; what vanishes meanwhile is left out."""
    for where, _, names in os.walk(top, followlinks=True):
        for name in names:
            path = f"{where}/{name}"
            try:
                told = os.stat(path)
            except OSError:
                continue
            yield path, told.st_mtime_ns // 1_000_000 / 1000, told.st_size


def list_files(spark: SparkSession, root: str, globs: tuple[str, ...]) -> list[tuple[str, float, int]]:
    """(path, mtime in seconds, size) of files below ``root`` that fit a pattern: in the order of patterns, then of paths, each once."""
    if "://" in root and not root.startswith("file://"):
        top, found = _listed(spark, root)
    else:
        top = os.path.abspath(os.path.expanduser(root.removeprefix("file://"))).rstrip("/")
        found = list(_walked(top))
    out: dict[str, tuple[str, float, int]] = {}
    for glob in globs:
        fits = _pattern(glob)
        for f in sorted(found, key=lambda f: f[0].split("/")):
            if fits.match(f[0][len(top) + 1 :]):
                out.setdefault(f[0], f)
    return list(out.values())


def store_root(home: str, name: str) -> str:
    own = os.environ.get("PI_CODING_AGENT_DIR")
    if name == "pi" and own:
        return os.path.join(own, "sessions")
    return os.path.join(home, STORES[name].root)


def files(spark: SparkSession, home: str, name: str) -> DataFrame:
    """Files of a store: path, mtime, size, and their place in the order of discovery."""
    found = list_files(spark, store_root(home, name), STORES[name].globs)
    return spark.createDataFrame([(*f, i) for i, f in enumerate(found)], SCHEMA)


def project_files(spark: SparkSession, home: str, folder: str) -> DataFrame:
    """Files right in the folder that is named after a project's path; no other folder is listed."""
    name = re.sub("[^a-zA-Z0-9]", "-", folder)
    found = list_files(spark, os.path.join(home, STORES["claude"].root, name), ("*.jsonl",))
    return spark.createDataFrame([(*f, i) for i, f in enumerate(found)], SCHEMA)


def _read(batches):
    """Texts of local files, cut into lines; a batch of lines ends after ``SIGNS`` signs."""
    path, number, value, held = [], [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(number, pa.int64()), pa.array(value, pa.string())], ["path", "line_no", "value"])

    for b in batches:
        for p in b.column("path").to_pylist():
            with open(p, "rb") as f:
                content = f.read().decode("utf-8", "replace")
            for i, line in enumerate(re.split("\r\n|\n|\r", content)):
                path.append(p)
                number.append(i)
                value.append(line)
                held += len(line) + 100
                if held > SIGNS:
                    yield batch()
                    path, number, value, held = [], [], [], 0
    yield batch()


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, line_no, value) of text files: each file is read whole, so that lines keep their number."""
    paths = list(dict.fromkeys(paths))
    local = [p.removeprefix("file://") for p in paths if "://" not in p or p.startswith("file://")]
    out = _local_lines(spark, local)
    others = [p for p in paths if "://" in p and not p.startswith("file://")]
    if not others:
        return out
    read = spark.read.text(others, wholetext=True)
    named = read.select(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), "value")
    cut = named.select("path", F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("line_no", "value"))
    return out.unionByName(cut.withColumn("line_no", F.col("line_no").cast("long")))


def _local_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    schema = "path string, line_no long, value string"
    if not paths:
        return spark.createDataFrame([], schema)
    size = {p: os.path.getsize(p) for p in paths}
    n = min(len(paths), max(spark.sparkContext.defaultParallelism, -(-len(paths) // FILES), -(-sum(size.values()) // BYTES)))
    paths = sorted(paths, key=lambda p: (-size[p], p))
    dealt = [p for i in range(n) for p in paths[i::n]]  # each task has large and small ones
    return spark.createDataFrame(spark.sparkContext.parallelize([(p,) for p in dealt], n), "path string").mapInArrow(_read, schema)


def sniff(line: DataFrame) -> DataFrame:
    """(path, fmt): the format that most of a file's first 30 lines speak for; ties go claude, codex, copilot, agent_probe; files without a sign are left out."""
    order = ["claude", "codex", "copilot", "agent_probe"]
    ev = line.where("line_no < 30").mapInArrow(decode.batches("claude"), f"path string, line_no long, {decode.EVENT}")
    votes = ev.select("path", F.explode("votes").alias("fmt")).groupBy("path", "fmt").count()
    place = F.array_position(F.array(*(F.lit(f) for f in order)), F.col("fmt"))
    return votes.groupBy("path").agg(F.max_by("fmt", F.struct("count", (-place).alias("p"))).alias("fmt"))


def folder_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files of further folders, folder by folder; what is no folder is skipped."""
    found: list[tuple] = []
    for f in folders:
        if "://" in f or os.path.isdir(os.path.expanduser(f)):
            found += list_files(spark, f, ("**/*.jsonl",))
    return spark.createDataFrame([(*f, i) for i, f in enumerate(found)], SCHEMA)


def agents_of(spark: SparkSession, home: str, paths: DataFrame) -> DataFrame:
    """(path, agent, prefix) of session files: by the store they lie in, else by what their lines look like; files without a sign are left out."""
    stores = [STORES[k] for k in ("claude", "agent_probe", "codex", "copilot")]
    place = F.lit(None).cast("string")
    for s in stores:
        place = F.coalesce(place, F.when(F.startswith("path", F.lit(os.path.join(home, s.root).rstrip("/") + "/")), s.agent))
    known = paths.select("path", place.alias("agent"))
    others = [r.path for r in known.where("agent is null").select("path").collect()]  # paths as they were given
    found = known.where("agent is not null")
    if others:
        found = found.unionByName(sniff(lines(spark, others)).select("path", F.col("fmt").alias("agent")))
    prefix = F.create_map(*(F.lit(x) for s in stores for x in (s.agent, s.prefix)))
    return found.select("path", "agent", F.coalesce(F.try_element_at(prefix, F.col("agent")), F.lit("xx")).alias("prefix"))
