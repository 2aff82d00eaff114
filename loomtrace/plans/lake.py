"""All stores of a home folder as tables: records, steps, trajectories, and what is asked of them."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, edits, index, records, search, sessions
from ..sources import config, files, sqlite
from . import scratch

_FILES = ("claude", "codex", "copilot", "agent_probe")


class Lake:
    """Tables over the stores, read once when first asked for. ``scope`` keeps sessions that worked in a folder or below it."""

    def __init__(self, spark: SparkSession, home: str | None = None, scope: str | None = None, settings: dict | None = None):
        self.spark, self.home, self.scope = spark, os.path.expanduser(home or "~"), scope
        self.settings = config.load() if settings is None else settings

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once to the shared folder, so that every question reads it instead of the stores."""
        return scratch.keep(df, name)

    def _found(self, name: str) -> DataFrame:
        if name == "claude" and self.scope:
            return files.project_files(self.spark, self.home, self.scope)
        return files.files(self.spark, self.home, name)

    @cached_property
    def _files(self) -> dict[str, DataFrame]:
        return {k: self._found(k) for k in _FILES}

    @cached_property
    def _extra(self) -> DataFrame:
        return files.folder_files(self.spark, config.folders(self.settings))

    def _lines(self, found: DataFrame) -> DataFrame | None:
        # paths of files, as the driver listed them a moment ago
        paths = [r.path for r in found.select("path").collect()]
        return files.lines(self.spark, paths) if paths else None

    @cached_property
    def _events(self) -> dict[str, DataFrame]:
        """Decoded lines of the stores that have any files."""
        read = {k: self._lines(f) for k, f in self._files.items()}
        return {k: sessions.events(lines, k) for k, lines in read.items() if lines is not None}

    def _parse(self, lines: DataFrame, fmt: str, fall: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(steps, trajectories) of lines. They are decoded once, into the shared folder: what follows reads events several times over."""
        ev = self._kept(sessions.events(lines, fmt), f"events-{fmt}")
        step = sessions.steps(ev, fmt, fall)
        return step, sessions.trajectories(ev, step, fmt)

    @cached_property
    def _extra_kinds(self) -> DataFrame:
        return self._kept(files.sniff(self._lines(self._extra)), "kinds")

    @cached_property
    def _extra_formats(self) -> list[str]:
        if self._extra.isEmpty():
            return []
        held = {r.fmt for r in self._extra_kinds.select("fmt").distinct().collect()}
        return [k for k in _FILES if k in held]

    @cached_property
    def _extra_lines(self) -> DataFrame:
        return self._lines(self._extra).join(self._extra_kinds, "path")

    @cached_property
    def _stores(self) -> dict[str, dict[str, DataFrame]]:
        return {k: sqlite.store(self.spark, self.home, k) for k in sqlite.TABLES}

    @cached_property
    def records(self) -> DataFrame:
        return self._kept(self._records(), "records")

    def _records(self) -> DataFrame:
        parts = []
        for rank, k in enumerate(_FILES):
            if k in self._events:
                s = files.STORES[k]
                parts.append((k, records.file_records(self._files[k], records.openings(self._events[k], k), s.agent, s.prefix, rank)))
        db = self._stores
        parts += [("opencode", records.opencode(*db["opencode"].values(), rank=4)), ("codex_db", records.codex_db(db["codex_db"]["threads"], self._files["codex"], 5)), ("hermes", records.hermes(*db["hermes"].values(), rank=6))]
        if not self.scope:
            parts.append(("copilot_db", records.copilot_db(db["copilot_db"]["sessions"], 7)))
        for fmt in self._extra_formats:
            found = self._extra.join(self._extra_kinds.where(F.col("fmt") == fmt), "path")
            ev = sessions.events(self._extra_lines.where(F.col("fmt") == fmt), fmt)
            parts.append(("extra", records.file_records(found, records.openings(ev, fmt), fmt, fmt[:2], 8)))
        if self.scope:  # the folder of a Claude project is chosen by its name already
            parts = [(k, df if k == "claude" else df.where(text.within(F.col("cwd"), self.scope))) for k, df in parts]
        return records.union([df for _, df in parts]).drop("cwd")

    def parse(self, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(steps, trajectories) of all records, or of those in ``only(path, ...)``: no line of any other session is read."""
        keep = self.records.select("path").distinct() if only is None else only.select("path").distinct()
        mine = lambda df, key="path": df.join(keep, df[key] == keep.path, "left_semi")
        fall = self.records.select("path", F.col("timestamp").alias("fallback_ts"))
        pairs = []
        for k, found in self._files.items():
            lines = self._lines(found if only is None else mine(found))
            if lines is not None:
                pairs.append(self._parse(lines, k, fall))
        kinds = self._extra.join(self._extra_kinds, "path") if self._extra_formats else None
        for k in self._extra_formats:
            lines = self._lines(mine(kinds.where(F.col("fmt") == k)))
            if lines is not None:
                pairs.append(self._parse(lines, k, fall))
        for k, parse in (("hermes", sessions.hermes), ("copilot_db", sessions.copilot_db)):
            head, rows = self._stores[k].values()
            named = lambda df, key: mine(df.withColumn("_path", F.concat(F.lit(f"{k}:"), key)), "_path").drop("_path")  # noqa: B023, E731
            pairs.append(tuple(df.withColumn("path", F.concat(F.lit(f"{k}:"), "path")) for df in parse(named(head, "id"), named(rows, "session_id"))))
        # threads of the database whose rollout file still exists are read from that file
        threads = mine(self.records.where("agent = 'codex_db'")).select(F.col("path").alias("key"), F.try_element_at("source", F.lit("rollout_path")).alias("file"))
        held = [(r.key, r.file) for r in threads.where("file <> ''").collect() if os.path.exists(r.file)]
        if held:
            keys = self.spark.createDataFrame(held, "key string, file string")
            lines = files.lines(self.spark, [f for _, f in held]).join(F.broadcast(keys), F.col("path") == F.col("file")).select(F.col("key").alias("path"), "line_no", "value")  # a row per thread without its own file
            pairs.append(self._parse(lines, "codex", fall))
        step, traj = pairs[0]
        for s, t in pairs[1:]:
            step, traj = step.unionByName(s), traj.unionByName(t, allowMissingColumns=True)
        return mine(step), mine(traj)

    @cached_property
    def _parsed(self) -> tuple[DataFrame, DataFrame]:
        return self.parse()

    @cached_property
    def steps(self) -> DataFrame:
        return self._kept(self._parsed[0], "steps")

    @cached_property
    def trajectories(self) -> DataFrame:
        return self._kept(self._parsed[1], "trajectories")

    def one(self, record: dict) -> tuple[DataFrame, dict | None]:
        """(steps, trajectory) of a single record, read from its own file or rows; the trajectory is None where it can't be parsed."""
        step, traj = self.parse(self.records.where(F.col("path") == record["path"]).limit(1))
        row = traj.first()
        return step, row.asDict(recursive=True) if row else None

    def materialise(self, folder: str) -> tuple[DataFrame, DataFrame]:
        """Parsed tables kept as Parquet by (path, mtime): only sessions that are new or changed are read and parsed again."""
        now = self.records.select("path", "mtime")
        seen = f"{folder}/seen"
        todo, generation = now, 0
        if index._exists(self.spark, seen):
            done = self.spark.read.parquet(seen).groupBy("path").agg(F.max_by("mtime", "generation").alias("mtime"), F.max("generation").alias("generation"))
            generation = done.agg(F.max("generation")).first()[0] + 1
            todo = now.join(done.where("mtime <> 0").select("path", "mtime"), ["path", "mtime"], "left_anti")
        todo = self._kept(todo.withColumn("generation", F.lit(generation)), "todo")
        if not todo.isEmpty():
            for name, df in zip(("steps", "trajectories"), self.parse(todo)):
                df.join(todo.select("path", "generation"), "path").write.mode("append").option("mergeSchema", True).parquet(f"{folder}/{name}")
            todo.write.mode("append").parquet(seen)
        last = self.spark.read.parquet(seen).groupBy("path").agg(F.max("generation").alias("generation"))
        return tuple(self.spark.read.option("mergeSchema", True).parquet(f"{folder}/{n}").join(last, ["path", "generation"], "left_semi").drop("generation") for n in ("steps", "trajectories"))

    # ── questions ────────────────────────────────────────────────────────────

    def list(self, since: str | None = None, date: str | None = None) -> DataFrame:
        return search.list_records(self.records, since, date)

    def search(self, query: str, backend: str = "grep", folder: str | None = None) -> DataFrame:
        """``grep`` reads all steps, ``fast`` records only, ``index`` (``sqlite``) and ``candidates`` (``recoll``) the index in ``folder``."""
        return search.backend(backend)(search.Corpus(self.spark, self.records, lambda: self.steps, folder), query)

    def find(self, target: str) -> DataFrame:
        return analytics.find(self.records, target)

    def blame(self, target: str) -> DataFrame:
        return edits.blame(self.records, self.steps, target)

    def stats(self) -> DataFrame:
        return analytics.stats(self.records, self.trajectories)

    def programs(self) -> DataFrame:
        return analytics.session_programs(self.steps)

    def delete_candidates(self, message: str) -> DataFrame:
        return analytics.delete_candidates(self.records, self.steps, message)

    def refresh(self, folder: str, force: bool = False) -> tuple[int, int]:
        """Bring the index in ``folder`` up to date; (indexed, skipped). Sessions that haven't changed aren't read."""
        todo = self._kept(index.stale(self.records, folder, force), "todo")
        return index.build(self.records, self.parse(todo)[0], folder, force) if not todo.isEmpty() else (0, self.records.count())

    def snapshot(self, kind: str) -> DataFrame:
        """(key, mtime) of what there is before a run; see ``analytics.pick``."""
        if kind == "claude_project_jsonl":
            return files.project_files(self.spark, self.home, self.scope or os.getcwd()).select(F.col("path").alias("key"), "mtime")
        if kind == "codex_rollout_jsonl":
            return files.files(self.spark, self.home, "codex").select(F.col("path").alias("key"), "mtime")
        if kind == "copilot_sqlite":
            return self._stores["copilot_db"]["sessions"].select(F.col("id").alias("key"), F.col("created_at").alias("mtime"))
        return self.spark.createDataFrame([], "key string, mtime double")
