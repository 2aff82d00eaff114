"""SQLite stores as a Spark data source.

``spark.read.format("sqlite").option("path", db).option("dbtable", "sessions").schema(...).load()``. Ranges of the row id
are read in parallel where ``numPartitions`` is set; equality filters are pushed into the query.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

TABLES = {
    "hermes": (".hermes/state.db", {
        "sessions": "id string, model string, cwd string, started_at double, ended_at double, message_count long, tool_call_count long, input_tokens long, output_tokens long, title string, cache_read_tokens long, cache_write_tokens long",
        "messages": "id long, session_id string, role string, content string, tool_calls string, tool_name string, tool_call_id string, timestamp double, reasoning_content string",
    }),
    "opencode": (".local/share/opencode/opencode.db", {
        "session": "id string, time_created long, time_updated long, model string, directory string, agent string, cost double, tokens_input long, tokens_output long, tokens_reasoning long, tokens_cache_read long, tokens_cache_write long",
        "message": "id string, session_id string, time_created long, data string",
        "part": "id string, message_id string, time_created long, data string",
    }),
    "codex_db": (".codex/state_5.sqlite", {
        "threads": "id string, rollout_path string, created_at_ms long, updated_at_ms long, model_provider string, model string, cwd string, title string, tokens_used long, first_user_message string",
    }),
    "copilot_db": (".copilot/session-store.db", {
        "sessions": "id string, created_at string, cwd string, repository string, branch string, summary string",
        "turns": "session_id string, turn_index long, user_message string, assistant_response string, timestamp string",
    }),
}


class _Range(InputPartition):
    def __init__(self, low, high):
        self.low, self.high = low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.db, self.name, self.schema = options["path"], options["dbtable"], schema
        self.parts = int(options.get("numpartitions", options.get("numPartitions", "1")))
        self.equal: list[tuple[str, object]] = []

    def _open(self):
        return sqlite3.connect(f"file:{self.db}?mode=ro", uri=True)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, (str, int, float)):
                self.equal.append((f.attribute[0], f.value))
            else:
                yield f

    def partitions(self):
        if self.parts < 2:
            return [_Range(None, None)]
        con = self._open()
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.name)}").fetchone()
        finally:
            con.close()
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        con = self._open()
        try:
            have = {r[1] for r in con.execute(f"PRAGMA table_info({_quoted(self.name)})")}
            wanted = ", ".join(_quoted(f.name) if f.name in have else "NULL" for f in self.schema.fields)
            where = [f"{_quoted(k)} = ?" for k, _ in self.equal]
            args = [v for _, v in self.equal]
            if partition.low is not None:
                where.append("rowid >= ? AND rowid < ?")
                args += [partition.low, partition.high]
            tail = f" WHERE {' AND '.join(where)}" if where else ""
            cast = [_CASTS.get(f.dataType.typeName(), lambda v: v) for f in self.schema.fields]
            for row in con.execute(f"SELECT {wanted} FROM {_quoted(self.name)}{tail}", args):
                yield tuple(None if v is None else c(v) for c, v in zip(cast, row))
        finally:
            con.close()


def _number(kind):
    def cast(v):
        try:
            return kind(v)
        except (TypeError, ValueError):
            return None

    return cast


_CASTS = {"string": lambda v: v if isinstance(v, str) else v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "long": _number(int), "double": _number(float)}


class SqliteSource(DataSource):
    @classmethod
    def name(cls):
        return "sqlite"

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def table(spark: SparkSession, db: str, name: str, schema: str, partitions: int = 1) -> DataFrame:
    """A table of a database file; a missing file or table is an empty table. Columns that it lacks are null."""
    try:
        if not os.path.exists(db):
            raise sqlite3.OperationalError
        con = sqlite3.connect(f"file:{db}?mode=ro", uri=True)
        try:
            con.execute(f"SELECT 1 FROM {_quoted(name)} LIMIT 1")
        finally:
            con.close()
    except sqlite3.Error:
        return spark.createDataFrame([], schema)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").option("path", db).option("dbtable", name).option("numPartitions", str(partitions)).schema(schema).load()


def store(spark: SparkSession, home: str, kind: str) -> dict[str, DataFrame]:
    """All tables of a store below a home folder."""
    where, tables = TABLES[kind]
    return {name: table(spark, os.path.join(home, where), name, schema) for name, schema in tables.items()}
