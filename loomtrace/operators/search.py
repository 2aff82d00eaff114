"""Search through records and steps: by substring, by metadata, and by index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Documents an index passes on to the substring search of the capped backend.
CANDIDATES = 200


def blobs() -> Column:
    """The texts of a step that are searched: message, reasoning, each call's arguments, each result. Names of functions are not."""
    some = F.array(F.col("message"), F.col("reasoning_content"))
    some = F.concat(some, F.coalesce(F.transform("tool_calls", lambda x: x.arguments_json), F.array().cast("array<string>")))
    some = F.concat(some, F.coalesce(F.transform("results", lambda x: x.content), F.array().cast("array<string>")))
    return F.filter(some, lambda x: x != "")


def words_of(clauses: list[list[str]]) -> list[str]:
    return [w for words in clauses for w in words]


def blob_snippet(parts: Column, joined: Column, clauses: list[list[str]]) -> Column:
    """The snippet of the first text that holds any word, else of all of them together."""
    words = words_of(clauses)
    held = F.filter(parts, lambda x: text.matches(x, [[w] for w in words]))
    return text.snippet(F.coalesce(F.get(held, F.lit(0)), joined), words)


def grep(records: DataFrame, steps: DataFrame, query: str) -> DataFrame:
    """The first matching step of each record: id, step_id, snippet, with the record's columns.

    A hit in the first message counts as step 1 and needs no step. ``records(id, path, timestamp, first_msg, ...)``,
    ``steps(path, step_id, ...)``. Newest first.
    """
    clauses = text.parse_query(query)
    words = words_of(clauses)
    early = records.where(text.matches(F.col("first_msg"), clauses))
    early = early.withColumns({"step_id": F.lit(1), "snippet": text.snippet(F.col("first_msg"), words)})
    late = records.where(~text.matches(F.coalesce("first_msg", F.lit("")), clauses))
    parts = steps.select("path", "step_id", blobs().alias("parts"))
    found = parts.withColumn("joined", F.array_join("parts", " ")).where(text.matches(F.col("joined"), clauses))
    # snippets are cut where the steps lie: whole texts are never shuffled
    cut = found.select("path", F.struct("step_id", blob_snippet(F.col("parts"), F.col("joined"), clauses).alias("snippet")).alias("s"))
    first = cut.groupBy("path").agg(F.min("s").alias("s")).select("path", "s.step_id", "s.snippet")
    return newest(early.unionByName(late.join(first, "path")))


def fast(records: DataFrame, query: str) -> DataFrame:
    """Records whose first message, id or agent matches by itself. No step is read. Newest first."""
    clauses = text.parse_query(query)
    return newest(records.where(text.matches(F.col("first_msg"), clauses) | text.matches(F.col("id"), clauses) | text.matches(F.col("agent"), clauses)))


def newest(records: DataFrame) -> DataFrame:
    """By time as text, latest first; ties keep the order of discovery."""
    return records.orderBy(F.desc("timestamp"), *(["disc_ord"] if "disc_ord" in records.columns else []), *(["step_id"] if "step_id" in records.columns else []))


def list_records(records: DataFrame, since: str | None = None, date: str | None = None) -> DataFrame:
    """Records by date, compared as text of the first ten signs."""
    day = F.substring("timestamp", 1, 10)
    if since:
        records = records.where(day >= since)
    if date:
        records = records.where(day == date)
    return newest(records)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of ordered rows. Limit and offset stop the sort at the page's end; -1 is the last page."""
    if number == -1:
        number = max(1, -(-rows.count() // size))
    if number < 1:
        raise ValueError(f"page {number} is out of range")
    return (rows.orderBy(*order) if order else rows).offset((number - 1) * size).limit(size)


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """Size of what two result sets share over the size of their union; 1 where both are empty."""
    a, b = left.distinct().withColumn("_side", F.lit(1)), right.distinct().withColumn("_side", F.lit(2))
    n = a.unionByName(b).groupBy(*left.columns).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") == 2).alias("shared"), F.count("*").alias("either")).select("shared", "either", F.when(F.col("either") == 0, 1.0).otherwise(F.col("shared") / F.col("either")).alias("jaccard"))


@dataclass
class Corpus:
    """What a backend may search: all records, their steps (read when asked for), and the folder of an index."""

    spark: SparkSession
    records: DataFrame
    read_steps: Callable[[], DataFrame]
    folder: str | None = None

    @property
    def steps(self) -> DataFrame:
        return self.read_steps()


Backend = Callable[[Corpus, str], DataFrame]
BACKENDS: dict[str, Backend] = {}


def register(*names: str) -> Callable[[Backend], Backend]:
    """Make a function from a corpus and a query to matches a backend under these names."""

    def add(f: Backend) -> Backend:
        BACKENDS.update(dict.fromkeys(names, f))
        return f

    return add


def backend(name: str) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]


@register("grep")
def _grep(corpus: Corpus, query: str) -> DataFrame:
    return grep(corpus.records, corpus.steps, query)


@register("fast")
def _fast(corpus: Corpus, query: str) -> DataFrame:
    return fast(corpus.records, query)
