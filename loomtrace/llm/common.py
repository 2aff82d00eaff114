"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scratch

#: Edges up to which components are found by one task (16 MB of numbers); beyond, by alternating stars.
FEW_EDGES = 1_000_000
#: Rows up to which a helper table is broadcast; larger ones are joined by a shuffle.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, whatever signs its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame, *drop: str) -> list[Column]:
    """All columns but those named, which are compared without case as Spark does."""
    gone = {d.lower() for d in drop}
    return [col(c) for c in df.columns if c.lower() not in gone]


checkpoint = scratch.keep


def small(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """A written table for a join: broadcast if it has been counted and is small, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= limit else df


def lookup(left: DataFrame, right: DataFrame, key: str, times: str, part: int = 1000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and in ``times`` how often the key stands in ``left``.

    Keys with more than a ``part``-th of all rows of ``left``, of which there are fewer than ``part``, are broadcast, so that
    none of their rows is shuffled; the others meet by an ordinary shuffle.
    """
    right = checkpoint(right, "keys")
    most = left.count() / part
    hot = right.where(F.col(times) > most).select(key).collect()  # fewer than ``part`` keys
    if not hot:
        return left.join(right.drop(times), key)
    mark = F.broadcast(right.where(F.col(times) > most))
    rest = left.join(mark.select(key), key, "left_anti").join(right.where(F.col(times) <= most).drop(times), key)
    return left.join(mark.drop(times), key).unionByName(rest)


def word_count(text: Column) -> Column:
    """Words between white space; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def row_hash(df: DataFrame, *drop: str) -> Column:
    """A tie-break over all columns; those that can't be hashed count by their JSON text."""
    gone = {d.lower() for d in drop}
    odd = lambda f: any(x in f.dataType.simpleString() for x in ("map<", "variant", "geo"))
    able = [F.to_json(F.struct(col(f.name).alias("v"))) if odd(f) else col(f.name) for f in df.schema if f.name.lower() not in gone]
    return F.xxhash64(*able) if able else F.lit(0).cast("long")


def through(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[tuple[dict, list]]], columns: str, *drop: str) -> DataFrame:
    """``df`` with columns made by ``function`` from Arrow batches, in any order of names, dots and cases.

    The columns of ``df`` travel as one struct, so that no name of theirs meets another one or is taken for a path. For a
    batch of them the function yields, slice by slice, (columns that take the place of others by name, arrays for ``columns``,
    slice). ``columns`` is a DDL text; columns of ``df`` called the same (without case), or named in ``drop``, are left out.
    """
    made = T._parse_datatype_string(columns)
    names = df.columns
    kind = T.StructType([T.StructField("row", T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])), *(T.StructField(f"made{i}", f.dataType) for i, f in enumerate(made.fields))])

    def run(batches):
        for batch in batches:
            held = batch.column(0)
            whole = pa.RecordBatch.from_arrays([held.field(i) for i in range(len(names))], names=names)
            for new, arrays, part in function(whole):
                row = pa.StructArray.from_arrays([new.get(n, part.column(i)) for i, n in enumerate(names)], names=names)
                yield pa.RecordBatch.from_arrays([row, *arrays], names=["row", *(f"made{i}" for i in range(len(arrays)))])

    done = df.select(F.struct(*cols(df)).alias("row")).mapInArrow(run, kind)
    gone = {f.name.lower() for f in made.fields} | {d.lower() for d in drop}
    kept = [F.col("row")[n].alias(n) for n in names if n.lower() not in gone]
    return done.select(*kept, *(F.col(f"made{i}").alias(f.name) for i, f in enumerate(made.fields)))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4_000_000):
    """A batch cut so that ``column`` holds about ``max_bytes`` of text at most (a longer single text stays whole)."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node, node) with the same components as the edges a[i]-b[i]: at most one for each node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        p, q = root[i], root[j]
        open_ = p != q
        if not open_.any():
            break
        i, j, p, q = i[open_], j[open_], p[open_], q[open_]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root] != root).any():  # every node points to its root
            root[up] = root[root[up]]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[leaf]], nodes[leaf]


def _coded(a: list, b: list) -> tuple[np.ndarray, np.ndarray, list]:
    """Edges between any values as numbers in the order of the values."""
    names = sorted({*a, *b})
    number = {x: i for i, x in enumerate(names)}
    return np.array([number[x] for x in a], np.int64), np.array([number[x] for x in b], np.int64), names


def _contract(batches):
    a, b, schema = [], [], None
    for x in batches:
        schema = x.schema
        a += x.column("a").to_pylist()
        b += x.column("b").to_pylist()
    if schema is not None:
        i, j, names = _coded(a, b)
        root, leaf = stars(i, j)
        kind = schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in leaf.tolist()], kind), pa.array([names[k] for k in root.tolist()], kind)], ["a", "b"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, comp)``, comp being the least node; only nodes with an edge to another one appear.

    Edges are first contracted where they lie. Up to ``few`` of what is left are solved by one task; more by alternating large-star
    and small-star steps, whose number of rounds grows with the logarithm of the longest path and which never gather a
    node's neighbours in one place. Each round is written and the one before deleted. Both ways give the same components.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = checkpoint(edges.where("a <> b").mapInArrow(_contract, f"a {kind}, b {kind}"), "edges")
    if now.count() <= few:
        solved = checkpoint(now.repartition(1).mapInArrow(_contract, f"a {kind}, b {kind}"), "edges")
        scratch.drop(now)
        now = solved
    else:
        seen = None
        while True:
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = large.where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            star = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            then = checkpoint(star.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
            scratch.drop(now)
            now = then
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if mark == seen:
                break
            seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
