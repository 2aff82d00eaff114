"""Packing documents into training windows by best-fit decreasing."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 2048
#: Documents packed together. The number of shards grows with the table, their size does not.
SHARD = 50_000
#: Tasks for shards, at most; a task takes as many shards as come to it.
MOST_TASKS = 20_000

SCHEMA = "window_id string, doc_ids array<{id}>, starts array<long>, lengths array<long>, used long"


class Capacities:
    """Open windows by remaining capacity, in a segment tree whose nodes count the windows below them."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.stacks[capacity].append(window)
        self._change(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity >= ``need`` of any open window."""
        at, count = need + self.leaves, self.count
        if count[at]:
            return need
        while at > 1:  # up until a right sibling holds a window, then down to its leftmost
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.stacks[capacity].pop()


def best_fit(pieces: list[tuple[int, int]], window: int) -> list[list[int]]:
    """Windows as lists of piece numbers. ``pieces``: (length, number), lengths from 1 to ``window``; longest first, ties by number."""
    room, out = Capacities(window), []
    for length, number in sorted(pieces, key=lambda p: (-p[0], p[1])):
        found = room.tightest(length)
        if found is None:
            out.append([number])
            at, found = len(out) - 1, window
        else:
            at = room.take(found)
            out[at].append(number)
        if found > length:
            room.put(found - length, at)
    return out


def _windows(shard: str, ids: pa.ChunkedArray, lens: list[int], window: int) -> pa.Table:
    """The windows of one shard. Ids stay Arrow values: none is turned into another kind of number on the way."""
    full: list[tuple[list[int], list[int], list[int]]] = []
    rest = []
    for i, n in enumerate(lens):
        full += [([i], [s], [window]) for s in range(0, n - window + 1, window)]
        if n % window:
            rest.append((n % window, i))
    for held in best_fit(rest, window):
        full.append((held, [lens[i] - lens[i] % window for i in held], [lens[i] % window for i in held]))
    taken = pa.array([i for w in full for i in w[0]], pa.int64())
    ends = pa.array([0, *itertools.accumulate(len(w[0]) for w in full)], pa.int32())
    return pa.table({
        "window_id": pa.array([f"{shard}-{i}" for i in range(len(full))], pa.string()),
        "doc_ids": pa.ListArray.from_arrays(ends, ids.take(taken)),
        "starts": pa.array([w[1] for w in full], pa.list_(pa.int64())),
        "lengths": pa.array([w[2] for w in full], pa.list_(pa.int64())),
        "used": pa.array([sum(w[2]) for w in full], pa.int64()),
    })


def pack(docs: DataFrame, window: int = WINDOW, shard: int = SHARD, text: str = "text", doc_id: str = "doc_id", tokens: str | None = None) -> DataFrame:
    """Windows of at most ``window`` tokens: window_id, and per piece the document, its first token and its length.

    Documents longer than a window are first cut into full windows; what is left over is packed best-fit decreasing
    within shards of about ``shard`` documents, chosen by a hash. Ids and lengths are made in one pass over the texts and
    written; only they are shuffled. ``tokens`` names a column of lengths; without it words between white space count, and texts of any
    length are counted whole.

    Every row is packed, repeated rows and rows with null id too (their id stands as null in ``doc_ids``). Null, empty
    and blank texts, and null or negative lengths, take no room and appear in no window. Equal lengths go by id, nulls
    last. An empty table gives no windows. Other columns are of no account, whatever their names.
    """
    length = F.coalesce(c.col(tokens).cast("long"), F.lit(0)) if tokens else c.word_count(c.col(text))
    key = F.xxhash64(c.col(doc_id), c.col(text) if text in docs.columns else F.lit(0))
    rows = c.checkpoint(docs.select(key.alias("key"), c.col(doc_id).alias("doc_id"), length.alias("n")).where("n > 0"), "lengths")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod("key", F.lit(shards)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending")])  # nulls come last
        return _windows(str(key[0].as_py()), table.column("doc_id").combine_chunks(), table.column("n").to_pylist(), window)

    # a task for each shard: their number is stated, so that small rows aren't gathered into few tasks
    return rows.repartition(min(shards, MOST_TASKS), "shard").groupBy("shard").applyInArrow(run, SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString()))
