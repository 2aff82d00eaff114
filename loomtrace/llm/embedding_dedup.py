"""Embedding near-dedup: tiled comparison over PCA-ordered dimensions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

THRESHOLD = 0.95
#: Vectors of a tile, at most about.
TILE = 8192
#: Vectors that the axes are fitted on, at most: those with the least digests. Axes decide how early pairs are dropped, never which pairs are found.
FITTED = 8192
#: Dimensions after which pairs that can't reach the threshold are dropped, as parts of all.
STEPS = (0.25, 0.5, 0.75)
#: Leading dimensions whose boxes tell which tiles are too far apart.
LEAD = 8


def values(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of the usable vectors: of ``dim`` values without nulls, finite, not zero. Read from the list's flat buffer."""
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    kind = np.float32 if flat.type == pa.float32() else np.float64
    flat = flat.cast(pa.from_numpy_dtype(kind)).to_numpy(zero_copy_only=False)  # a null is a NaN
    rows = np.flatnonzero(size == dim)
    x = flat[(np.cumsum(size) - size)[rows][:, None] + np.arange(dim)]
    norm = np.linalg.norm(x.astype(np.float64), axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok]


def _digests(x: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(v) for v in x]


def _nodes(dim: int):
    def run(batches):
        for b in batches:
            _, x = values(b.column("vec"), dim)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(x), pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["node", "vec"])

    return run


def units(vecs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of stored ones, whose own precision shows in their length."""
    raw = b"".join(vecs)
    x = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(vecs) else np.float64).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal(nodes: DataFrame, dim: int, fitted: int = FITTED) -> np.ndarray:
    """Orthogonal axes of the second moments of at most ``fitted`` vectors, greatest first. Products stay what they are when vectors are turned to them."""
    x = units([r.vec for r in nodes.orderBy("node").limit(fitted).select("vec").collect()], dim)
    spread, axes = np.linalg.eigh(x.T @ x)
    return axes[:, np.argsort(spread)[::-1]]


def near_pairs(x: np.ndarray, y: np.ndarray, threshold: float, steps=STEPS, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of ``x`` and ``y`` (unit vectors, leading dimensions first) whose product may be at least ``threshold``; none that is gets lost.

    Products of the leading dimensions come first; what the rest can add is at most the product of the suffixes' norms,
    so pairs that can't reach the threshold any more are dropped after each step. ``open_``: pairs to look at, all if None.
    """
    dim = x.shape[1]
    cuts = sorted({max(1, round(dim * s)) for s in steps} | {dim})
    slack = 1e-5
    suffix = lambda v, at: np.sqrt((v[:, at:] ** 2).sum(axis=1))
    first = x[:, : cuts[0]] @ y[:, : cuts[0]].T
    may = first + suffix(x, cuts[0])[:, None] * suffix(y, cuts[0]) >= threshold - slack
    i, j = np.nonzero(may if open_ is None else may & open_)
    score = first[i, j].astype(np.float64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        for s in range(0, len(i), 1 << 18):
            e = s + (1 << 18)
            score[s:e] += np.einsum("ij,ij->i", x[i[s:e], a:b], y[j[s:e], a:b], dtype=np.float64)
        ok = score + (suffix(x, b)[i] * suffix(y, b)[j] if b < dim else 0) >= threshold - slack
        i, j, score = i[ok], j[ok], score[ok]
    return i, j


def joined(u: np.ndarray, v: np.ndarray | None, axes: np.ndarray, threshold: float, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as stars over the rows of ``u`` and then ``v``, with the components of all pairs across (or within ``u``) that reach the threshold.

    What survives in turned single precision is decided by the product of the given vectors in double precision. Pairs that
    are connected already are not looked at again, so that a tile full of copies costs little more than one strip.
    """
    x = (u @ axes).astype(np.float32)
    y = x if v is None else (v @ axes).astype(np.float32)
    other, shift = (u, 0) if v is None else (v, len(u))
    label = np.arange(len(u) + (0 if v is None else len(v)))
    for s in range(0, len(x), strip):
        own, theirs = label[s : min(s + strip, len(x))], label[shift : shift + len(y)]
        i, j = near_pairs(x[s : s + strip], y, threshold, open_=own[:, None] != theirs)
        hit = np.empty(len(i), bool)
        for a in range(0, len(i), 1 << 16):
            b = a + (1 << 16)
            hit[a:b] = np.einsum("ij,ij->i", u[s + i[a:b]], other[j[a:b]]) >= threshold
        root, leaf = c.stars(own[i[hit]], theirs[j[hit]])
        onto = np.arange(len(label))
        onto[leaf] = root
        label = onto[label]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return label[moved], moved


def _compare(dim: int, threshold: float, axes):
    """Over rows (unit, side, node, vec) in the order of units: edges of each unit, a pair of tiles or one tile with itself."""

    def edges(rows):
        sides = [([n for _, s, n, _ in rows if s == side], [v for _, s, _, v in rows if s == side]) for side in (0, 1)]
        (na, va), (nb, vb) = sides
        own = rows[0][1] == rows[-1][1] == 0
        if not va or not (vb or own):
            return
        i, j = joined(units(va, dim), None if own else units(vb, dim), axes.value, threshold)
        names = na + nb
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in v.tolist()], pa.binary()) for v in (i, j)], ["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(f).to_pylist() for f in ("unit", "side", "node", "vec"))):
                if held and row[0] != held[0][0]:
                    yield from edges(held)
                    held = []
                held.append(row)
        if held:
            yield from edges(held)

    return run


def near_edges(nodes: DataFrame, dim: int, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of ``nodes(node, vec)`` with a cosine of at least ``threshold``.

    Vectors are turned to their principal axes and cut into slices by the quantiles of the first and, within all, of the second;
    tiles that hold more than ``tile`` vectors, as copies make them, are cut further by a hash. Boxes around the tiles'
    leading dimensions bound how near their vectors can be; pairs of tiles too far apart are never formed. Partners are
    found by the equality of slices within reach. Each pair of tiles is one unit of work.
    """
    spark = nodes.sparkSession
    axes = spark.sparkContext.broadcast(principal(nodes, dim))
    lead = min(dim, LEAD)
    side = max(1, math.ceil(math.sqrt(nodes.count() / tile)))
    marks: list[list[float]] = [[], []]

    def turned(batches):
        for b in batches:
            x = units(b.column("vec").to_pylist(), dim) @ axes.value[:, :lead]
            cut = [np.searchsorted(m, x[:, d]) if m else np.zeros(len(x), np.int64) for d, m in zip((0, min(1, lead - 1)), marks)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vec"), *(pa.array(s.astype(np.int64)) for s in cut), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(lead))], names)

    names = ["node", "vec", "s0", "s1", *(f"d{k}" for k in range(lead))]
    kind = "node binary, vec binary, s0 long, s1 long, " + ", ".join(f"d{k} double" for k in range(lead))
    if side > 1:
        found = nodes.mapInArrow(turned, kind).approxQuantile(["d0", f"d{min(1, lead - 1)}"], [k / side for k in range(1, side)], 0.01 / side)
        marks = [sorted(set(m)) for m in found]
    flat = c.checkpoint(nodes.mapInArrow(turned, kind), "turned")
    boxes = flat.groupBy("s0", "s1").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"), *(f(f"d{k}").alias(f"{g}{k}") for k in range(lead) for f, g in ((F.min, "lo"), (F.max, "hi"))))
    boxes = c.checkpoint(boxes, "boxes")
    # a pair of tiles stays where the boxes are within the distance that the threshold allows
    far = 2 - 2 * threshold + 1e-4
    reach = [F.lit(0) if not marks[0] else F.size(F.filter(F.array(*map(F.lit, marks[0])), lambda m: m < bound)) for bound in (F.col("lo0") - math.sqrt(far), F.col("hi0") + math.sqrt(far))]
    p = boxes.withColumn("slice", F.explode(F.sequence(*(r.cast("long") for r in reach)))).alias("p")
    q = boxes.alias("q")
    gap = sum(((F.greatest(F.lit(0.0), F.col(f"p.lo{k}") - F.col(f"q.hi{k}"), F.col(f"q.lo{k}") - F.col(f"p.hi{k}"))) ** 2 for k in range(lead)), F.lit(0.0))
    pairs = p.join(q, F.col("p.slice") == F.col("q.s0")).where(F.struct("p.s0", "p.s1") <= F.struct("q.s0", "q.s1")).where(gap <= far)
    parts = lambda t: F.explode(F.sequence(F.lit(0), F.col(f"{t}.parts") - 1))
    pairs = pairs.withColumn("a", parts("p")).withColumn("b", parts("q")).where("p.s0 <> q.s0 or p.s1 <> q.s1 or a <= b")
    ends = [F.struct(F.col(f"{t}.s0").alias("s0"), F.col(f"{t}.s1").alias("s1"), F.col(n).alias("part")) for t, n in (("p", "a"), ("q", "b"))]
    work = pairs.select(F.xxhash64(*ends).alias("unit"), F.explode(F.array_distinct(F.array(F.struct(ends[0].alias("tile"), F.lit(0).alias("side")), F.struct(ends[1].alias("tile"), F.when(ends[0] == ends[1], 0).otherwise(1).alias("side"))))).alias("m"))
    work = work.select("unit", F.col("m.side").alias("side"), "m.tile.*")
    held = flat.join(boxes.select("s0", "s1", "parts"), ["s0", "s1"]).select("s0", "s1", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "vec")
    work = held.join(work, ["s0", "s1", "part"]).select("unit", "side", "node", "vec")
    return work.repartition("unit").sortWithinPartitions("unit", "side", "node").mapInArrow(_compare(dim, threshold, axes), "a binary, b binary")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, vec: str = "embedding", vec_id: str = "vec_id", tile: int = TILE) -> DataFrame:
    """The rows of ``vectors`` without near copies: of each group linked by cosines of at least ``threshold``, the row with the least id stays.

    Every vector is compared with every other one, tile by tile, but for those that bounds rule out; the cosines of what is left are
    taken in double precision. Groups are connected components over distinct vectors. Winners are found by narrow rows
    and joined back by vector, id and hash, so that copies don't meet in one task.

    Null ids come after all others, further ties are decided by a hash of the row, wholly equal rows leave one. Null and
    empty vectors, vectors with nulls, of zero or infinite length, and those of another dimension than most are
    compared with nothing: those rows all stay. An empty table gives an empty table. Extra columns of any name are kept.
    """
    top = vectors.select(F.size(c.col(vec)).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return vectors
    dim = int(top.n)
    nodes = c.checkpoint(vectors.select(c.col(vec).alias("vec")).mapInArrow(_nodes(dim), "node binary, vec binary").groupBy("node").agg(F.first("vec").alias("vec")), "nodes")
    comp = c.components(near_edges(nodes, dim, threshold, tile)).select(F.col("node").alias("of"), "comp")
    node, tie, win, rank = c.fresh(vectors, "node", "tie", "win", "rank")

    def key(batch):
        rows, x = values(batch.column(vec), dim)
        keys: list[bytes | None] = [None] * batch.num_rows
        for i, d in zip(rows.tolist(), _digests(x)):
            keys[i] = d
        yield {}, [pa.array(keys, pa.binary())], batch

    keyed = c.through(vectors, key, f"`{node}` binary").withColumn(tie, c.row_hash(vectors))
    place = F.struct(c.col(vec_id).isNull().alias("no"), c.col(vec_id).alias("id"), c.col(tie).alias("tie"), c.col(node).alias("node"))
    best = keyed.where(c.col(node).isNotNull()).select(c.col(node).alias("node"), place.alias("place")).join(comp, F.col("node") == F.col("of"), "left")
    best = best.groupBy(F.coalesce("comp", "node").alias("group")).agg(F.min("place").alias("place")).select(F.col("place").alias(win))
    same = (c.col(node) == c.col(win)["node"]) & c.col(vec_id).eqNullSafe(c.col(win)["id"]) & (c.col(tie) == c.col(win)["tie"])
    order = Window.partitionBy(c.col(node), c.col(vec_id), c.col(tie)).orderBy(c.col(tie))
    left = keyed.join(best, same).withColumn(rank, F.row_number().over(order)).where(c.col(rank) == 1)
    return left.select(*c.cols(vectors)).unionByName(keyed.where(c.col(node).isNull()).select(*c.cols(vectors)))
