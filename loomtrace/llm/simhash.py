"""SimHash near-dedup through deletion-variant signatures."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c
from .exact_dedup import digest

BITS = 128
#: Bits in which near copies may differ. Every pair of texts up to so many bits apart is found, and no other one is linked.
DISTANCE = 21
#: Signatures of a tile, about; every pair of tiles is a unit of work.
TILE = 262_144
#: Tiles of a smaller table.
LEAST = 4
#: Bits of a segment.
WIDE = 16
#: Pairs of two buckets from which those known to be linked are left out.
DENSE = 1 << 18
#: Pairs that are listed in one go.
PAIRS = 1 << 19
#: Signatures whose partners are compared in one go, and those below which pairs are listed.
SLICE, FEW = 1 << 16, 512
#: Letters from which a word counts in full; shorter ones are mostly grammar and count little.
LONG = 4
SHORT_WEIGHT = 0.1

_LETTERS = np.zeros(0x110000, np.uint32)
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2) - 1
_POWERS = np.ones(1, np.uint64)


def _letters() -> np.ndarray:
    """Per code point its lower case where it is a letter or digit, else 0."""
    if not _LETTERS[97]:
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalnum():
                low = ch.lower()
                _LETTERS[i] = ord(low) if len(low) == 1 else i
    return _LETTERS


def _mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        step = np.full(1 << int(n).bit_length(), 0x9E3779B97F4A7C15 | 1, np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step)
    return _POWERS


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of ``texts``: the text's number, a 64-bit hash, its length. Words are runs of letters and digits, without case."""
    flat = _letters()[np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = flat != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, begin.astype(np.uint64), begin
    size = end - begin
    letters = flat[inside[1:-1]].astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    at = np.arange(len(letters)) - np.repeat(first, size)
    hashed = np.add.reduceat(letters * _powers(int(size.max()))[at], first)
    return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, side="right"), _mix(hashed + size.astype(np.uint64)), size


def signatures(texts: list[str | None]) -> list[bytes | None]:
    """128-bit SimHash of each text: its words weighted with the root of their count.

    None for null texts and texts without a letter or digit.
    """
    owner, hashed, size = _words([t or "" for t in texts])
    if not len(owner):
        return [None] * len(texts)
    _, at, count = np.unique(_mix(hashed ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
    order = np.argsort(owner[at], kind="stable")
    at, count = at[order], count[order]
    # whole numbers, whose sums are exact in any order: the signature depends on nothing but the text
    weight = np.rint(20 * np.sqrt(count) * np.where(size[at] >= LONG, 1.0, SHORT_WEIGHT)).astype(np.float32)
    names, word = np.unique(hashed[at], return_inverse=True)
    raw = np.stack((_mix(names), _mix(names + np.uint64(0x9E3779B97F4A7C15))), 1).view(np.uint8)
    signs = _SIGNS[raw].reshape(-1, BITS)
    out: list[bytes | None] = [None] * len(texts)
    spans = np.searchsorted(owner[at], np.arange(len(texts) + 1))
    for i, (a, b) in enumerate(zip(spans[:-1], spans[1:])):
        if b > a:
            total = np.zeros(BITS, np.float64)
            for s in range(a, b, 1 << 14):
                e = min(b, s + (1 << 14))
                total += weight[s:e] @ signs[word[s:e]]
            out[i] = np.packbits(total > 0).tobytes()
    return out


def _sign(batches):
    for batch in batches:
        for part in c.slices(batch, "text"):
            made = signatures(part.column("text").to_pylist())
            none = np.array([x is None for x in made])
            word = np.frombuffer(b"".join(x or bytes(16) for x in made), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([part.column("digest"), part.column("place"), pa.array(made, pa.binary()), *(pa.array(np.ascontiguousarray(word[:, i]), mask=none) for i in (0, 1))], ["digest", "place", "sig", "w0", "w1"])


def segments(k: int, radius: int = 1) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one differs in at most ``radius`` bits when at most ``k`` of all bits do."""
    n = (k + 1 + radius) // (radius + 1)
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(x, y - x) for x, y in zip(cuts, cuts[1:])]


def plan(k: int) -> list[tuple[int, int, list[int]]]:
    """(first bit, bits, sets of bits to leave out) of each segment.

    Signatures at most ``k`` bits apart differ, in some segment, in one of its sets exactly: they are equal without these bits. Segments are
    about as wide as the number of a tile's signatures has bits, and as many bits are left out as that takes. Of segments so wide
    that one differs in at most ``r`` bits, some may do with ``r - 1``: all differ in more only if ``k`` is exceeded.
    """
    radius = k // (BITS // WIDE)
    cut = segments(k, radius)
    spare = len(cut) * (radius + 1) - (k + 1)
    out = []
    for i, (first, wide) in enumerate(cut):
        wide = min(wide, WIDE)  # where a segment differs in so many bits at most, its part does too
        bits = [1 << b for b in range(wide)]
        out.append((first, wide, [sum(x) for n in range(radius + (i >= spare)) for x in combinations(bits, n)]))
    return out


def within(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Whether ``x[i]`` and ``y[j]`` (rows of two 64-bit words) are at most ``k`` bits apart. The second words are only looked at where the first ones allow it."""
    out = np.empty((len(x), len(y)), bool)
    for s in range(0, len(x), 256):
        strip = out[s : s + 256]
        np.less_equal(np.bitwise_count(x[s : s + 256, None, 0] ^ y[None, :, 0]), k, out=strip)
        i, j = np.nonzero(strip)
        strip[i, j] = np.bitwise_count(x[s + i] ^ y[j]).sum(axis=1) <= k
    return out


def linked(near: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of the matrix ``near`` between members ``rows`` and ``columns``. Where most are near one another, labels
    are passed along its rows and columns until none changes, so that no list of pairs is made."""
    if np.count_nonzero(near) <= 16 * sum(near.shape):
        i, j = np.nonzero(near)
        return rows[i], columns[j]
    n = int(max(rows.max(), columns.max())) + 1
    label = np.arange(n, dtype=np.int32)
    while True:
        old = label.copy()
        label[rows] = np.minimum(label[rows], np.where(near, label[columns][None, :], n).min(axis=1))
        label[columns] = np.minimum(label[columns], np.where(near, label[rows][:, None], n).min(axis=0))
        label = label[label]
        if (label == old).all():
            moved = np.flatnonzero(label != np.arange(n))
            return label[moved].astype(np.int64), moved


def _values(sig: np.ndarray, first: int, wide: int) -> np.ndarray:
    """The bits of a segment as numbers."""
    word, at = divmod(first, 64)
    held = sig[:, word] >> np.uint64(at)
    if at + wide > 64:
        held = held | (sig[:, word + 1] << np.uint64(64 - at))
    return (held & np.uint64((1 << wide) - 1)).astype(np.int64)


class _Groups:
    """Groups of signatures that have been linked, by the least row number."""

    def __init__(self, sig: np.ndarray, k: int):
        self.sig, self.k = sig, k
        self.label = np.arange(len(sig))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.found.append((i, j))
            self.waiting += len(i)
            if self.waiting > 1_000_000:
                self.merge()

    def merge(self) -> None:
        if self.found:
            i, j = (self.label[np.concatenate([f[n] for f in self.found])] for n in (0, 1))
            root, leaf = c.stars(i, j)
            to = np.arange(len(self.label))
            to[leaf] = root
            self.label = to[self.label]
            self.found, self.waiting = [], 0

    def all_pairs(self, p: np.ndarray, q: np.ndarray) -> None:
        """Compare the rows ``p`` with the rows ``q``."""
        step = max(1, PAIRS // max(1, len(q)))
        for s in range(0, len(p) if len(q) else 0, step):
            self.add(*linked(within(self.sig[p[s : s + step]], self.sig[q], self.k), p[s : s + step], q))

    def many(self, p: np.ndarray, q: np.ndarray) -> None:
        """The same for many rows, of which those in the largest group are not compared with one another. Groups grow by what is near
        a few rows first, so that a large set of near copies takes no square of its number."""
        while len(p) * len(q) > DENSE:
            both = np.concatenate((p, q))
            for at in both[np.linspace(0, len(both) - 1, 8).astype(int)].tolist():
                near = both[np.bitwise_count(self.sig[both] ^ self.sig[at]).sum(axis=1) <= self.k]
                self.add(np.full(len(near), at), near)
            self.merge()
            names, count = np.unique(self.label[both], return_counts=True)
            if count.max() * 20 < len(both):
                break
            top = names[count.argmax()]
            one, other = self.label[p] == top, self.label[q] == top
            self.all_pairs(p[one], q[~other])
            self.all_pairs(p[~one], q[other])
            p, q = p[~one], q[~other]
        self.all_pairs(p, q)


def _meet(x: np.ndarray, y: np.ndarray, at: np.ndarray, count: np.ndarray, k: int):
    """Positions in ``x`` and ``y`` of words at most ``k`` bits apart, where ``x[i]`` meets ``count[i]`` words of ``y`` from ``at[i]`` on.

    All first ones are compared in one go, then all second ones, and so on; where few are left, their pairs are listed.
    """
    kind = np.uint16 if len(count) and count.max() < 1 << 16 else np.int64  # numbers of 16 bits have a linear sort
    order = np.argsort(count.astype(kind), kind="stable")[::-1]
    order = order[: np.count_nonzero(count)]
    x, at, count = x.take(order), at.take(order), count.take(order)
    left = len(count) - np.searchsorted(count[::-1], np.arange(1, int(count[0]) + 1)) if len(count) else []
    done = 0
    for done, m in enumerate([*left, 0]):
        if m < FEW:
            break
        hit = np.flatnonzero(np.bitwise_count(y.take(at[:m] + done) ^ x[:m]) <= k)
        if len(hit):
            yield order[hit], at[hit] + done
    m = int(left[done]) if done < len(left) else 0
    some = count[:m] - done
    ends = np.cumsum(some)
    cuts = np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)).tolist() if m else []
    for s, e in zip([0, *cuts], [*cuts, m]):
        if s < e:
            behind = ends[s:e] - (ends[s - 1] if s else 0)
            j = np.repeat(at[s:e] + done - (behind - some[s:e]), some[s:e])
            j += np.arange(len(j))
            hit = np.flatnonzero(np.bitwise_count(np.repeat(x[s:e], some[s:e]) ^ y[j]) <= k)
            yield order[s + np.searchsorted(behind, hit, side="right")], j[hit]


def _join(sig: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of each row of ``sig`` the least row of its group, by links of at most ``k`` bits between the first ``n`` rows and the others; among all if there are no others."""
    groups = _Groups(sig, k)
    same = n == len(sig)
    rows, others = np.arange(n), np.arange(0 if same else n, len(sig))
    steps = plan(k)
    if min(n, len(sig) - n or n) < 2 * sum(len(masks) for _, _, masks in steps):
        groups.many(rows, rows if same else others)
        groups.merge()
        return groups.label
    for first, wide, masks in steps:
        value = _values(sig, first, wide)
        p = rows[np.argsort(value[rows], kind="stable")]
        q = p if same else others[np.argsort(value[others], kind="stable")]
        mine = value[p]
        size = np.bincount(value[q], minlength=1 << wide)
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        own = size if same else np.bincount(mine, minlength=1 << wide)
        begin = start if same else np.concatenate(([0], np.cumsum(own)[:-1]))
        most = int(own.max()) * int(size.max())
        # the word that holds less of the segment tells more; if it holds none, it has less left to differ in
        test = 1 if first + wide // 2 < 64 else 0
        apart = first // 64 == (first + wide - 1) // 64
        (x, y), (x2, y2) = ([np.ascontiguousarray(sig[v, w]) for v in (p, q)] for w in (test, 1 - test))
        for mask in masks:
            to = mine ^ mask
            count, at = size.take(to), start.take(to)
            low = 1 << (mask.bit_length() - 1) if same and mask else 0
            if low:  # each pair of buckets once
                count = np.where(mine & low, 0, count)
            if same and not mask:  # each with those behind it
                at = np.arange(1, n + 1)
                count = start[to] + count - at
            if most > DENSE:
                large = np.flatnonzero(own * size[np.arange(1 << wide) ^ mask] > DENSE)
                large = large[large & low == 0]
                count = np.where(np.isin(mine, large), 0, count)
                for v in large.tolist():
                    w = v ^ mask
                    groups.many(p[begin[v] : begin[v] + own[v]], q[start[w] : start[w] + size[w]])
            for s in range(0, n, SLICE):
                for i, j in _meet(x[s : s + SLICE], y, at[s : s + SLICE], count[s : s + SLICE], k - mask.bit_count() * apart):
                    i = i + s
                    near = np.bitwise_count(x.take(i) ^ y.take(j)) + np.bitwise_count(x2.take(i) ^ y2.take(j)) <= k
                    groups.add(p[i[near]], q[j[near]])
        groups.merge()
    return groups.label


def _near(k: int):
    """Over rows (unit, side, w0, w1) in the order of units and sides: edges between the signatures of a unit, as stars."""

    def work(rows):
        sig = np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
        n = int(np.count_nonzero(rows[:, 1] == 0))
        if n == 0 or len(sig) == 1:
            return
        label = _join(sig, n, k) if n < len(sig) or rows[0, 0] < 0 else np.arange(n)
        leaf = np.flatnonzero(label != np.arange(len(label)))
        names = [pa.array([x.tobytes() for x in sig[v]], pa.binary()) for v in (label[leaf], leaf)]
        yield pa.RecordBatch.from_arrays(names, ["a", "b"])

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(f).to_numpy() for f in ("unit", "side", "w0", "w1")], 1)
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for some in np.split(rows, cuts):
                if held and len(some) and held[-1][0, 0] != some[0, 0]:
                    yield from work(np.concatenate(held))
                    held = []
                if len(some):
                    held.append(some)
        if held:
            yield from work(np.concatenate(held))

    return run


def near_edges(sigs: DataFrame, k: int = DISTANCE, tile: int = TILE, least: int = LEAST) -> DataFrame:
    """Edges (a, b) between distinct signatures, given as two words; their components are those of all pairs at most ``k`` bits apart.

    Signatures are cut by a hash into tiles of about ``tile``, ``least`` of them at least, and every pair of tiles is a unit of work. In a
    unit, those meet that are equal in a segment without the bits they differ in there (see ``plan``), and are compared by XOR and bit
    count. Every pair of signatures is in one unit. A signature is sent once for each tile.
    """
    tiles = max(least, -(-sigs.count() // tile))
    parts = min(tiles * (tiles + 1) // 2, int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own, other = F.pmod(F.xxhash64("w0", "w1"), F.lit(tiles)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    both = sigs.select("w0", "w1", own.alias("own"), other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    number = high * (high + 1) / 2 + low
    # a tile with itself has a number below 0
    unit = F.when(F.col("own") == F.col("other"), -1 - number).otherwise(number).cast("long")
    side = F.when(F.col("own") > F.col("other"), 1).otherwise(0).cast("long")
    units = both.select(unit.alias("unit"), side.alias("side"), "w0", "w1")
    placed = units.repartitionById(parts, F.pmod(F.when(F.col("unit") < 0, -1 - F.col("unit")).otherwise(F.col("unit")), F.lit(parts)).cast("int"))
    return placed.sortWithinPartitions("unit", "side").mapInArrow(_near(k), "a binary, b binary")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of texts linked by signatures at most ``k`` bits apart,
    the row with the least ``doc_id`` stays. All such pairs are found (see ``near_edges``).

    Signatures are made once per row in Arrow batches and kept by the digest of the text; groups are connected
    components over distinct signatures. Winners are found by narrow rows and joined back by digest and id, so that copies
    of one text don't meet in one task. Texts of any length are signed whole, and shuffled once at most.

    Null ids come after all others, ties are decided by the text's digest, wholly equal rows leave one. Null texts and
    texts without any letter or digit have no signature: those rows all stay. An empty table gives an empty table. Extra columns of
    any name are kept.
    """
    dig, win, rank = c.fresh(docs, "digest", "win", "rank")
    keyed = docs.withColumn(dig, digest(c.col(text)))
    place = F.struct(c.col(doc_id).isNull().alias("no"), c.col(doc_id).alias("id"), c.col(dig).alias("digest"))
    rows = keyed.select(c.col(dig).alias("digest"), place.alias("place"), c.col(text).cast("string").alias("text"))
    signed = rows.mapInArrow(_sign, T.StructType([*rows.drop("text").schema, *T._parse_datatype_string("sig binary, w0 long, w1 long")]))
    signed = c.checkpoint(signed.groupBy("digest").agg(F.min("place").alias("place"), *(F.max(x).alias(x) for x in ("sig", "w0", "w1"))), "signatures")
    comp = c.components(near_edges(signed.where("sig is not null").select("w0", "w1").distinct(), k))
    group = signed.where("sig is not null").join(comp, signed.sig == comp.node, "left").select("place", F.coalesce("comp", "sig").alias("comp"))
    best = group.groupBy("comp").agg(F.min("place").alias("place")).select(F.col("place.digest").alias(dig), F.col("place.id").alias(win))
    blank = keyed.join(signed.where("sig is null").select(F.col("digest").alias(dig)), dig, "left_semi")
    left = keyed.join(best.withColumnRenamed(dig, rank), (c.col(dig) == c.col(rank)) & c.col(win).eqNullSafe(c.col(doc_id))).drop(rank)
    order = Window.partitionBy(c.col(dig), c.col(win)).orderBy(c.row_hash(docs, text))
    left = left.withColumn(rank, F.row_number().over(order)).where(c.col(rank) == 1)
    return left.select(*c.cols(docs)).unionByName(blank.select(*c.cols(docs)))
