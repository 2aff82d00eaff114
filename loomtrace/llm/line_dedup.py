"""Line dedup by winnowing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Lines of the shortest run that is found and deleted.
RUN = 3
#: Words from which shorter runs count too, down to a single line, where the caller asks for it.
WORDS = 8
#: What is taken off both ends of a line before it is compared.
EDGE = " \t\r"

def row_key(docs: DataFrame, text: str, doc_id: str):
    """128 bits of a row's id and text; rows equal in both are one document."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(c.col(doc_id).cast("string"), F.lit("\1")), F.coalesce(c.col(text).cast("string"), F.lit("\1")))))


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """All lines of a text, and the numbers of those that aren't blank."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip(EDGE)]


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``run`` hashes, the position of its minimum; of equal ones the last."""
    wins = np.lib.stride_tricks.sliding_window_view(hashes, run)
    return np.arange(len(wins)) + run - 1 - np.argmin(wins[:, ::-1], axis=1)


def windows(size: np.ndarray, run: int, words: int | None):
    """(n, starts): the windows of n <= ``run`` lines that have to be looked at, ``size`` being the words of each line.

    Windows of ``run`` lines count, and shorter ones of ``words`` words. Where both windows without an end line count, a
    window is a repeat only if they are, and they cover it.
    """
    total = np.concatenate(([0], np.cumsum(size)))
    shorter = np.zeros(len(size) + 1, bool)
    for n in range(1 if words else run, min(run, len(size)) + 1):
        counts = (total[n:] - total[:-n] >= words) | (n == run) if words else np.ones(len(size) + 1 - n, bool)
        if words and n > 1:
            yield n, np.flatnonzero(counts & ~(shorter[:-1] & shorter[1:]))
        else:
            yield n, np.flatnonzero(counts)
        shorter = counts


def _lines(words: int | None):
    """Of each text the digests of its lines that aren't blank and, where ``words`` counts, their words."""

    def run(batches):
        for batch in batches:
            for part in c.slices(batch, "text"):
                digests, sizes = [], []
                for text in part.column("text").to_pylist():
                    lines, real = lines_of(text)
                    own = [lines[j].strip(EDGE).encode("utf-8", "surrogatepass") for j in real]
                    digests.append(b"".join(xxhash.xxh3_128_digest(x) for x in own))
                    sizes.append(np.array([len(x.split()) for x in own] if words else [], np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.binary())], ["id", "key", "lines", "sizes"])

    return run


def _fingerprints(lines: bytes, sizes: bytes, run: int, words: int | None):
    """(n, starts, picks): windows of ``n`` lines and the line that each one has as its fingerprint, by number."""
    h = np.frombuffer(lines, np.int64)[::2] & 0x7FFFFFFFFFFFFFFF
    for n, at in windows(np.frombuffer(sizes, np.int32) if words else np.zeros(len(h), np.int32), run, words):
        if len(at):
            yield n, at, winnow(h, n)[at]


def _positions(run: int, words: int | None):
    """Positions of fingerprints: (fp, key, n, pick). Windows of other lengths have other fingerprints."""

    def go(batches):
        for batch in batches:
            fp, keys, ns, picks = [], [], [], []
            for key, lines, sizes in zip(*(batch.column(f).to_pylist() for f in ("key", "lines", "sizes"))):
                h = np.frombuffer(lines, np.int64)[::2] & 0x7FFFFFFFFFFFFFFF
                for n, _, pick in _fingerprints(lines, sizes, run, words):
                    pick = np.unique(pick)
                    fp.append(h[pick] ^ (run - n))
                    picks.append(pick)
                    ns.append(np.full(len(pick), n, np.int32))
                    keys += [key] * len(pick)
            flat = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays([flat(fp, np.int64), pa.array(keys, pa.binary()), flat(ns, np.int32), flat(picks, np.int32)], ["fp", "key", "n", "pick"])

    return go


def _extended(run: int, words: int | None):
    """From each matched fingerprint both ways: the windows that hold it, as (hash, id, key, at, n)."""

    def go(batches):
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            ids = batch.column("id")
            rows = []
            for i, (key, lines, sizes, found) in enumerate(zip(*(batch.column(f).to_pylist() for f in ("key", "lines", "sizes", "found")))):
                matched = {(f["n"], f["pick"]) for f in found}
                for n, at, pick in _fingerprints(lines, sizes, run, words):
                    for w, p in zip(at.tolist(), pick.tolist()):
                        if (n, p) in matched:
                            out[0].append(xxhash.xxh3_128_digest(lines[16 * w : 16 * (w + n)]))
                            out[1].append(key)
                            out[2].append(w)
                            out[3].append(n)
                            rows.append(i)
            made = [pa.array(x, kind) for x, kind in zip(out, (pa.binary(), pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([made[0], ids.take(pa.array(rows, pa.int64())), *made[1:]], ["hash", "id", "key", "at", "n"])

    return go


def repeated_windows(docs: DataFrame, run: int = RUN, text: str = "text", doc_id: str = "doc_id", words: int | None = None) -> DataFrame:
    """(key, starts): the windows that began earlier, by the number of their first line among those that aren't blank, and their lines.

    Only positions of fingerprints are shuffled at first. Those that stand in more than one place are joined, and from each of them
    the match is extended both ways: the windows that hold it are compared by their digests, each with the earliest equal one.
    Lines as frequent as a third of all rows are counted before any shuffle and looked up by a broadcast.
    """
    rows = docs.where(c.col(text).isNotNull()).select(c.col(doc_id).alias("id"), row_key(docs, text, doc_id).alias("key"), c.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    lines = rows.mapInArrow(_lines(words), f"id {kind}, key binary, lines binary, sizes binary").where(F.length("lines") > 0)
    lines = c.checkpoint(lines.dropDuplicates(["key"]), "lines")
    spots = c.checkpoint(lines.select("key", "lines", "sizes").mapInArrow(_positions(run, words), "fp long, key binary, n int, pick int"), "positions")
    often = spots.groupBy("fp").agg(F.count("*").alias("times")).where("times > 1")
    matched = c.lookup(spots, often, "fp", "times").groupBy("key").agg(F.collect_list(F.struct("n", "pick")).alias("found"))
    wins = lines.join(matched, "key").mapInArrow(_extended(run, words), f"hash binary, id {kind}, key binary, at int, n int")
    wins = c.checkpoint(wins.select("hash", F.struct(F.col("id").isNull().alias("no"), "id", "key", "at", "n").alias("place")), "windows")
    first = wins.groupBy("hash").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    later = c.lookup(wins, first, "hash", "times").where("place > first")
    return later.groupBy("place.key").agg(F.collect_set(F.struct("place.at", "place.n")).alias("starts"))


def line_dedup(docs: DataFrame, run: int = RUN, text: str = "text", doc_id: str = "doc_id", removed: str | None = None, words: int | None = None) -> DataFrame:
    """``docs`` without later copies of runs of at least ``run`` lines and, with ``words``, of shorter ones of at least so many words.

    Lines are compared without blanks, tabs and carriage returns around them; blank lines belong to no run and stay. A
    window of ``run`` lines (or of fewer that hold ``words`` words, counted between white space) is a repeat if an equal one begins
    earlier: in a document with a lesser id (nulls last, then by a digest), or further up in the same document, overlaps
    included. All lines in repeats go. Fingerprints are the minima of line hashes in each window; their positions are
    joined, and each match is extended both ways (see ``repeated_windows``), so that every copy is compared with the first
    one and no list of partners is ever cut. Texts of any length are read whole.

    Null and empty texts stay as they are; a text that repeats wholly becomes what blank lines leave of it. Rows equal in
    id and text are one document and get the same result. An empty table gives an empty table. ``removed`` names a
    column for the number of deleted lines, in place of one called so; other columns of any name are kept.
    """
    key, starts, told = c.fresh(docs, "key", "starts", "told")
    again = repeated_windows(docs, run, text, doc_id, words).select(F.col("key").alias(key), F.col("starts").alias(starts))
    joined = docs.withColumn(key, row_key(docs, text, doc_id)).join(again, key, "left")

    def drop(batch):
        for part in c.slices(batch, text):
            cut = part.column(starts)
            if cut.null_count == part.num_rows:  # most slices hold nothing to delete and go on as they are
                yield {}, [pa.array(np.zeros(part.num_rows, np.int64))], part
                continue
            new, n = [], []
            for t, s in zip(part.column(text).to_pylist(), cut.to_pylist()):
                lines, real = lines_of(t) if s else ([], [])
                gone = {real[w["at"] + i] for w in s or () for i in range(w["n"])}
                new.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else t)
                n.append(len(gone))
            yield {text: pa.array(new, part.column(text).type)}, [pa.array(n, pa.int64())], part

    out = c.through(joined, drop, f"`{told}` long", key, starts)
    return out.select(*c.cols(docs, removed or ""), *([c.col(told).alias(removed)] if removed else []))
