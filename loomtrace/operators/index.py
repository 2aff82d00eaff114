"""An inverted index over steps: whole words, phrases and BM25, kept as Parquet.

Layout of an index folder: ``docs`` (path, step_id, content, n tokens), ``postings`` (term, path, step_id, n tokens of the step, tf, positions),
partitioned by a hash of the term so that a query reads the buckets of its own words only, and ``records`` (path, mtime,
docs, tokens), partitioned by generation, for the incremental build and the sums that BM25 needs. ``buckets=N`` names
the number of buckets.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans import scratch
from . import search

#: Buckets of terms, and parts by text into which each is cut, so that no word is one task. More for larger corpora.
BUCKETS, PARTS = 64, 4
K1, B = 1.2, 0.75
#: Tokens whose postings a task makes at a time.
TOKENS = 1 << 20


def _folds() -> tuple[str, str]:
    """Latin letters with one mark, and the letters without it."""
    marked, bare = [], []
    for i in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(i).lower())
        if len(d) == 2 and "a" <= d[0] <= "z" and chr(i).lower() == chr(i):
            marked.append(chr(i))
            bare.append(d[0])
    return "".join(marked), "".join(bare)


MARKED, BARE = _folds()


def tokens(column: Column) -> Column:
    """Runs of letters and digits, lower case, without accents of one mark."""
    return F.regexp_extract_all(F.translate(F.lower(column), MARKED, BARE), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _told(spark: SparkSession, expressions: list[Column]) -> list:
    """Values of expressions over constants; no task is run for them."""
    return list(spark.sql("SELECT 1 AS one").select(*(e.alias(f"v{i}") for i, e in enumerate(expressions))).collect()[0])


def query_phrases(spark: SparkSession, query: str) -> list[list[list[str]]]:
    """Alternatives of words, each word as the phrase of tokens it falls into."""
    clauses = text.parse_query(query)
    words = list(dict.fromkeys(search.words_of(clauses)))
    if not words:
        return []
    cut = dict(zip(words, _told(spark, [tokens(F.lit(w)) for w in words])))
    return [[cut[w] for w in words] for words in clauses]


def spaced(toks: Column) -> Column:
    """Tokens as one text, a blank on either side of each, so that phrases can be counted by a single pass over it."""
    return F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))


def phrase_count(text_: Column, phrase: list[str]) -> Column:
    """How often a phrase occurs in tokens laid out by ``spaced``; occurrences may overlap. Tokens are letters and digits, so nothing needs quoting."""
    if not phrase:
        return F.lit(0)
    return F.regexp_count(text_, F.lit("(?= " + "  ".join(phrase) + " )"))


def _live(counts: dict[int, Column], clauses: list[list[int]]) -> tuple[Column, list[Column]]:
    """Whether a row matches, and per phrase whether it stands in an alternative that holds."""
    holds = []
    for c in clauses:
        ok = F.lit(bool(c))
        for i in c:
            ok = ok & (counts[i] > 0)
        holds.append(ok)
    any_ = F.lit(False)
    for h in holds:
        any_ = any_ | h
    return any_, holds


def rank(docs: DataFrame, clauses: list[list[list[str]]], toks: str = "toks") -> DataFrame:
    """Matching rows of ``docs`` with ``rank``, lowest first: minus the BM25 of the phrases in alternatives that hold.

    Two passes over the rows: numbers of rows, mean length and rows per phrase are one aggregate with one row as its
    result, which is cross-joined; nothing is sorted or shuffled.
    """
    phrases = [p for p in dict.fromkeys(tuple(p) for c in clauses for p in c)]
    if not phrases:
        return docs.where("false").withColumn("rank", F.lit(0.0))
    number = {p: i for i, p in enumerate(phrases)}
    ids = [[number[tuple(p)] for p in c] for c in clauses]
    counted = docs.withColumns({f"_c{i}": phrase_count(spaced(F.col(toks)), list(p)) for p, i in number.items()} | {"_n": F.size(toks)})
    sums = counted.agg(F.count("*").alias("_rows"), F.avg("_n").alias("_avg"), *(F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in number.values()))
    match, holds = _live({i: F.col(f"_c{i}") for i in number.values()}, ids)
    both = counted.where(match).crossJoin(F.broadcast(sums))  # one row
    score = F.lit(0.0)
    for c, ok in zip(ids, holds):
        for i in c:
            idf = F.log((F.col("_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
            idf = F.when(idf <= 0, 1e-6).otherwise(idf)
            f = F.col(f"_c{i}").cast("double")
            score = score + F.when(ok, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))).otherwise(0.0)
    drop = [f"_c{i}" for i in number.values()] + [f"_d{i}" for i in number.values()] + ["_rows", "_avg", "_n"]
    return both.withColumn("rank", -score).drop(*drop)


# ── the stored index ──────────────────────────────────────────────────────────


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _ls(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _layout(spark: SparkSession, folder: str) -> int:
    return next((int(n.split("=")[1]) for n in _ls(spark, folder) if n.startswith("buckets=")), BUCKETS)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def stale(records: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """(path, mtime) of those records that are new or changed since the index was built; all of them with ``force``."""
    now = records.select("path", F.coalesce(F.col("mtime").cast("double"), F.lit(0.0)).alias("mtime"))
    if force or not _exists(records.sparkSession, f"{folder}/records"):
        return now
    return now.join(latest(records.sparkSession, folder).where("mtime <> 0").select("path", "mtime"), ["path", "mtime"], "left_anti")


def _slices(size: np.ndarray, most: int = TOKENS) -> list[tuple[int, int]]:
    """Runs of rows of at most ``most`` tokens together, or a single row."""
    out, first, held = [], 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and held + n > most:
            out.append((first, i))
            first, held = i, 0
        held += n
    return [*out, (first, len(size))] if len(size) > first else out


def _block(b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (path, step_id, toks) to one row for each word of each step, by term. A word's places are told apart by sorting numbers."""
    lists = b.column("toks")
    size = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    pos = (np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    order = np.lexsort((row, code))  # stable: places stay in order
    row, code, pos = row[order], code[order], pos[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (code[1:] != code[:-1]))))
    ends = np.concatenate((first, [len(row)])).astype(np.int32)
    at = pa.array(row[first])
    columns = [flat.dictionary.take(pa.array(code[first])), b.column("path").take(at), b.column("step_id").take(at), pa.array(size[row[first]].astype(np.int32)), pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos))]
    names = ["term", "path", "step_id", "n", "tf", "positions"]
    if "buckets" in b.schema.names:
        columns, names = [*columns, b.column("buckets").flatten().take(pa.array(order[first]))], [*names, "bucket"]
    return pa.RecordBatch.from_arrays(columns, names)


def _postings(batches):
    """Postings of (path, step_id, toks), from ``TOKENS`` tokens at a time."""
    for b in batches:
        size = pc.list_value_length(b.column("toks")).fill_null(0).to_numpy(zero_copy_only=False)
        for first, end in _slices(size):
            yield _block(b.slice(first, end - first))


def _packed(parts: int):
    """(bucket, part, block) from (path, step_id, toks, buckets): a run's postings of each bucket as one compressed Arrow stream. The part is told by the run's first path."""

    def run(batches):
        for b in batches:
            size = pc.list_value_length(b.column("toks")).fill_null(0).to_numpy(zero_copy_only=False)
            for first, end in _slices(size):
                rows = b.slice(first, end - first)
                post = _block(rows)
                bucket = post.column("bucket").to_numpy()
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                at, blocks = [], []
                for i, j in zip(edges[:-1], edges[1:]) if len(order) else ():
                    some = post.take(pa.array(order[i:j])).drop_columns(["bucket"])
                    some = pa.RecordBatch.from_arrays([c.dictionary_encode() if k in ("term", "path") else c for k, c in zip(some.schema.names, some.columns)], some.schema.names)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(some)
                    at.append(int(bucket[order[i]]))
                    blocks.append(sink.getvalue().to_pybytes())
                part = zlib.crc32(rows.column("path")[0].as_py().encode()) % parts
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([part] * len(at), pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "part", "block"])

    return run


def _unpacked(batches):
    """Rows (bucket, block) to postings, a block at a time."""
    for b in batches:
        for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block")):
            for some in pa.ipc.open_stream(block.as_buffer()):
                cols = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in some.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(some), bucket, np.int32))], [*some.schema.names, "bucket"])


def build(records: DataFrame, steps: DataFrame, folder: str, force: bool = False, buckets: int = BUCKETS, parts: int = PARTS) -> tuple[int, int]:
    """Index the steps of ``records(path, mtime, ...)`` that are new or changed; (indexed, skipped).

    A record is skipped if its time is known and the same as before. Sessions that vanished stay in the index. Each
    build appends a generation; reading takes each session's latest, so that nothing is rewritten in place and a build
    that fails leaves the index as it was: the generation counts once its ``records`` are written, last. What is shuffled are
    postings in compressed blocks, once, by bucket and part; texts are cut into words a second time to count them, so
    that no words are written.
    """
    spark = records.sparkSession
    todo = scratch.keep(stale(records, folder, force), "todo")
    done = [int(n.split("=")[1]) for n in _ls(spark, f"{folder}/records") if n.startswith("generation=")]
    generation = max(done, default=-1) + 1
    n, total = todo.count(), records.count()
    if n:
        buckets = _layout(spark, folder) if done else buckets
        docs = steps.join(todo.select("path"), "path", "left_semi").select("path", "step_id", F.array_join(search.blobs(), "\n").alias("content")).where(~text.is_blank(F.col("content")))
        kind = steps.schema["step_id"].dataType.simpleString()
        docs.withColumns({"n": F.size(tokens(F.col("content"))), "generation": F.lit(generation)}).write.mode("append").parquet(f"{folder}/docs")
        own = spark.read.schema(f"path string, step_id {kind}, content string, n int, generation int").parquet(f"{folder}/docs").where(F.col("generation") == generation)
        toks = own.select("path", "step_id", tokens(F.col("content")).alias("toks"))
        toks = toks.withColumn("buckets", F.transform("toks", lambda t: _bucket(t, buckets)))
        block = toks.mapInArrow(_packed(parts), "bucket int, part int, block binary").repartition(buckets * parts, "bucket", "part")
        post = block.select("bucket", "block").mapInArrow(_unpacked, f"term string, path string, step_id {kind}, n int, tf int, positions array<int>, bucket int")
        post = post.withColumn("generation", F.lit(generation)).sortWithinPartitions("bucket", "term")
        post.write.mode("append").partitionBy("bucket").parquet(f"{folder}/postings")
        sizes = own.groupBy("path").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))
        told = todo.join(sizes, "path", "left").select("path", "mtime", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("docs", "tokens")))
        if not done:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/buckets={buckets}")
            p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
        told.write.parquet(f"{folder}/records/generation={generation}")
    scratch.drop(todo)
    return n, total - n


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, generation, mtime, docs, tokens) of each indexed session."""
    read = spark.read.parquet(f"{folder}/records")
    if len(_ls(spark, f"{folder}/records")) == 1:
        return read
    last = read.groupBy("path").agg(F.max_by(F.struct("generation", "mtime", "docs", "tokens"), "generation").alias("r"))
    return last.select("path", "r.*")


def _scored(spark: SparkSession, folder: str, query: str) -> DataFrame | None:
    """(path, step_id, generation, rank) of matching steps; None where the query has no word."""
    if not _exists(spark, f"{folder}/records"):
        raise FileNotFoundError(f"there is no index in {folder}; build it first")
    clauses = [c for c in query_phrases(spark, query) if c and all(c)]  # a word without any token is found nowhere
    phrases = [p for p in dict.fromkeys(tuple(p) for c in clauses for p in c)]
    if not phrases:
        return None
    terms = sorted({t for p in phrases for t in p})
    buckets = _layout(spark, folder)
    held = sorted(set(_told(spark, [_bucket(F.lit(t), buckets) for t in terms])))
    now = latest(spark, folder)
    post = spark.read.parquet(f"{folder}/postings").where(F.col("bucket").isin(held) & F.col("term").isin(terms))
    if len(_ls(spark, f"{folder}/records")) > 1:  # one generation holds no outdated step
        post = post.join(now.select("path", "generation"), ["path", "generation"])
    keys = ["path", "step_id", "generation"]
    if len(terms) == 1 and len(phrases[0]) == 1:
        rows = post.select(*keys, "n", F.col("tf").alias("_c0"))
    else:
        of = lambda column, t: F.max(F.when(F.col("term") == t, F.col(column)))
        chained = sorted({t for p in phrases if len(p) > 1 for t in p})
        name = {t: f"_p{i}" for i, t in enumerate(chained)}
        met = post.groupBy(*keys).agg(F.max("n").alias("n"), *(of("tf", p[0]).alias(f"_c{i}") for i, p in enumerate(phrases) if len(p) == 1), *(of("positions", t).alias(name[t]) for t in chained))
        places = lambda t: F.coalesce(F.col(name[t]), F.array().cast("array<int>"))
        counts = {}
        for i, p in enumerate(phrases):
            if len(p) == 1:
                counts[f"_c{i}"] = F.coalesce(F.col(f"_c{i}"), F.lit(0))
                continue
            starts = places(p[0])
            for k, t in enumerate(p[1:], 1):
                starts = F.array_intersect(starts, _shift(places(t), k))
            counts[f"_c{i}"] = F.size(starts)
        rows = met.withColumns(counts).select(*keys, "n", *counts)
    sums = now.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).first()
    per = rows.agg(*(F.count_if(F.col(f"_c{i}") > 0) for i in range(len(phrases)))).first()
    total, mean = sums.docs or 0, (sums.tokens or 0) / max(1, sums.docs or 0)
    number = {p: i for i, p in enumerate(phrases)}
    ids = [[number[tuple(p)] for p in c] for c in clauses]
    match, holds = _live({i: F.col(f"_c{i}") for i in range(len(phrases))}, ids)
    score = F.lit(0.0)
    for c, ok in zip(ids, holds):
        for i in c:
            idf = float(np.log((total - per[i] + 0.5) / (per[i] + 0.5)))
            f = F.col(f"_c{i}").cast("double")
            score = score + F.when(ok, F.lit(idf if idf > 0 else 1e-6) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / mean))).otherwise(0.0)
    return rows.where(match).select(*keys, (-score).alias("rank"))


def lookup(spark: SparkSession, folder: str, query: str, limit: int | None = None, snippets: bool = True) -> DataFrame:
    """Every matching step of an index, best first: path, step_id, rank, snippet. Whole words and phrases, without case and accents.

    Reads the posting buckets of the query's words only; a phrase is found by the positions of its words. Scores need no
    other table. Contents are read for snippets alone, and with ``limit`` for so many rows only.
    """
    hits = _scored(spark, folder, query)
    if hits is None:
        return spark.read.parquet(f"{folder}/docs").where("false").select("path", "step_id", F.lit(0.0).alias("rank"), F.lit("").alias("snippet"))
    order = ["rank", "path", "step_id"]
    if limit is not None:
        hits = hits.orderBy(*order).limit(limit)
    if not snippets:
        return hits.select(*order).orderBy(*order)
    return attach(spark, folder, query, hits).select(*order, "snippet").orderBy(*order)


def ranked(spark: SparkSession, folder: str, query: str, records: DataFrame) -> DataFrame:
    """Matching steps with the columns of their records, best first and without snippets: for counting, and for cutting a page that ``attach`` completes."""
    hits = _scored(spark, folder, query)
    if hits is None:
        hits = spark.read.parquet(f"{folder}/docs").where("false").select("path", "step_id", "generation", F.lit(0.0).alias("rank"))
    return hits.join(records.drop("mtime"), "path").orderBy("rank", "path", "step_id")


def attach(spark: SparkSession, folder: str, query: str, hits: DataFrame) -> DataFrame:
    """``hits(path, step_id, generation, ...)`` with their snippets; contents of these steps alone are kept from the scan."""
    docs = spark.read.parquet(f"{folder}/docs").select("path", "step_id", "generation", "content")
    words = search.words_of(text.parse_query(query))
    return hits.join(docs, ["path", "step_id", "generation"]).withColumn("snippet", text.snippet(F.col("content"), words)).drop("content")


def _shift(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def best(hits: DataFrame, limit: int = search.CANDIDATES) -> DataFrame:
    """(path, rank) of the ``limit`` sessions whose best step ranks first; ranks equal to nine places go by path."""
    return hits.groupBy("path").agg(F.round(F.min("rank"), 9).alias("rank")).orderBy("rank", "path").limit(limit)


def capped(hits: DataFrame, records: DataFrame, steps: DataFrame, query: str, limit: int = search.CANDIDATES) -> DataFrame:
    """The substring search in the steps of the ``limit`` best sessions of a ranked search, ``hits(path, rank, ...)``.

    The limit is what this backend is: a cap on candidates that keeps a search short. ``grep`` looks at everything. First
    messages by themselves don't count. Records without a file, which an outside index can't hold, are searched
    all, but for those whose file is a candidate already.
    """
    top = F.broadcast(best(hits, limit).select("path"))  # ``limit`` rows
    stored = records.where(F.col("session_id").isNotNull()) if "session_id" in records.columns else records.where("false")
    if "source" in records.columns:
        stored = stored.join(top.select(F.col("path").alias("_rollout")), F.try_element_at("source", F.lit("rollout_path")) == F.col("_rollout"), "left_anti")
    mine = records.join(top, "path", "left_semi").unionByName(stored.join(top, "path", "left_anti"))
    some = steps.join(mine.select("path"), "path", "left_semi") if "session_id" in records.columns else steps.join(top, "path", "left_semi")
    return search.grep(mine.withColumn("first_msg", F.lit("")), some, query)


@search.register("index", "sqlite")
def _index(corpus: search.Corpus, query: str) -> DataFrame:
    hits = ranked(corpus.spark, corpus.folder, query, corpus.records)
    return attach(corpus.spark, corpus.folder, query, hits).drop("generation").orderBy("rank", "path", "step_id")


@search.register("candidates", "recoll")
def _candidates(corpus: search.Corpus, query: str) -> DataFrame:
    return capped(lookup(corpus.spark, corpus.folder, query, snippets=False), corpus.records, corpus.steps, query)
