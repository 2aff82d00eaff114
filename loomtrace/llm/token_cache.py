"""Token counts through a cache keyed by digests."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: Ranks of a byte-level BPE vocabulary, read once by the driver and broadcast.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before the ranks apply.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SCHEMA = "key binary, n_tokens long, version string"

_ENCODERS: dict[str, object] = {}


def normalised(text: Column) -> Column:
    """Line ends as ``\\n``, no white space around: texts equal in this form have equal counts."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^[ \t\n]+|[ \t\n]+\z", "")


def version(ranks: bytes, pattern: str = PATTERN) -> str:
    """Digest of the tokenizer: its ranks and its pattern."""
    return hashlib.sha256(hashlib.sha256(ranks).digest() + pattern.encode()).hexdigest()


def encoder(ranks: bytes, pattern: str):
    """A tokenizer without special tokens, made once per process."""
    import tiktoken

    name = version(ranks, pattern)
    if name not in _ENCODERS:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _ENCODERS[name]


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Counts stored for one tokenizer version: one row per key, however often it was appended. No folder is an empty cache."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "key binary, n_tokens long")
    stored = spark.read.schema(SCHEMA).parquet(path).where(F.col("version") == tokenizer)
    return stored.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))


def _keyed(docs: DataFrame, name: str, text: str) -> tuple[DataFrame, str, str]:
    key, norm = c.fresh(docs, "key", "norm")
    keyed = docs.withColumn(norm, normalised(c.col(text)))
    return keyed.withColumn(key, F.unhex(F.sha2(F.concat(F.sha2(c.col(norm), 256), F.lit(name)), 256))), key, norm


def fill(docs: DataFrame, cache: str, ranks_path: str = RANKS, pattern: str = PATTERN, text: str = "text") -> None:
    """Encode the distinct texts of ``docs`` that the cache lacks, and append their counts.

    The cache is looked up by keys alone; the misses' texts then meet by key, packed by zlib in the batch that they come from, so
    that each is encoded once and a fraction of its bytes is shuffled. A repeated append is harmless: equal keys hold equal counts.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = f.read()
    name = version(ranks, pattern)
    held = spark.sparkContext.broadcast((ranks, pattern))

    def shrink(batches):
        for batch in batches:
            seen: set[bytes] = set()
            keys, packed = [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("norm").to_pylist()):
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    packed.append(zlib.compress(t.encode("utf-8", "surrogatepass"), 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["key", "packed"])

    def count(batches):
        enc = encoder(*held.value)
        for b in batches:
            n = [len(enc.encode_ordinary(zlib.decompress(t).decode("utf-8", "surrogatepass"))) for t in b.column("packed").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array([name] * len(n), pa.string())], ["key", "n_tokens", "version"])

    keyed, key, norm = _keyed(docs, name, text)
    asked = keyed.where(c.col(key).isNotNull()).select(c.col(key).alias("key"), c.col(norm).alias("norm"))
    packed = asked.mapInArrow(shrink, "key binary, packed binary")
    misses = packed.join(read_cache(spark, cache, name), "key", "left_anti").dropDuplicates(["key"])
    misses.mapInArrow(count, SCHEMA).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, ranks_path: str = RANKS, pattern: str = PATTERN, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text in its normal form.

    The key of a text is the SHA-256 of its normal form's digest and the tokenizer's version. Keys found in the Parquet
    folder ``cache`` are looked up there; of the others each distinct text is encoded once, and its count appended to
    the cache before the result is read from it (see ``fill``). The lookup moves keys and counts only, unless the caller keeps the texts.

    A null text has a null count, an empty or blank one 0; texts of any length are encoded whole; repeated rows, and texts that
    tie in their normal form, each have their count. An empty table gives an empty table. A column called like ``into`` is
    replaced, others are kept.
    """
    fill(docs, cache, ranks_path, pattern, text)
    with open(ranks_path, "rb") as f:
        name = version(f.read(), pattern)
    keyed, key, norm = _keyed(docs, name, text)
    counts = read_cache(docs.sparkSession, cache, name).select(F.col("key").alias(key), F.col("n_tokens").alias(norm))
    return keyed.drop(norm).join(counts, key, "left").select(*c.cols(docs, into), c.col(norm).alias(into))
