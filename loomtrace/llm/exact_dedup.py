"""Exact dedup with a heavy-hitter split."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Counters of each Misra-Gries summary. Digests above 2 / (COUNTERS + 1) of all rows are surely found; at most COUNTERS are broadcast.
COUNTERS = 1000


def digest(text):
    """256 bits of the exact text. Null is a value of its own, apart from the empty text."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b"\x00"))


def merged(counts: dict, more: dict, k: int) -> dict:
    """Misra-Gries summaries added, then cut back to ``k`` counters by the (k+1)-th largest count."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - cut for key, n in counts.items() if n > cut}
    return counts


def _summaries(k: int):
    def run(batches):
        counts: dict[bytes, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            vc = pc.value_counts(batch.column(0))
            counts = merged(counts, dict(zip(vc.field(0).to_pylist(), vc.field(1).to_pylist())), k)
        yield pa.RecordBatch.from_arrays([pa.array([None, *counts], pa.binary()), pa.array([rows, *counts.values()], pa.int64())], ["digest", "n"])

    return run


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Of ``digests(digest, ...)``, those that may hold over 1 / (k+1) of the rows: at most k. One row per partition's counter is shuffled."""
    parts = digests.select("digest").mapInArrow(_summaries(k), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n"))
    parts = c.checkpoint(parts)
    rows = parts.where("digest is null").agg(F.sum("n")).first()[0] or 0
    return parts.where(F.col("digest").isNotNull() & (F.col("n") * (k + 1) > rows)).select("digest")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` without repeated texts: of each text the row with the least ``doc_id`` stays.

    A Misra-Gries pass finds frequent digests; their exact counts and winners are taken and broadcast (at most ``k``
    rows), so that all other copies fall on the map side. What remains is shuffled once by its digest.

    Null ids come after all others; rows equal in id and text are decided by a hash of all columns; wholly equal rows
    leave one. A null text is a value like any other (one row with null text stays), apart from the empty text. An
    empty table gives an empty table. Extra columns of any name are kept.
    """
    dig, tie, win, rank = c.fresh(docs, "digest", "tie", "win", "rank")
    place = F.struct(c.col(doc_id).isNull().alias("no"), c.col(doc_id).alias("id"), c.row_hash(docs, text).alias("tie"))
    keyed = docs.withColumn(dig, digest(c.col(text))).withColumn(tie, place)
    narrow = c.checkpoint(keyed.select(c.col(dig).alias("digest"), c.col(tie).alias("place")))
    heavy = narrow.join(F.broadcast(frequent(narrow, k)), "digest").groupBy("digest").agg(F.min("place").alias("place"))
    heavy = docs.sparkSession.createDataFrame(heavy.collect(), heavy.schema)  # at most k rows
    left = keyed.join(F.broadcast(heavy.select(F.col("digest").alias(dig), F.col("place").alias(win))), dig, "left")
    left = left.where(c.col(win).isNull() | c.col(win).eqNullSafe(c.col(tie)))
    order = Window.partitionBy(c.col(dig)).orderBy(c.col(tie))
    return left.withColumn(rank, F.row_number().over(order)).where(c.col(rank) == 1).select(*c.cols(docs))
