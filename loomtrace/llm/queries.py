"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import scratch
from .common import table
from .mixing import Tree

#: Target weights for the sources of ``documents``.
TREE = Tree(
    domains={"web": [f"src{i}" for i in range(5)], "forum": [f"src{i}" for i in range(5, 10)], "books": [f"src{i}" for i in range(10, 15)]},
    weights={"domain": {"web": 0.5, "forum": 0.2, "books": 0.2, "reference": 0.1}, "lang": {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}},
    other={"domain": 0.05, "lang": 0.05},
)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embedding_dedup

    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "label")


def op1_embedding_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with all columns of the kept rows."""
    from . import embedding_dedup

    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii_crf

    return pii_crf.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), TREE, with_epoch=True).select("doc_id", "lang", "source", "epoch")


def op3_mixing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 with all columns of the drawn rows."""
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents"), TREE, with_epoch=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. The cache holds the English documents' counts from a call before, so that these are found and
    the others are encoded and appended."""
    from . import token_cache

    cache = scratch.folder(spark, "token-cache")
    docs = table(spark, sf_dir, "documents")
    token_cache.fill(docs.where("lang = 'en'").select("text"), cache)
    return token_cache.token_counts(docs.select("doc_id", "text"), cache).select("doc_id", "n_tokens")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source")


def op5_exact_dedup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5 with all columns of the kept rows."""
    from . import exact_dedup

    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import line_dedup

    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 with single lines and pairs of lines as runs too, if they hold ``WORDS`` words."""
    from . import line_dedup

    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed", words=line_dedup.WORDS)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_blocks

    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_mil

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_mil.score(docs, quality_mil.fit(docs, table(spark, sf_dir, "labels")))
    return scored.selectExpr("doc_id", "score", "score >= 0.5 AS keep")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))



QUERIES = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_pii, op3_mixing, op4_token_counts, op5_exact_dedup, op6_line_dedup, op7_simhash_dedup, op8_html_text, op9_quality, op10_packing)
}

#: Further queries of the same operators.
MORE = {f.__name__: f for f in (op1_embedding_dedup_rows, op3_mixing_rows, op5_exact_dedup_rows, op6_passage_dedup)}


def _mixing_sql() -> str:
    """Water-filling level by level: among siblings in the order of capacity over weight, those are full whose capacity is within
    the level that their own rest allows; the others share what is left by weight."""
    from . import mixing

    case = lambda column, table, other: "CASE " + column + "".join(f" WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other!r} END" if table else repr(other)
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(repr(x) for x in m)}) THEN '{d}'" for d, m in TREE.domains.items()) + " ELSE 'reference' END"
    parts = [
        f"""d AS (SELECT doc_id, documents.lang AS own_lang, documents.source AS own_source, {domain} AS domain, coalesce(documents.lang, '(none)') AS lang,
coalesce(documents.source, '(none)') AS source, len(regexp_extract_all(text, '\\S+'))::DOUBLE AS tok, md5(text) AS digest FROM documents)""",
        "leaves AS (SELECT domain, lang, source, sum(tok) AS n FROM d GROUP BY ALL)",
        "b0 AS (SELECT sum(n) AS budget FROM leaves)",
    ]
    above: list[str] = []
    for i, level in enumerate(mixing.LEVELS, 1):
        keys = [*above, level]
        group = ", ".join(keys)
        within = f"PARTITION BY {', '.join(above)}" if above else ""
        join = " AND ".join(f"x.{k} = p.{k}" for k in above) or "true"
        parts.append(f"x{i} AS (SELECT {group}, sum(n) * {mixing.MAX_EPOCHS} AS cap, {case(level, TREE.weights.get(level, {}), TREE.other.get(level, 1.0))} AS w FROM leaves GROUP BY {group})")
        parts.append(
            f"""y{i} AS (SELECT {', '.join('x.' + k for k in keys)}, x.cap, x.w, p.budget,
(p.budget - coalesce(sum(x.cap) OVER ({within.replace('BY ', 'BY x.').replace(', ', ', x.')} ORDER BY x.cap / x.w, x.{level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
/ sum(x.w) OVER ({within.replace('BY ', 'BY x.').replace(', ', ', x.')} ORDER BY x.cap / x.w, x.{level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM x{i} x JOIN b{i - 1} p ON {join})"""
        )
        first = f"min(CASE WHEN cap > share * w THEN cap / w END) OVER ({within})"
        parts.append(f"z{i} AS (SELECT *, {first} AS brim FROM y{i})")
        # before the first that isn't full, all are; from it on, its level holds
        level_at = f"arg_min(CASE WHEN cap > share * w THEN share END, CASE WHEN cap > share * w THEN (cap / w, {level}) END) OVER ({within})"
        parts.append(f"b{i} AS (SELECT {group}, CASE WHEN brim IS NULL OR cap / w < brim THEN cap ELSE w * {level_at} END AS budget FROM z{i})")
        above = keys
    parts += [
        "plan AS (SELECT l.*, floor(b.budget + 1e-6) AS budget FROM leaves l JOIN b3 b USING (domain, lang, source))",
        "p2 AS (SELECT domain, lang, source, CASE WHEN n > 0 THEN floor(budget / n) ELSE 0 END AS whole, CASE WHEN n > 0 THEN budget - floor(budget / n) * n ELSE 0 END AS room FROM plan)",
        f"""r AS (SELECT d.*, p2.whole::BIGINT AS whole, p2.room, sum(tok) OVER (PARTITION BY domain, lang, source
ORDER BY md5('{mixing.SEED}:' || (p2.whole + 1)::BIGINT || ':' || doc_id || ':' || digest) RANGE UNBOUNDED PRECEDING) AS cum FROM d JOIN p2 USING (domain, lang, source))""",
        "e AS (SELECT doc_id, own_lang AS lang, own_source AS source, whole + CASE WHEN room > 0 AND cum <= room THEN 1 ELSE 0 END AS epochs FROM r)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, lang, source, unnest(generate_series(1, epochs)) AS epoch FROM e WHERE epochs > 0"


ORACLES: dict[str, str] = {
    "op3_mixing": _mixing_sql(),
    "op1_embedding_dedup": """
WITH RECURSIVE near AS (
    SELECT a.vec_id AS p, b.vec_id AS q FROM embeddings a JOIN embeddings b
    ON list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
), reach AS (
    SELECT vec_id AS p, vec_id AS q FROM embeddings
    UNION
    SELECT r.p, n.q FROM reach r JOIN near n ON r.q = n.p
)
SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT p FROM reach GROUP BY p HAVING min(q) = p)
""",
    "op5_exact_dedup": """
SELECT doc_id, lang, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
""",
    "op6_line_dedup": """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), real AS (
    SELECT doc_id, no, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), wins AS (
    SELECT doc_id, k, t AS t1, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3 FROM real WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), again AS (
    SELECT doc_id, k FROM wins WHERE t3 IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY t1, t2, t3 ORDER BY doc_id, k) > 1
), gone AS (
    SELECT DISTINCT r.doc_id, r.no FROM real r JOIN again a ON r.doc_id = a.doc_id AND r.k BETWEEN a.k AND a.k + 2
), kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id
), n AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
}

MORE_ORACLES: dict[str, str] = {
    "op1_embedding_dedup_rows": f"SELECT e.* FROM embeddings e JOIN ({ORACLES['op1_embedding_dedup']}) kept ON e.vec_id = kept.vec_id",
    "op3_mixing_rows": f"SELECT d.*, drawn.epoch FROM documents d JOIN ({ORACLES['op3_mixing']}) drawn ON d.doc_id = drawn.doc_id",
    "op5_exact_dedup_rows": """
SELECT * FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1
""",
    "op6_passage_dedup": """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), real AS (
    SELECT doc_id, no, trim(line, ' ' || chr(9) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), sized AS (
    SELECT *, len(regexp_extract_all(t, '[^\\s\\x0B]+')) AS size FROM real
), next AS (
    SELECT doc_id, k, t AS t1, lead(t, 1) OVER w AS t2, lead(t, 2) OVER w AS t3, size AS s1, size + lead(size, 1) OVER w AS s2
    FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), wins AS (
    SELECT doc_id, k, 1 AS n, [t1] AS win FROM next WHERE s1 >= 8
    UNION ALL SELECT doc_id, k, 2, [t1, t2] FROM next WHERE s2 >= 8
    UNION ALL SELECT doc_id, k, 3, [t1, t2, t3] FROM next WHERE t3 IS NOT NULL
), again AS (
    SELECT doc_id, k, n FROM wins QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, k) > 1
), gone AS (
    SELECT DISTINCT r.doc_id, r.no FROM real r JOIN again a ON r.doc_id = a.doc_id AND r.k BETWEEN a.k AND a.k + a.n - 1
), kept AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.no) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.no = g.no GROUP BY l.doc_id
), n AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.text, '') AS text, coalesce(n.n, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
}
