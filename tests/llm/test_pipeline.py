import corpus_pipeline
from loomtrace.llm import mixing, packing, quality_mil, queries, simhash
from test_dedup import brute_groups
from test_mixing import brute


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = []
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(at)
    model = quality_mil.fit(docs, labels)
    p = model.score([r.text for r in rows.values()])
    good = {i for i, s in zip(rows, p) if s >= 0.5}
    assert {r.doc_id for r in kept[0].collect()} == good
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & bad) <= 2 and len(good) > 0.7 * len(rows)
    first = {}
    for i in sorted(good):
        first.setdefault(rows[i].text, i)
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted(first.values())
    order = sorted(first.values())
    root = brute_groups(simhash.signatures([rows[i].text for i in order]), simhash.DISTANCE)
    assert sorted(r.doc_id for r in kept[2].collect()) == sorted({order[i] for i in root})
    near = {r.doc_id for r in kept[2].collect()}
    mixed = kept[3].collect()
    assert {r.doc_id for r in mixed} <= near
    drawn = brute([(i, rows[i].text, rows[i].lang, rows[i].source) for i in near], 1.0, mixing.MAX_EPOCHS)
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, _ in drawn)
    tokens = sum(len(r.text.split()) for r in mixed)
    used = sum(r.used for r in kept[4].collect())
    assert used == tokens
    assert all(0 < r.used <= packing.WINDOW for r in kept[4].collect())
    assert sum(r.used for r in corpus_pipeline.run(spark, sf).collect()) == used


def test_every_operator_has_a_query():
    names = list(queries.QUERIES)
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLES) <= set(names)


def test_queries_of_kept_rows_have_all_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = {tuple(r) for r in docs.collect()}
    for name, f in (("op5_exact_dedup_rows", queries.MORE), ("op7_simhash_dedup", queries.QUERIES)):
        got = f[name](spark, sf)
        assert got.columns == docs.columns
        assert {tuple(r) for r in got.collect()} <= whole
    assert queries.MORE["op3_mixing_rows"](spark, sf).columns == [*docs.columns, "epoch"]
    assert queries.MORE["op1_embedding_dedup_rows"](spark, sf).columns == spark.read.parquet(f"{sf}/embeddings.parquet").columns


def test_token_query_finds_appends_and_counts_all(spark, sf, monkeypatch):
    """Of the cache that the query leaves: the English texts came first, the others were appended, and every count is the tokenizer's."""
    from loomtrace.llm import token_cache

    calls, real = [], token_cache.fill
    monkeypatch.setattr(token_cache, "fill", lambda docs, cache, *a, **k: (real(docs, cache, *a, **k), calls.append((cache, spark.read.parquet(cache).count()))))
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op4_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    normal = lambda t: t.replace("\r\n", "\n").replace("\r", "\n").strip(" \t\n")
    english, every = ({normal(r.text) for r in docs if all_ or r.lang == "en"} for all_ in (False, True))
    assert [n for _, n in calls] == [len(english), len(every)] and 0 < len(english) < len(every)
    with open(token_cache.RANKS, "rb") as f:
        enc = token_cache.encoder(f.read(), token_cache.PATTERN)
    assert got == {r.doc_id: len(enc.encode_ordinary(normal(r.text))) for r in docs}
