"""Every operator and every stage over rows with nulls, repeats, large ids and columns of clashing and awkward names."""

import pytest

import corpus_pipeline
from loomtrace.llm import embedding_dedup, exact_dedup, html_blocks, line_dedup, mixing, packing, pii_crf, quality_mil, simhash, token_cache
from loomtrace.llm.queries import TREE

BIG = 9007199254740993  # no double holds it
MORE = "`a.b` string, Spans string, Epoch int, N_Tokens int, N_Removed int, Score double, _Digest string, `key` string, `row` int, made0 int, w0 long, m map<string,int>"
EXTRA = ("dot", "s", 1, 2, 3, 0.5, "d", "k", 4, 5, 6, {"x": 1})
FIRST, SECOND = "one two three four five six seven", "acht neun zehn elf\nzwoelf dreizehn\nvierzehn"
TEXTS = [(BIG, FIRST), (None, FIRST), (BIG + 2, None), (None, None), (1, ""), (1, ""), (7, SECOND), (7, SECOND), (5, " \n "), (BIG + 4, "word " * 40_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "src1" if t else None, None, *EXTRA) for i, t in TEXTS], f"doc_id long, text string, lang string, source string, n_chars long, {MORE}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def order(ids):
    return sorted(ids, key=lambda x: (x is None, x))


ALL = order(i for i, _ in TEXTS)
FIELD = pii_crf.train(pii_crf.labelled_table(100), epochs=3)
#: By operator: what is called, the ids that it keeps, and columns that take the place of others or come on top.
OPERATORS = {
    "op2": (lambda d, labels, tmp: pii_crf.redact(d, FIELD), ALL, {"spans"}),
    "op3": (lambda d, labels, tmp: mixing.mix(d, TREE, 4.0, with_epoch=True), None, {"epoch"}),
    "op4": (lambda d, labels, tmp: token_cache.token_counts(d, f"file://{tmp}/cache"), ALL, {"n_tokens"}),
    "op5": (lambda d, labels, tmp: exact_dedup.exact_dedup(d), order([BIG, BIG + 2, 1, 7, 5, BIG + 4]), set()),
    "op6": (lambda d, labels, tmp: line_dedup.line_dedup(d, removed="n_removed"), ALL, {"n_removed"}),
    "op6 words": (lambda d, labels, tmp: line_dedup.line_dedup(d, removed="n_removed", words=5), ALL, {"n_removed"}),
    "op7": (lambda d, labels, tmp: simhash.simhash_dedup(d), order([BIG, BIG + 2, None, 1, 1, 7, 5, BIG + 4]), set()),
    "op9": (lambda d, labels, tmp: quality_mil.score(d, None), ALL, {"score"}),
    "op9 kept": (lambda d, labels, tmp: quality_mil.keep_good(d, labels), order([BIG, None, 7, 7, BIG + 4]), set()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(spark, docs, labels, tmp_path, name):
    call, want, made = OPERATORS[name]
    call(docs.repartition(3), labels, tmp_path).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    plain = lambda names: sorted(c for c in names if c.lower() not in made)
    assert plain(got.columns) == plain(docs.columns) and made <= set(got.columns)
    rows = got.collect()
    ids = [r.doc_id for r in rows]
    assert order(ids) == want if want is not None else set(ids) <= set(ALL) and BIG in ids
    assert all(r["a.b"] == "dot" and r.m == {"x": 1} and r["row"] == 4 for r in rows)
    empty = call(docs.limit(0), labels, tmp_path / "none")
    assert empty.columns == call(docs, labels, tmp_path / "again").columns and empty.count() == 0


def test_embeddings(spark, tmp_path):
    kind = f"vec_id long, embedding array<float>, Label int, node string, tie string, {MORE}"
    rows = [(BIG, [1.0, 0.0]), (None, [2.0, 0.0]), (BIG + 2, None), (3, []), (3, []), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "n", "t", *EXTRA) for i, v in rows], kind)
    embedding_dedup.embedding_dedup(df).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.columns == df.columns and order(r.vec_id for r in got.collect()) == [3, 3, 4, 5, BIG, BIG + 2]
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_pages(spark, tmp_path):
    page = "<p>" + "word " * 50
    df = spark.createDataFrame([(i, h, "mine", *EXTRA) for i, h in [(BIG, page), (None, page), (2, None), (2, None), (3, "")]], f"page_id long, html string, Text string, {MORE}")
    html_blocks.extract(df).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.columns == [*(c for c in df.columns if c not in ("html", "Text")), "text"]
    assert order(r.page_id for r in got.collect()) == [2, 2, 3, BIG, None]
    assert sum(r.text == page[3:].strip() for r in got.collect()) == 2
    assert html_blocks.extract(df.limit(0)).count() == 0


def test_packing(spark, docs):
    got = packing.pack(docs, window=16, shard=3).collect()
    assert {i for r in got for i in r.doc_ids} == {BIG, None, 7, BIG + 4}
    assert sum(r.used for r in got) == 7 + 7 + 7 + 7 + 40_000
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, sf, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    if name != "packing":
        assert got.columns == docs.columns and set(order(r.doc_id for r in got.collect())) <= set(ALL)
    assert got.count() > 0 and stage(spark, docs.limit(0), sf).count() == 0
