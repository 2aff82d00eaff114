import hashlib
import itertools
import random

import pytest

from loomtrace.llm import mixing, packing, token_cache
from loomtrace.llm.queries import TREE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, epoch string, _tokens string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, "mine", "m") for i, t, lang, src in rows], DOCS)


def some(rng, n=200):
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "de", None]), rng.choice(["src0", "src0", "src0", "src1", "src7", "src12", "x", None])) for i in range(n)]


def fill(budget, children):
    """``budget`` shared by weight among (weight, capacity, key); what one cannot take goes to its siblings by their weights."""
    left = sorted((x for x in children if x[0] > 0), key=lambda x: (x[1] / x[0], str(x[2])))
    out, rest = {k: 0.0 for _, _, k in children}, budget
    for i, (w, cap, k) in enumerate(left):
        level = rest / sum(x[0] for x in left[i:])
        if cap <= level * w:
            out[k], rest = float(cap), rest - cap
        else:
            out |= {k2: level * w2 for w2, _, k2 in left[i:]}
            break
    return out


def by_recursion(leaves, total, tree=TREE, max_epochs=mixing.MAX_EPOCHS):
    out = {}

    def at(prefix, share):
        level, caps = mixing.LEVELS[len(prefix)], {}
        for path, n in leaves.items():
            if path[: len(prefix)] == prefix:
                caps[path[len(prefix)]] = caps.get(path[len(prefix)], 0) + n * max_epochs
        for k, v in fill(share, [(tree.weights.get(level, {}).get(k, tree.other.get(level, 1.0)), cap, k) for k, cap in caps.items()]).items():
            if len(prefix) + 1 == len(mixing.LEVELS):
                out[prefix + (k,)] = int(v + 1e-6)
            else:
                at(prefix + (k,), v)

    at((), total)
    return {k: out.get(k, 0) for k in leaves}


def budgets(spark, leaves, total, tree=TREE, max_epochs=mixing.MAX_EPOCHS):
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, n long")
    return {tuple(r)[:3]: r.budget for r in mixing.budgets(df, total, tree, max_epochs).collect()}


def test_siblings_share_by_weight_up_to_their_capacity(spark):
    flat = mixing.Tree(weights={"source": {"c": 2, "z": 0}})
    of = lambda **n: {("d", "en", k): v for k, v in n.items()}
    assert budgets(spark, of(a=1000, b=1000), 100, flat, 1) == of(a=50, b=50)
    assert budgets(spark, of(a=10, b=1000, c=1000), 100, flat, 1) == of(a=10, b=30, c=60)
    assert budgets(spark, of(a=10, b=20), 100, flat, 1) == of(a=10, b=20)
    assert budgets(spark, of(z=10, b=500), 100, flat, 1) == of(z=0, b=100)
    assert budgets(spark, {("d", "en", "a"): 5, ("d", "de", "z"): 9, ("e", "en", "z"): 9}, 20, flat, 4) == {("d", "en", "a"): 5, ("d", "de", "z"): 0, ("e", "en", "z"): 0}


def test_shortages_reach_siblings_before_ancestors(spark):
    leaves = {("web", "en", "src0"): 5, ("web", "en", "src1"): 1000, ("web", "de", "src0"): 1000, ("books", "en", "src10"): 1000}
    got = budgets(spark, leaves, 700, max_epochs=1)
    # web has 5/7 of 700, English 4/5 of that; src0 lacks 195, which src1 takes
    assert got == {("web", "en", "src0"): 5, ("web", "en", "src1"): 395, ("web", "de", "src0"): 100, ("books", "en", "src10"): 200}
    leaves[("web", "en", "src1")] = 100
    # English has 105 in all, so German takes the rest of web
    assert budgets(spark, leaves, 700, max_epochs=1) == {("web", "en", "src0"): 5, ("web", "en", "src1"): 100, ("web", "de", "src0"): 395, ("books", "en", "src10"): 200}


def test_budgets_of_many_leaves_against_recursion(spark):
    rng = random.Random(5)
    leaves = {(d, lang, f"s{i}"): rng.choice((0, 1, 7, rng.randint(0, 10_000))) for d in ("web", "forum", "books", "reference", "more") for lang in ("en", "de", "xx") for i in range(rng.choice((1, 5, 200)))}
    for ratio in (0.1, 0.9, 2.5):
        total = ratio * sum(leaves.values())
        assert budgets(spark, leaves, total) == by_recursion(leaves, total)


def test_budgets_of_a_hundred_thousand_leaves(spark):
    rng = random.Random(6)
    leaves = {(("web", "forum", "more")[i % 3], ("en", "de")[i % 2], f"s{i}"): rng.choice((0, rng.randint(0, 50), rng.randint(0, 1_000_000))) for i in range(100_000)}
    total = 0.8 * sum(leaves.values())
    assert budgets(spark, leaves, total) == by_recursion(leaves, total)


def brute(rows, ratio, max_epochs):
    leaf = lambda lang, src: (next((d for d, m in TREE.domains.items() if src in m), "reference"), lang or mixing.NONE, src or mixing.NONE)
    have = {}
    for i, t, lang, src in rows:
        have.setdefault(leaf(lang, src), []).append((i, t or ""))
    n = {k: sum(len(t.split()) for _, t in v) for k, v in have.items()}
    budget = by_recursion(n, ratio * sum(n.values()), max_epochs=max_epochs)
    out = []
    for k, members in have.items():
        full, room = (budget[k] // n[k], budget[k] % n[k]) if n[k] else (0, 0)
        for e in range(1, full + 1):
            out += [(i, e) for i, _ in members]
        if room:
            order = sorted((hashlib.md5(f"{mixing.SEED}:{full + 1}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, len(t.split())) for i, t in members)
            used = 0
            for _, same in itertools.groupby(order, key=lambda x: x[0]):  # rows equal in id and text are drawn together
                same = list(same)
                used += sum(size for _, _, size in same)
                if used > room:
                    break
                out += [(i, full + 1) for _, i, _ in same]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ratio,max_epochs", [(0.3, 1), (0.9, 4), (1.0, 4), (3.0, 2)])
def test_mix_against_brute_force(spark, ratio, max_epochs):
    rng = random.Random(1)
    rows = some(rng) + [(500, None, "en", "src0"), (501, "", "en", "src1"), (502, "long word " * 40_000, "de", "src1"), (3, "again", "en", "src7"), (3, "again", "en", "src7")]
    got = mixing.mix(docs(spark, rows), TREE, ratio, max_epochs=max_epochs, with_epoch=True)
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=repr) == brute(rows, ratio, max_epochs)
    same = mixing.mix(docs(spark, rows), TREE, ratio, max_epochs=max_epochs)
    assert same.columns == docs(spark, []).columns and same.count() == got.count()
    assert {r.epoch for r in same.collect()} == {"mine"}


def test_mix_without_language_and_source(spark):
    df = spark.createDataFrame([(i, "w " * (i + 1)) for i in range(20)], "doc_id long, text string")
    got = mixing.mix(df, TREE, 0.5, with_epoch=True).collect()
    want = brute([(i, "w " * (i + 1), None, None) for i in range(20)], 0.5, mixing.MAX_EPOCHS)
    assert sorted(((r.doc_id, r.epoch) for r in got), key=repr) == want


def test_mix_of_nothing(spark):
    assert mixing.mix(docs(spark, []), TREE).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None, None), (2, "", "en", "src0")]), TREE).count() == 0


def naive(pieces, window):
    room, out = [], []
    for length, number in sorted(pieces, key=lambda p: (-p[0], p[1])):
        fits = [(r, -k) for k, r in enumerate(room) if r >= length]
        if fits:
            k = -min(fits)[1]
            room[k] -= length
            out[k].append(number)
        else:
            room.append(window - length)
            out.append([number])
    return out, room


@pytest.mark.parametrize("window", [1, 2, 7, 64, 100])
def test_best_fit_takes_the_tightest_window(window):
    rng = random.Random(window)
    for n in (0, 1, 5, 300):
        pieces = [(rng.randint(1, window), i) for i in range(n)]
        sizes = dict((i, s) for s, i in pieces)
        got = packing.best_fit(pieces, window)
        want, _ = naive(pieces, window)
        assert sorted(i for w in got for i in w) == list(range(n))
        fill = lambda ws: sorted(sum(sizes[i] for i in w) for w in ws)
        assert fill(got) == fill(want) and max(fill(got), default=0) <= window


def test_pack_covers_every_token_once(spark):
    rng = random.Random(2)
    rows = some(rng, 300) + [(None, "a b c", "en", "s"), (900, "w " * 5000, "en", "s"), (7, "x y", "en", "s"), (7, "x y", "en", "s"), (901, None, "en", "s"), (902, "", "en", "s"), (903, "w " * 64, "en", "s")]
    got = packing.pack(docs(spark, rows), window=64, shard=100).collect()
    assert len({r.window_id for r in got}) == len(got)
    seen = {}
    for r in got:
        assert r.used == sum(r.lengths) <= 64
        for i, s, n in zip(r.doc_ids, r.starts, r.lengths):
            seen.setdefault(i, []).append((s, n))
    for i in {r[0] for r in rows}:
        sizes = [len((t or "").split()) for j, t, *_ in rows if j == i]
        assert sum(n for _, n in seen.get(i, [])) == sum(sizes)
        if len(sizes) == 1 and sizes[0]:
            at = 0
            for s, n in sorted(seen[i]):
                assert s == at
                at += n
    assert packing.pack(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, [(1, None, None, None)])).count() == 0


def test_pack_keeps_large_ids_beside_a_null(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(None, "a b"), (big, "a b c"), (big + 2, "x")], "doc_id long, text string")
    assert {i for r in packing.pack(df, window=8).collect() for i in r.doc_ids} == {None, big, big + 2}
    named = spark.createDataFrame([("é", "a b"), (None, "c")], "doc_id string, text string")
    assert {i for r in packing.pack(named, window=8).collect() for i in r.doc_ids} == {None, "é"}


def test_pack_by_a_column_of_lengths(spark):
    df = spark.createDataFrame([(1, 5), (2, 3), (3, None), (4, -2), (5, 8)], "doc_id long, n long")
    got = packing.pack(df, window=8, tokens="n").collect()
    assert sorted(sorted(r.doc_ids) for r in got) == [[1, 2], [5]]


def test_token_counts_against_the_tokenizer(spark, tmp_path):
    import tiktoken  # noqa: F401

    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcdeé 漢") for _ in range(8)) for _ in range(20)) for _ in range(30)]
    texts = base + [base[0], " " + base[1] + "\r\n", None, "", " \n", "a\r\nb", "a\nb", "it's 2024 <|endoftext|>", "word " * 30_000]
    df = spark.createDataFrame([(i % 35, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, key string")
    cache = f"file://{tmp_path}/cache"
    got = token_cache.token_counts(df, cache)
    assert sorted(got.columns) == sorted(df.columns)
    enc = token_cache.encoder(open(token_cache.RANKS, "rb").read(), token_cache.PATTERN)
    normal = lambda t: t.replace("\r\n", "\n").strip(" \t\n")
    want = sorted(((i % 35, t, None if t is None else len(enc.encode_ordinary(normal(t)))) for i, t in enumerate(texts)), key=repr)
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in got.collect()), key=repr) == want
    stored = spark.read.parquet(cache)
    first = stored.count()
    assert first == len({normal(t) for t in texts if t is not None})
    # a second call finds all but the new text in the cache; a repeated append changes nothing
    more = df.unionByName(spark.createDataFrame([(99, "new text", 1, "k")], df.schema))
    assert {r.n_tokens for r in token_cache.token_counts(more, cache).where("doc_id = 99").collect()} == {2}
    assert spark.read.parquet(cache).count() == first + 1
    spark.read.parquet(cache).limit(5).write.mode("append").parquet(cache)
    assert token_cache.token_counts(more, cache).count() == len(texts) + 1
    # another tokenizer version has counts of its own
    token_cache.token_counts(df.limit(3), cache, pattern=r"\S+|\s+").count()
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_cache.token_counts(df.limit(0), f"file://{tmp_path}/none").count() == 0
