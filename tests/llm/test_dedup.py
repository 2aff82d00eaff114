import random

import numpy as np
import pytest

from loomtrace.llm import common, embedding_dedup, exact_dedup, line_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _digest string, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edited(rng, text, rate):
    return " ".join(words(rng, 1) if rng.random() < rate else w for w in text.split())


def docs(spark, rows):
    """Rows of (doc_id, text) with the other columns of documents and two with names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "mine", "k") for i, t in rows], DOCS)


def odd(rng):
    long = words(rng, 30_000)
    return [(5, "twice"), (3, "twice"), (None, "twice"), (1, None), (2, None), (7, ""), (6, ""), (9, " \n "), (8, long), (10, long), (11, "twice"), (11, "twice"), (None, None), (12, "ünï 漢字 \U0001f600")]


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is None, x))


def least(rows):
    out = {}
    for i, t in rows:
        if t not in out or (i is None, i) < (out[t] is None, out[t]):
            out[t] = i
    return sorted(out.values(), key=lambda x: (x is None, x))


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_exact_dedup_of_odd_rows(spark, k):
    rng = random.Random(1)
    rows = odd(rng) + [(100 + i, f"hot {i % 3}") for i in range(90)]
    got = exact_dedup.exact_dedup(docs(spark, rows).repartition(5), k=k)
    assert got.columns == docs(spark, []).columns
    assert ids(got) == least(rows)
    assert {r._digest for r in got.collect()} == {"mine"}


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_misra_gries_holds_every_frequent_value():
    rng = random.Random(2)
    values = [rng.choice([1] * 30 + [2] * 20 + list(range(3, 60))) for _ in range(5000)]
    counts = {}
    for s in range(0, 5000, 700):
        part = {}
        for v in values[s : s + 700]:
            part[v] = part.get(v, 0) + 1
        counts = exact_dedup.merged(counts, part, 9)
    assert len(counts) <= 9
    for v in set(values):
        true = values.count(v)
        assert true - 5000 / 10 <= counts.get(v, 0) <= true
        if true > 500:
            assert v in counts


def test_frequent_is_found_and_bounded(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(600)]
    keyed = docs(spark, rows).select(exact_dedup.digest(common.col("text")).alias("digest"))
    got = exact_dedup.frequent(keyed, 5).collect()
    hot = keyed.where("digest = unhex(sha2('hot', 256))").first().digest
    assert hot in {r.digest for r in got} and len(got) <= 5


def brute_groups(sigs, k):
    """Least index of each group, by comparing all pairs."""
    words = np.array([np.frombuffer(x, np.uint64) for x in sigs])
    root = np.arange(len(sigs))
    while True:
        near = np.bitwise_count(words[:, None] ^ words[None, :]).sum(axis=2) <= k
        new = np.array([root[near[i]].min() for i in range(len(sigs))])
        if (new == root).all():
            return root.tolist()
        root = new


def edited_texts(rng, n, copies):
    base = [words(rng, rng.randint(40, 200)) for _ in range(n)]
    return base + [edited(rng, rng.choice(base), rng.choice((0.0, 0.01, 0.03, 0.05))) for _ in range(copies)]


@pytest.mark.parametrize("k", [3, 7, 15, 21])
def test_simhash_dedup_against_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(1000 - i, t) for i, t in enumerate(edited_texts(rng, 40, 200))]
    got = ids(simhash.simhash_dedup(docs(spark, rows), k=k))
    order = sorted(rows)
    groups = brute_groups(simhash.signatures([t for _, t in order]), k)
    assert got == sorted(order[g][0] for g in set(groups))
    if k == simhash.DISTANCE:  # copies go, originals stay
        assert 38 <= len(got) <= 45


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_buckets_cut_into_blocks_find_the_same_groups(spark, block):
    rng = random.Random(11)
    sigs = sorted({s for s in simhash.signatures(edited_texts(rng, 6, 150))})
    df = spark.createDataFrame([tuple(np.frombuffer(s, np.int64).tolist()) for s in sigs], "w0 long, w1 long")
    for part in (1, 4):
        found = common.components(simhash.near_edges(df, 21, block, part)).collect()
        comp = {r.node: r.comp for r in found}
        groups = brute_groups(sigs, 21)
        assert {tuple(sorted(i for i, s in enumerate(sigs) if comp.get(s, s) == x)) for x in {comp.get(s, s) for s in sigs}} == {tuple(i for i, g in enumerate(groups) if g == x) for x in set(groups)}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 15, 21, 30, 63])
def test_signatures_within_the_distance_share_a_variant(k):
    rng = random.Random(k)
    cut = simhash.segments(k)
    assert sum(w for _, w in cut) == simhash.BITS and 2 * len(cut) - 1 >= k and (len(cut) == 1 or 2 * len(cut) - 3 < k)
    for _ in range(300):
        flips = sum(1 << i for i in rng.sample(range(simhash.BITS), k))
        assert any(((flips >> first) & ((1 << wide) - 1)).bit_count() <= 1 for first, wide in cut)


@pytest.mark.parametrize("k", [0, 1, 3, 7, 8, 15, 21, 30])
def test_signatures_within_the_distance_meet_in_a_segment(k):
    rng = random.Random(k)
    steps = [(first, wide, set(masks)) for first, wide, masks in simhash.plan(k)]
    for _ in range(300):
        flips = sum(1 << i for i in rng.sample(range(simhash.BITS), k))
        assert any((flips >> first) & ((1 << wide) - 1) in masks for first, wide, masks in steps)


def flipped(rng, sigs, most):
    """Each signature with ``most`` bits changed at most."""
    out = sigs.copy()
    for row in out:
        for bit in rng.choice(128, most, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return out


@pytest.mark.parametrize("sides", [1, 2])
def test_few_of_all_pairs_of_signatures_are_compared(monkeypatch, sides):
    rng = np.random.default_rng(sides)
    n = 24_000
    sigs = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    sigs[n // 2 : n // 2 + 600] = flipped(rng, sigs[:600], 21)
    sigs[n // 2 + 600 : n // 2 + 1200] = flipped(rng, sigs[600:1200], 22)
    compared, listed, dense = [], simhash._meet, simhash.within
    monkeypatch.setattr(simhash, "_meet", lambda x, y, at, count, k: (compared.append(int(count.sum())), listed(x, y, at, count, k))[1])
    monkeypatch.setattr(simhash, "within", lambda x, y, k: (compared.append(len(x) * len(y)), dense(x, y, k))[1])
    label = simhash._join(sigs, n // sides, 21)
    assert sorted(np.flatnonzero(label != np.arange(n))) == list(range(n // 2, n // 2 + 600))
    assert (label[n // 2 : n // 2 + 600] == np.arange(600)).all()
    assert sum(compared) < 0.01 * n * n  # one-wildcard variants of 11 segments compared 0.08


@pytest.mark.parametrize("sides", [1, 2])
def test_many_near_copies_are_linked_without_comparing_all(monkeypatch, sides):
    rng = np.random.default_rng(sides)
    n = 30_000
    sigs = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
    near = rng.permutation(n)[: n // 2]
    sigs[near] = flipped(rng, np.repeat(sigs[near[:1]], len(near), axis=0), 4)
    compared, dense = [], simhash.within
    monkeypatch.setattr(simhash, "within", lambda x, y, k: (compared.append(len(x) * len(y)), dense(x, y, k))[1])
    label = simhash._join(sigs, n // sides, 21)
    assert set(label[near]) == {near.min()} and len(set(label.tolist())) == n - len(near) + 1
    assert sum(compared) < 0.5 * len(near) ** 2


def test_groups_across_tiles_are_those_of_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, (900, 2), dtype=np.uint64)
    sigs = np.unique(np.concatenate((base, flipped(rng, base[:300], 12), flipped(rng, base[:300], 21))), axis=0)
    df = spark.createDataFrame(sigs.view(np.int64).tolist(), "w0 long, w1 long")
    names = [s.tobytes() for s in sigs]
    groups = brute_groups(names, 21)
    for tile, least in ((10_000, 1), (400, 1), (100, 3)):
        comp = {r.node: r.comp for r in common.components(simhash.near_edges(df, 21, tile, least)).collect()}
        got = {}
        for i, s in enumerate(names):
            got.setdefault(bytes(comp.get(s, s)), []).append(i)
        want = {}
        for i, g in enumerate(groups):
            want.setdefault(g, []).append(i)
        assert sorted(got.values()) == sorted(want.values())


def test_simhash_dedup_of_odd_rows(spark):
    rng = random.Random(4)
    rows = odd(rng)
    got = ids(simhash.simhash_dedup(docs(spark, rows)))
    blank = [i for i, t in rows if not (t or "").strip()]
    rest = least([(i, t) for i, t in rows if (t or "").strip()])
    assert got == sorted(blank + rest, key=lambda x: (x is None, x))
    assert simhash.simhash_dedup(docs(spark, [])).count() == 0


def test_signatures_do_not_depend_on_the_batch():
    rng = random.Random(5)
    texts = [words(rng, rng.randint(1, 300)) for _ in range(50)] + ["", None, "...", "Ab aB AB", "ab ab ab", "a b c"]
    whole = simhash.signatures(texts)
    assert whole == [simhash.signatures([t])[0] for t in texts]
    assert whole[50:53] == [None, None, None]
    assert whole[53] == whole[54] and whole[55] is not None


def test_linked_rows_of_a_matrix_are_its_components():
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, (3, 2), dtype=np.uint64)
    sigs = np.repeat(centre, 60, axis=0)
    for row in sigs:
        for bit in rng.choice(128, 6, replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = simhash.within(sigs, sigs, 10)
    assert (near == (np.bitwise_count(sigs[:, None] ^ sigs[None, :]).sum(axis=2) <= 10)).all()
    groups = len(set(brute_groups([s.tobytes() for s in sigs], 10)))
    whole = np.arange(len(sigs))
    i, j = simhash.linked(near, whole, whole)
    assert len(sigs) - len(common.stars(i, j)[0]) == groups
    p, q = whole[:70], whole[70:]  # across two blocks, with all pairs near or few of them
    for k in (8, 10, 60):
        i, j = simhash.linked(simhash.within(sigs[p], sigs[q], k), p, q)
        rows, columns = np.nonzero(simhash.within(sigs[p], sigs[q], k))
        want = common.stars(p[rows], q[columns])
        assert sorted(zip(*(v.tolist() for v in common.stars(i, j)))) == sorted(zip(*(v.tolist() for v in want)))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)] + [(300, 301)] * 3
    rng.shuffle(edges)
    for few in (1_000_000, 0):  # by one task, and by alternating stars
        got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7), few).collect()}
        assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, run):
    """Removed line numbers of each row, window by window in the order of ids."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    seen, gone = set(), {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        real = [j for j, x in enumerate(lines) if x.strip(" \t\r")]
        gone[i] = set()
        for s in range(len(real) - run + 1):
            win = tuple(lines[j].strip(" \t\r") for j in real[s : s + run])
            if win in seen:
                gone[i] |= set(real[s : s + run])
            seen.add(win)
    return ["\n".join(x for j, x in enumerate((t or "").split("\n")) if j not in gone[i]) if t is not None else None for i, (_, t) in enumerate(rows)], [len(gone[i]) for i in range(len(rows))]


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_line_dedup_against_brute_force(spark, run):
    rng = random.Random(run)
    pool = [words(rng, 3) for _ in range(12)] + ["", " ", "x"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", " ", "\t", "\r")) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    rows += [(61, None), (62, ""), (63, "\n\n"), (64, "\n".join(["same"] * 40)), (65, "\n".join(f"line {i}" for i in range(20_000)))]
    rng.shuffle(rows)
    text, n = brute_lines(rows, run)
    got = {r.doc_id: (r.text, r.n) for r in line_dedup.line_dedup(docs(spark, rows), run, removed="n").collect()}
    assert got == {i: (t, k) for (i, _), t, k in zip(rows, text, n)}


def brute_passages(rows, run, least):
    """As brute_lines, with every window of up to ``run`` lines that has that many lines or ``least`` words."""
    seen, gone = set(), {}
    for i, (_, t) in sorted(enumerate(rows), key=lambda x: x[1][0]):
        lines = (t or "").split("\n")
        real = [j for j, x in enumerate(lines) if x.strip(" \t\r")]
        gone[i] = set()
        for s in range(len(real)):
            for n in range(1, min(run, len(real) - s) + 1):
                win = tuple(lines[j].strip(" \t\r") for j in real[s : s + n])
                if n < run and sum(len(x.split()) for x in win) < least:
                    continue
                if win in seen:
                    gone[i] |= set(real[s : s + n])
                seen.add(win)
    return {r[0]: ("\n".join(x for j, x in enumerate(r[1].split("\n")) if j not in gone[i]) if r[1] is not None else None, len(gone[i])) for i, r in enumerate(rows)}


@pytest.mark.parametrize("run, least", [(3, 8), (2, 5), (5, 12), (1, 4)])
def test_line_dedup_of_short_runs_against_brute_force(spark, run, least):
    rng = random.Random(run)
    pool = [words(rng, rng.choice((1, 2, 3, 5, 9))) for _ in range(60)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(("", " ", "\t", "\r")) for _ in range(rng.choice((1, 2, 3, 12))))) for i in range(80)]
    rows += [(81, None), (82, ""), (83, "\n".join(["same"] * 30))]
    rng.shuffle(rows)
    got = {r.doc_id: (r.text, r.n) for r in line_dedup.line_dedup(docs(spark, rows), run, removed="n", words=least).collect()}
    assert got == brute_passages(rows, run, least)


def test_passages_of_one_and_two_lines_go_and_short_lines_stay(spark):
    one, two = words(random.Random(1), 60), words(random.Random(2), 5) + "\n" + words(random.Random(3), 5)
    rows = [(1, one), (2, one), (3, f"{two}\nown"), (4, f"other\n{two}"), (5, "yes"), (6, "yes")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, rows), words=line_dedup.WORDS).collect()}
    assert got == {1: one, 2: "", 3: f"{two}\nown", 4: "other", 5: "yes", 6: "yes"}


def test_line_dedup_of_repeated_rows_and_nothing(spark):
    text = "a\nb\nc\nd"
    rows = [(None, text), (4, text), (4, text), (9, "z\n" + text + "\ny")]
    got = line_dedup.line_dedup(docs(spark, rows))
    assert got.columns == docs(spark, []).columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(4, text), (4, text), (9, "z\ny"), (None, "")], key=repr)
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_winnowing_picks_a_minimum_of_each_window():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 9, 200)
    for run in (1, 2, 4):
        picks = line_dedup.winnow(h, run)
        assert len(picks) == 200 - run + 1
        for s, p in enumerate(picks):
            assert s <= p < s + run and h[p] == h[s : s + run].min() and (h[p + 1 : s + run] > h[p]).all()


VECS = "vec_id long, embedding array<float>, label int, node string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "n", "r") for i, v in rows], VECS)


@pytest.mark.parametrize("tile", [10, 40, 4096])
def test_embedding_dedup_against_brute_force(spark, tile):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 16))
    x = np.concatenate((base, base[rng.integers(0, 60, 80)] + rng.normal(scale=0.1, size=(80, 16)), base[:5] * 3)).astype(np.float32)
    rows = [(500 - i, v) for i, v in enumerate(x)]
    got = sorted(r.vec_id for r in embedding_dedup.embedding_dedup(vectors(spark, rows), tile=tile).collect())
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= embedding_dedup.THRESHOLD
    comp = np.arange(len(u))
    for _ in range(len(u)):
        new = np.array([comp[near[i]].max() for i in range(len(u))])  # the greatest index has the least id
        if (new == comp).all():
            break
        comp = new
    assert got == sorted(500 - i for i in set(comp.tolist()))


def test_embedding_dedup_of_odd_rows(spark):
    rows = [(3, [1, 0, 0]), (1, [2, 0, 0]), (None, [1, 0, 0]), (1, [2, 0, 0]), (4, None), (5, []), (6, [0, 0, 0]), (7, [1, None, 0]), (8, [1, 0]), (9, [float("nan"), 1, 0]), (10, [0, 1, 0]), (11, [0, 0, 0])]
    got = embedding_dedup.embedding_dedup(vectors(spark, rows))
    assert got.columns == vectors(spark, []).columns
    assert sorted((r.vec_id for r in got.collect()), key=lambda x: (x is None, x)) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
    assert embedding_dedup.embedding_dedup(vectors(spark, [])).count() == 0
    assert embedding_dedup.embedding_dedup(vectors(spark, [(1, None)])).count() == 1


@pytest.mark.parametrize("tile", [30, 4096])
def test_a_tile_full_of_copies_and_thresholds_at_the_edge(spark, tile):
    rng = np.random.default_rng(12)
    one = rng.normal(size=24)
    x = np.concatenate((one + rng.normal(scale=1e-3, size=(150, 24)), rng.normal(size=(20, 24))))
    pairs = []  # cosines within float32's error of the threshold, on either side
    for i in range(40):
        u = rng.normal(size=24)
        u /= np.linalg.norm(u)
        v = rng.normal(size=24)
        v -= (v @ u) * u
        v /= np.linalg.norm(v)
        a = embedding_dedup.THRESHOLD + (i - 19.5) * 2e-9
        pairs += [u * 3, a * u + np.sqrt(1 - a * a) * v]
    rows = [(i, v) for i, v in enumerate(np.concatenate((x, np.array(pairs))))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r.vec_id for r in embedding_dedup.embedding_dedup(df, tile=tile).collect()}
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    cos = np.einsum("ij,kj->ik", u, u)
    near, comp = cos >= embedding_dedup.THRESHOLD, np.arange(len(u))
    for _ in range(10):
        comp = np.array([comp[near[i]].min() for i in range(len(u))])
    assert got == set(comp.tolist())
    assert 0 < sum(180 <= i for i in got) < 80


def test_near_pairs_drop_no_pair():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(150, 24)).astype(np.float32)
    x[75:] = x[:75] + rng.normal(scale=0.3, size=(75, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embedding_dedup.near_pairs(x, x, 0.9)
    full = x.astype(np.float64) @ x.T.astype(np.float64)
    want = {(a, b) for a, b in zip(*np.nonzero(full >= 0.9))}
    got = set(zip(i.tolist(), j.tolist()))
    assert want <= got and all(full[p] >= 0.9 - 2e-5 for p in got)
