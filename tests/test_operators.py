import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrace.operators import analytics, edits, index, records, render, search, sessions


def steps_df(spark, rows):
    """(path, step_id, message[, calls, results]) with the columns that search needs."""
    full = [(r[0], r[1], "", "agent", r[2], None, r[3] if len(r) > 3 else None, r[4] if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(full, "path string, step_id int, timestamp string, source string, message string, reasoning_content string, tool_calls array<struct<tool_call_id:string,function_name:string,arguments_json:string>>, results array<struct<source_call_id:string,content:string>>")


def records_df(spark, rows):
    return spark.createDataFrame([(i, "claude", ts, msg, p, None, None, k, 1.0) for k, (i, ts, msg, p) in enumerate(rows)], "id string, agent string, timestamp string, first_msg string, path string, session_id string, source map<string,string>, disc_ord long, mtime double")


def test_grep_takes_the_first_step_and_the_first_message(spark):
    rec = records_df(spark, [("a", "2", "say Hello", "/a"), ("b", "3", "x", "/b"), ("c", "3", "x", "/c"), ("d", "1", "x", "/d")])
    step = steps_df(spark, [("/a", 5, "hello"), ("/b", 1, "no"), ("/b", 2, "x", [("i", "hello_tool", '{"q": "say hello"}')]), ("/b", 3, "hello"), ("/c", 1, "z", None, [("i", "HELLO there")]), ("/d", 1, "z", [("i", "hello", "{}")])])
    got = [(r.id, r.step_id, r.snippet) for r in search.grep(rec, step, "hello").collect()]
    assert got == [("b", 2, '{"q": "say hello"}'), ("c", 1, "HELLO there"), ("a", 1, "say Hello")]
    assert search.grep(rec, step, r" \| ").count() == 0
    # words of one alternative may stand in different texts of a step; the snippet is of the first text that holds any
    both = search.grep(rec, steps_df(spark, [("/d", 1, "left", None, [("i", "right")])]), "right left").collect()
    assert [(r.id, r.snippet) for r in both] == [("d", "left")]


def test_fast_and_lists(spark):
    rec = records_df(spark, [("cl-1", "2026-01-02T", "fix", "/a"), ("cl-2", "2026-01-01T", "other", "/b"), ("cl-3", "1700000000000", "fix", "/c"), ("cl-4", "2026-01-02T", "fix", "/d")])
    assert [r.id for r in search.fast(rec, r"FIX\|cl-2").collect()] == ["cl-1", "cl-4", "cl-2", "cl-3"]
    assert [r.id for r in search.list_records(rec, since="2026-01-02").collect()] == ["cl-1", "cl-4"]
    assert [r.id for r in search.list_records(rec, date="2026-01-01").collect()] == ["cl-2"]
    df = search.list_records(rec)
    assert [r.id for r in search.page(df, 2, 3).collect()] == ["cl-3"] and [r.id for r in search.page(df, -1, 3).collect()] == ["cl-3"]
    with pytest.raises(ValueError):
        search.page(df, 0, 3)
    with pytest.raises(ValueError):
        search.backend("none")


def test_jaccard(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "x int") for v in ([1, 2, 3, 3], [2, 3, 4]))
    assert search.jaccard(a, b).first().jaccard == 0.5
    assert search.jaccard(a.limit(0), b.limit(0)).first().jaccard == 1.0


TEXTS = ["unique_alpha_word here", "the unique_beta_word", "alpha unique word", "Café python3 python", "python python python x", "beta_alpha alpha_beta"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('index')}/i"
    rec = records_df(spark, [(f"r{i}", str(i), "", f"/{i}") for i in range(len(TEXTS))])
    step = steps_df(spark, [(f"/{i}", 1, t) for i, t in enumerate(TEXTS)] + [("/0", 2, " ")])
    assert index.build(rec, step, folder) == (6, 0) and index.build(rec, step, folder) == (0, 6)
    return folder, rec, step


@pytest.mark.parametrize("query,paths", [("unique_alpha_word", ["/0"]), (r"unique_alpha_word\|unique_beta_word", ["/0", "/1"]), ("alpha_beta", ["/5"]), ("cafe", ["/3"]), ("CAFÉ python", ["/3"]), ("python", ["/3", "/4"]), ("--", []), ("", []), ("python --", []), (r"--\|python3", ["/3"]), ("nowhere", [])])
def test_index_lookup(spark, built, query, paths):
    folder, _, step = built
    got = index.lookup(spark, folder, query).collect()
    assert sorted(r.path for r in got) == paths and [r["rank"] for r in got] == sorted(r["rank"] for r in got)
    docs = step.where("message <> ' '").select("path", index.tokens(F.col("message")).alias("toks"))
    clauses = [c for c in index.query_phrases(spark, query) if all(c)]
    scan = {r.path: r["rank"] for r in index.rank(docs, clauses).collect()}
    assert scan == pytest.approx({r.path: r["rank"] for r in got})


def test_index_rebuilds_what_changed(spark, built, tmp_path):
    _, rec, step = built
    folder = f"file://{tmp_path}/i"
    with pytest.raises(FileNotFoundError):
        index.lookup(spark, folder, "x")
    index.build(rec, step, folder)
    later = rec.withColumn("mtime", F.when(F.col("path") == "/0", 2.0).otherwise(F.col("mtime")))
    new = step.where("path <> '/0'").unionByName(steps_df(spark, [("/0", 1, "fresh words")]))
    assert index.build(later, new, folder) == (1, 5)
    assert [r.path for r in index.lookup(spark, folder, "fresh").collect()] == ["/0"] and index.lookup(spark, folder, "unique_alpha_word").count() == 0
    assert index.build(later, new, folder, force=True) == (6, 0)
    assert [r.path for r in index.lookup(spark, folder, "fresh").collect()] == ["/0"]
    zero = later.withColumn("mtime", F.lit(0.0))
    assert index.build(zero, new, folder) == (6, 0) and index.build(zero, new, folder) == (6, 0)


def bm25(docs, clauses):
    import math

    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    out = {}
    for i, d in enumerate(docs):
        s, hit = 0.0, False
        for c in clauses:
            if all(d.count(w) for w in c):
                hit = True
                for w in c:
                    df = sum(1 for x in docs if w in x)
                    idf = math.log((n - df + 0.5) / (df + 0.5))
                    s += (idf if idf > 0 else 1e-6) * d.count(w) * 2.2 / (d.count(w) + 1.2 * (0.25 + 0.75 * len(d) / avg))
        if hit:
            out[i] = -s
    return out


def test_ranks_are_bm25_of_alternatives_that_hold(spark):
    import random

    rng = random.Random(3)
    docs = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))] for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, toks array<string>")
    got = {r.i: r["rank"] for r in index.rank(df, [[["a"], ["b"]], [["h"]]]).collect()}
    assert got == pytest.approx(bm25(docs, [["a", "b"], ["h"]]), abs=1e-9)


def test_candidates_are_the_best_sessions(spark, tmp_path):
    import random

    rng = random.Random(4)
    docs = [[rng.choice(("needle", "pin", *"abcdefg")) for _ in range(rng.randint(3, 60))] for _ in range(320)]
    rec = records_df(spark, [(f"r{i}", str(i), "", f"/{i:03}") for i in range(len(docs))])
    step = steps_df(spark, [(f"/{i:03}", 1, " ".join(d)) for i, d in enumerate(docs)] + [(f"/{i:03}", 2, "pin") for i in range(0, 320, 2)])
    folder = f"file://{tmp_path}/i"
    index.build(rec, step, folder, buckets=5, parts=2)
    rows = docs + [["pin"]] * 160
    ranks = {}
    for row, r in bm25(rows, [["needle"], ["pin", "a"]]).items():
        path = row if row < 320 else (row - 320) * 2
        ranks[path] = min(ranks.get(path, 0), r)
    assert len(ranks) > 250
    query = r"needle\|pin a"
    hits = index.lookup(spark, folder, query, snippets=False)
    want = [f"/{i:03}" for i in sorted(ranks, key=lambda i: (round(ranks[i], 9), i))]
    for limit in (5, 200):
        assert [r.path for r in index.best(hits, limit).collect()] == want[:limit]
        assert sorted(r.path for r in index.capped(hits, rec, step, query, limit).collect()) == sorted(want[:limit])
    assert [r.path for r in index.lookup(spark, folder, query, limit=7).collect()] == [r.path for r in index.lookup(spark, folder, query).collect()][:7]


@pytest.mark.parametrize("name,args,want", [
    ("Write", {"file_path": "/a", "content": "x\ny"}, [("/a", "write", 2, 0, 3, 0)]),
    ("create_file", {"path": "/a", "file_text": ""}, [("/a", "write", 0, 0, 0, 0)]),
    ("edit", {"path": "/a", "old_str": "ab", "new_str": "c\n"}, [("/a", "edit", 1, 1, 2, 2)]),
    ("MultiEdit", {"file_path": "/a", "edits": [{"old_string": "a", "new_string": "b\nc"}, {"new_str": "d"}]}, [("/a", "edit", 3, 1, 4, 1)]),
    ("multi_edit", {"file_path": "/a", "edits": []}, []),
    ("str_replace_editor", {"path": "/a", "command": "create", "file_text": "q"}, [("/a", "write", 1, 0, 1, 0)]),
    ("str_replace_editor", {"path": "/a", "command": "str_replace", "old_str": "q", "new_str": ""}, [("/a", "edit", 0, 1, 0, 1)]),
    ("str_replace_tool", {"path": "/a", "command": "insert", "new_str": "q", "old_str": "z"}, [("/a", "edit", 1, 0, 1, 0)]),
    ("str_replace_tool", {"path": "/a", "command": "view"}, []),
    ("apply_patch", {"input": "*** Add File: x\n+a"}, []),
    ("write", {"content": "x"}, []),
    ("write", [1], []),
    ("Bash", {"file_path": "/a", "content": "x"}, []),
])
def test_edits_of_calls(name, args, want):
    assert edits.call_edits(name, json.dumps(args)) == want


MARKED = "*** Begin Patch\n*** Update File: a.py\n-old\n+new\n+++ no\n--- no\n*** Add File: b.py\n+x\n+yy\n*** Delete File: c.py\n*** End Patch"
UNIFIED = "diff --git a/x b/x\n--- a/x\n+++ b/x\n-one\n+two\n+three\ndiff --git a/n b/n\n--- /dev/null\n+++ b/n\n+new\ndiff --git a/z b/z\n--- a/z\n+++ /dev/null\n-gone\ndiff --git a/e b/e\n--- a/e\n+++ b/e"


@pytest.mark.parametrize("patch,want", [
    (MARKED, [("a.py", "edit", 1, 1, 3, 3), ("b.py", "write", 2, 0, 3, 0), ("c.py", "delete", 0, 0, 0, 0)]),
    (UNIFIED, [("x", "edit", 2, 1, 8, 3), ("n", "write", 1, 0, 3, 0), ("z", "edit", 0, 1, 0, 4)]),
    ("--- a/p\n+++ b/p\n-1\n--- a/q\t2020\n+++ b/q\n+22", [("q", "edit", 1, 0, 2, 0)]),
    ("--- a/p\n+++ b/p\n-- sql\n+x", [("p", "edit", 1, 1, 1, 5)]),
    ("*** Begin Patch\nnothing", []),
    ("", []),
])
def test_patches(patch, want):
    assert edits.patch_edits(patch) == want


def test_blame(spark):
    rec = records_df(spark, [("late", "2", "m" * 70, "/l"), ("early", "1", "m", "/e")])
    write = lambda p, t: [("i", "Write", json.dumps({"file_path": p, "content": t}))]
    step = steps_df(spark, [("/l", 1, "", write("/src/f.py", "a\nb")), ("/e", 2, "", write("src/f.py", "abc") + write("/other", "x")), ("/e", 1, "", [("i", "edit", json.dumps({"path": "f.py", "old_str": " ", "new_str": ""}))])])
    step = step.unionByName(step.where("path = '/l'").withColumn("source", F.lit("user")))
    got = edits.blame(rec, step, "/src/f.py").collect()
    assert [(r.id, r.op, r.delta, r.timestamp) for r in got] == [("early", "edit", "-1 lines", "1"), ("early", "write", "+1 lines", "1"), ("late", "write", "+2 lines", "2")]
    assert len(got[2].first_msg) == 60
    d = spark.createDataFrame([(0, 0, 3, 0), (0, 0, 0, 0), (1, 2, 0, 0)], "lines_added long, lines_removed long, chars_added long, chars_removed long")
    assert [r[0] for r in d.select(edits.delta()).collect()] == ["+3 chars", "~", "+1/-2 lines"]


def test_programs_and_stats(spark):
    call = lambda n, **a: ("i", n, json.dumps(a))
    step = steps_df(spark, [("/a", 1, "", [call("Bash", command="python script.py"), call("shell", cmd="A=1 /usr/bin/make test"), call("Read", command="no")]), ("/a", 2, "", [call("bash", command="", input="git status"), call("bash", command="python -m x"), call("bash", other=1)])])
    assert [(r["program"], r["count"]) for r in analytics.session_programs(step).collect()] == [("python", 2), ("git", 1), ("make", 1)]
    rec = records_df(spark, [("a", "", "", "/a"), ("b", "", "", "/b")])
    traj = sessions.parse(sessions.lines_of(spark, [("/a", json.dumps({"type": "user", "message": {"content": "abcd"}}))]), "claude")[1]
    r = analytics.stats(rec, traj).first()
    assert (r.total_trajectories, r.parsed_trajectories, r.unparsed_trajectories, r.agents, r.total_steps, r.total_tokens) == (2, 1, 1, {"claude": 2}, 1, 1)
    assert analytics.stats(rec.limit(0), traj).first().total_trajectories == 0


def test_snapshots(spark):
    df = lambda rows: spark.createDataFrame(rows, "key string, mtime double")
    before = df([("/a/x.jsonl", 1.0), ("/a/y.jsonl", 2.0)])
    pick = lambda kind, after: analytics.pick(kind, before, df(after)).first().picked
    assert pick("claude_project_jsonl", [("/a/x.jsonl", 1.5), ("/a/y.jsonl", 2.0)]) == "x"
    assert pick("claude_project_jsonl", [("/a/x.jsonl", 1.0), ("/a/y.jsonl", 2.0)]) == "y"
    assert pick("claude_project_jsonl", []) is None
    assert pick("codex_rollout_jsonl", [("/a/x.jsonl", 0.5)]) == "/a/x.jsonl" and pick("codex_rollout_jsonl", [("/a/x.jsonl", 1.0)]) is None
    assert pick("copilot_sqlite", [("/a/x.jsonl", 9.0), ("new", 3.0)]) == "new" and pick("copilot_sqlite", [("/a/x.jsonl", 9.0)]) == "/a/x.jsonl"


def test_openings(spark):
    rows = [{"type": "x", "timestamp": ""}, {"type": "user", "isMeta": True, "promptId": "p", "timestamp": "t1", "message": {"content": "meta"}}, {"type": "user", "promptId": "p", "message": {"content": "of meta"}}, {"type": "user", "cwd": "/w", "message": {"content": [{"type": "text", "text": "real"}, {"type": "text", "text": "one"}]}}, {"type": "user", "timestamp": "t9", "message": {"content": "later"}}]
    body = "\n".join(map(json.dumps, rows))
    ev = sessions.events(sessions.lines_of(spark, [("/a", body), ("/b", "\n" * 31 + json.dumps({"type": "user", "cwd": "/late", "message": {"content": "x"}, "timestamp": "t"}))]), "claude")
    got = {r.path: r for r in records.openings(ev, "claude").collect()}
    assert (got["/a"].ts, got["/a"].first_msg, got["/a"].cwd) == ("t1", "real one", "/w")
    assert (got["/b"].first_msg, got["/b"].cwd) == ("x", "")
    probe = sessions.events(sessions.lines_of(spark, [("/p", json.dumps({"type": "session_start", "ts": "t0"}) + "\n" + json.dumps({"type": "user", "message": {"content": "hey"}, "timestamp": "t1"}))]), "agent_probe")
    r = records.openings(probe, "agent_probe").first()
    assert (r.ts, r.first_msg) == ("t1", "hey")


def test_rendering(spark):
    step = {"step_id": 2, "source": "agent", "timestamp": "2026-01-01T00:00:00.123Z", "message": "done <b>", "tool_calls": [{"function_name": "f", "arguments_json": json.dumps({"k": "é" * 900})}], "results": [{"content": "x" * 1001}, {"content": ""}]}
    md = render.step_markdown(step)
    assert "## Step 2 — AGENT *2026-01-01T00:00:00*" in md and "x" * 1000 + "\n…" in md and "*empty output*" in md and "\\u00e9" in md
    assert "x" * 1001 in render.step_markdown(step, full=True)
    page = render.step_html(step)
    assert "done &lt;b&gt;" in page and page.count("result</summary>") == 2
    assert render.ansi_to_html("\x1b[1;31mA<\x1b[0mB\x1b[32mC") == '<span style="font-weight:bold"><span style="color:#c0392b">A&lt;</span></span>B<span style="color:#27ae60">C</span>'
    hidden = render.step_html({**step, "tool_calls": [{"function_name": "create_tool", "arguments_json": '{"source_code": "print()", "n": 1}'}], "results": []})
    assert "<summary>source_code" in hidden and "print()" in hidden
    assert render.pages(["a", "b", "c"], -1, 2, "H", "steps", "F").splitlines()[0] == "<!-- page 2/2 | steps 3–3 of 3 -->"
    with pytest.raises(ValueError, match="out of range"):
        render.pages([], 2, 2, "", "steps")


def test_lines_of_queries_are_those_of_their_sql(spark, tmp_path):
    import __spark_entry__
    import duckdb

    texts = ["a\n", "", "\n", "a\rb", "a\r\nb\n", "x\u2028y\x0bz\x85", "++a\n+b", "one\ntwo"]
    spark.createDataFrame([(i, t, "en", "src3") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("line_counts", "blame_write", "blame_edit", "blame_multi", "blame_replace", "blame_patch", "blame_unified", "blame_file"):
        got = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name


def test_postings_are_made_a_few_texts_at_a_time(monkeypatch):
    toks = [["b", "a", "b"], [], ["c"] * 9, None, ["a", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(list("vwxyz")), pa.array([1] * 5, pa.int32()), pa.array(toks, pa.list_(pa.string()))], ["path", "step_id", "toks"])
    assert index._slices(np.array([3, 0, 9, 0, 2]), 4) == [(0, 2), (2, 3), (3, 5)]
    assert index._slices(np.array([], int)) == []
    rows = lambda made: sorted((r["path"], r["term"], r["n"], r["tf"], r["positions"]) for b in made for r in b.to_pylist())
    assert rows(index._postings([batch])) == sorted((p, t, len(ts), ts.count(t), [i for i, x in enumerate(ts) if x == t]) for p, ts in zip("vwxyz", toks) if ts for t in set(ts))
    monkeypatch.setattr(index, "_slices", lambda size: [(0, 2), (2, 5)])
    assert len(list(index._postings([batch]))) == 2


def test_postings_are_shuffled_as_packed_blocks(spark):
    toks = [[f"w{i * k % 97}" for k in range(60)] for i in range(50)] + [[]]
    df = spark.createDataFrame([(str(i), 1, ts) for i, ts in enumerate(toks)], "path string, step_id int, toks array<string>").coalesce(1)
    df = df.withColumn("buckets", F.transform("toks", lambda t: index._bucket(t, 3)))
    packed = df.mapInArrow(index._packed(2), "bucket int, part int, block binary")
    assert sorted(r.bucket for r in packed.collect()) == [0, 1, 2]  # a row for each bucket, not for each word of each text
    got = packed.select("bucket", "block").mapInArrow(index._unpacked, "term string, path string, step_id int, n int, tf int, positions array<int>, bucket int")
    assert got.where(F.col("bucket") != index._bucket(F.col("term"), 3)).isEmpty()
    want = {(p, t): [k for k, x in enumerate(ts) if x == t] for p, ts in enumerate(toks) for t in set(ts)}
    rows = got.collect()
    assert len(rows) == len(want) and {(int(r.path), r.term): r.positions for r in rows} == want
    assert all(r.n == 60 and r.tf == len(r.positions) for r in rows)
