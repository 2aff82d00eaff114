import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomtrace import cli, ship
from loomtrace.plans.lake import Lake
from loomtrace.sources import config, files, sqlite
from loomtrace.streaming import ingest


def put(path, entries):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(e) for e in entries) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    h = tmp_path_factory.mktemp("home with space+é")
    put(h / ".claude/projects/-w-p/one.jsonl", [{"type": "user", "sessionId": "S1", "timestamp": "2026-01-02T00:00:00Z", "cwd": "/w/p", "message": {"content": "fix the bug"}}, {"type": "assistant", "message": {"model": "m", "content": [{"type": "tool_use", "id": "a", "name": "Write", "input": {"file_path": "/w/p/f.py", "content": "x = 1"}}, {"type": "tool_use", "id": "b", "name": "Bash", "input": {"command": "git status"}}]}}])
    put(h / ".claude/projects/-w-p/deep/two.jsonl", [{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hello"}}])
    rollout = put(h / ".codex/sessions/2026/rollout-1.jsonl", [{"type": "session_meta", "timestamp": "2026-01-03", "cwd": "/w/p/sub", "payload": {"id": "c"}}, {"type": "event_msg", "payload": {"type": "user_message", "message": "codex here"}}])
    put(h / ".codex/sessions/2026/other.jsonl", [{"type": "session_meta"}])
    put(h / ".copilot/session-state/x/events.jsonl", [{"type": "user.message", "timestamp": "2026-01-04", "data": {"content": "copilot here"}}])
    put(h / ".copilot/session-state/x/deeper/events.jsonl", [])
    put(h / ".local/share/agent_probe/a/b/s.jsonl", [{"type": "session_start", "cwd": "/w/p"}, {"type": "user", "ts": "2026-01-05", "content": "probe here"}])
    put(h / ".local/share/agent_probe/a/s.jsonl", [{"type": "user", "content": "not two levels"}])
    put(h / ".cursor/sessions/z.jsonl", [{}])
    put(h / "more/e.jsonl", [{"type": "session_meta", "payload": {}}, {"type": "event_msg", "timestamp": "2026-01-06", "payload": {"type": "user_message", "message": "extra"}}])
    put(h / "more/unknown.jsonl", [{"nothing": 1}])
    for where, sql in {
        ".codex/state_5.sqlite": f"CREATE TABLE threads(id TEXT, rollout_path TEXT, created_at_ms INTEGER, updated_at_ms INTEGER, model_provider TEXT, model TEXT, cwd TEXT, title TEXT, tokens_used INTEGER, first_user_message TEXT); INSERT INTO threads VALUES('t1','/gone/r.jsonl',900,1000,'o','gpt','/w/p','T',42,'thread one'); INSERT INTO threads VALUES('t2','{rollout}',900,2000,'o','gpt','/w/p','T',42,'known file'); INSERT INTO threads VALUES('t3',NULL,900,3000,'o','gpt','/elsewhere','T',42,NULL);",
        ".local/share/opencode/opencode.db": """CREATE TABLE session(id TEXT,time_created INTEGER,time_updated INTEGER,model TEXT,directory TEXT); INSERT INTO session VALUES('s1',1,5,'m','/w/p'); INSERT INTO session VALUES('s2',1,9,'m','/w/pp');
            CREATE TABLE message(id TEXT,session_id TEXT,time_created INTEGER,data TEXT); INSERT INTO message VALUES('m0','s1',1,'{"role":"assistant"}'); INSERT INTO message VALUES('m1','s1',2,'{"role":"user"}');
            CREATE TABLE part(id TEXT,message_id TEXT,time_created INTEGER,data TEXT); INSERT INTO part VALUES('p','m0',1,'{"text":"no"}'); INSERT INTO part VALUES('q','m1',1,'{"text":" open prompt "}');""",
        ".hermes/state.db": "CREATE TABLE sessions(id TEXT, model TEXT, cwd TEXT, started_at REAL, input_tokens INTEGER, output_tokens INTEGER); INSERT INTO sessions VALUES('h1','m','/w/p',1700000000.0,3,4); CREATE TABLE messages(id INTEGER, session_id TEXT, role TEXT, content TEXT, tool_calls TEXT, tool_name TEXT, tool_call_id TEXT, timestamp REAL, reasoning_content TEXT); INSERT INTO messages VALUES(1,'h1','user','hermes here',NULL,NULL,NULL,1.0,NULL);",
        ".copilot/session-store.db": "CREATE TABLE sessions(id TEXT, created_at TEXT, cwd TEXT, repository TEXT, branch TEXT, summary TEXT); INSERT INTO sessions VALUES('g1','2026-01-07','/c','r','b','s'); CREATE TABLE turns(session_id TEXT, turn_index INTEGER, user_message TEXT, assistant_response TEXT, timestamp TEXT); INSERT INTO turns VALUES('g1',0,'turn text','answer','t');",
    }.items():
        (h / where).parent.mkdir(parents=True, exist_ok=True)
        con = sqlite3.connect(h / where)
        con.executescript(sql)
        con.commit()
        con.close()
    return h


@pytest.fixture(scope="module")
def lake(spark, home):
    return Lake(spark, str(home), settings={"folders": [str(home / "more"), str(home / "missing")]})


def test_records_of_all_stores(lake, home):
    got = [(r.agent, r.first_msg, r.timestamp) for r in lake.records.orderBy("disc_ord").collect()]
    assert got == [
        ("claude", "hello", "2026-01-01T00:00:00Z"), ("claude", "fix the bug", "2026-01-02T00:00:00Z"), ("codex", "codex here", "2026-01-03"), ("copilot", "copilot here", "2026-01-04"), ("agent_probe", "probe here", "2026-01-05"),
        ("opencode", "", "9"), ("opencode", "open prompt", "5"), ("codex_db", "", "3000"), ("codex_db", "thread one", "1000"), ("hermes", "hermes here", "2023-11-14T22:13:20"), ("copilot_db", "", "2026-01-07"), ("codex", "extra", "2026-01-06"),
    ]
    import hashlib

    ids = {r.first_msg: r.id for r in lake.records.collect()}
    assert ids["fix the bug"] == "cl-" + hashlib.sha256(str(home / ".claude/projects/-w-p/one.jsonl").encode()).hexdigest()[:8]
    assert ids["extra"].startswith("co-") and ids["thread one"].startswith("cd-")


def test_records_of_a_folder(spark, home):
    scoped = Lake(spark, str(home), "/w/p", settings={"folders": str(home / "more")})
    assert {r.first_msg for r in scoped.records.collect()} == {"fix the bug", "codex here", "probe here", "open prompt", "thread one", "hermes here"}


def test_questions(lake, tmp_path):
    assert [r.first_msg for r in lake.search("here").collect()] == ["probe here", "copilot here", "codex here", "hermes here"]
    assert [r.step_id for r in lake.search("f.py").collect()] == [2]
    assert [(r.agent, r.step_id) for r in lake.search("turn").collect()] == [("copilot_db", 1)]
    assert [r.first_msg for r in lake.list(date="2026-01-02").collect()] == ["fix the bug"]
    assert [r.delta for r in lake.blame("/w/p/f.py").collect()] == ["+1 lines"]
    assert [(r["program"], r["count"]) for r in lake.programs().collect()] == [("git", 1)]
    r = lake.stats().first()
    assert (r.total_trajectories, r.parsed_trajectories, r.agents["opencode"]) == (12, 8, 2)
    assert lake.find("h1").first().agent == "hermes" and lake.find("one.jsonl").first().first_msg == "fix the bug" and lake.find("zzz").first() is None
    assert sorted(r.agent for r in lake.delete_candidates("HELLO").collect()) == ["claude"]
    folder = f"file://{tmp_path}/index"
    assert lake.refresh(folder) == (12, 0)
    done, passed = lake.refresh(folder)
    assert (done, passed) == (6, 6)  # stored sessions have no time and are read again
    assert [r.first_msg for r in lake.search("probe", "index", folder).collect()] == ["probe here"]
    assert [r.first_msg for r in lake.search("prob", "candidates", folder).collect()] == []
    assert [r.first_msg for r in lake.search("probe", "candidates", folder).collect()] == [""]
    step, traj = lake.materialise(f"file://{tmp_path}/parsed")
    again, _ = lake.materialise(f"file://{tmp_path}/parsed")
    assert step.count() == again.count() == lake.steps.count() and traj.count() == lake.trajectories.count()


def test_stores_and_configuration(spark, home, tmp_path, monkeypatch):
    assert [os.path.basename(p) for p, *_ in files.list_files(spark, str(home / ".cursor"), files.STORES["cursor"].globs)] == ["z.jsonl"]
    assert files.files(spark, str(home), "codex_all").count() == 2
    monkeypatch.setenv("PI_CODING_AGENT_DIR", str(tmp_path))
    put(tmp_path / "sessions/a/p.jsonl", [{}])
    assert files.files(spark, str(home), "pi").count() == 1
    assert config.parse("a: 1\n# x\nfolders:\n  - one\n\t- two # kept\n -no\nb:\n  - \nc\n") == {"a": "1", "folders": ["one", "two # kept"]}
    assert config.load(str(tmp_path / "none")) == {} and config.folders({"folders": "x"}) == ["x"] and config.folders({}) == []
    assert sqlite.table(spark, str(tmp_path / "none.db"), "t", "a string").count() == 0
    db = str(home / ".codex/state_5.sqlite")
    df = sqlite.table(spark, db, "threads", "id string, updated_at_ms long, absent string", 2)
    assert df.count() == 3 and [r.updated_at_ms for r in df.where("id = 't1'").collect()] == [1000] and df.where("absent is not null").count() == 0
    lines = files.lines(spark, [put(tmp_path / "s.jsonl", [{"type": "user", "message": {}}] + [{"type": "session_meta"}] * 40), put(tmp_path / "t.jsonl", [{"type": "user", "message": {}}, {"type": "session_meta"}])])
    assert {os.path.basename(r.path): r.fmt for r in files.sniff(lines).collect()} == {"s.jsonl": "codex", "t.jsonl": "claude"}


def test_many_files_are_few_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"{i:03}.jsonl").write_bytes(b"a\r\nb\rc\xff\n" if i else b"")
    found = [p for p, *_ in files.list_files(spark, str(tmp_path), ("*.jsonl",))]
    sc = spark.sparkContext
    sc.setJobGroup("few-tasks", "")
    got = files.lines(spark, found).collect()
    sc._jsc.clearJobGroup()
    tracker = sc.statusTracker()
    stages = [k for j in tracker.getJobIdsForGroup("few-tasks") for k in tracker.getJobInfo(j).stageIds]
    assert sum(tracker.getStageInfo(k).numTasks for k in stages) <= 16  # neither lists folders nor takes a task for a file or 32 of them
    assert len(got) == 199 * 4 + 1 and [(r.line_no, r.value) for r in sorted(got) if r.path == found[1]] == [(0, "a"), (1, "b"), (2, "c\ufffd"), (3, "")]


def test_lines_are_decoded_once(spark, tmp_path):
    where = put(tmp_path / ".claude/projects/-w/one.jsonl", [{"type": "user", "message": {"content": "hello"}}, {"type": "assistant", "message": {"model": "m", "content": [{"type": "text", "text": "well"}]}}])
    mine = Lake(spark, str(tmp_path), settings={})
    mine.records
    step, traj = mine.parse()
    os.remove(where)  # what makes steps and trajectories reads decoded events, not files
    assert sorted((r.step_id, r.message) for r in step.collect()) == [(1, "hello"), (2, "well")] and traj.first().n_steps == 2


def test_command_line(spark, home, capsys, monkeypatch):
    monkeypatch.setattr(config, "load", lambda path=None: {})

    def run(*argv):
        code = cli.main(["--home", str(home), *argv], spark)
        return code, capsys.readouterr()

    code, out = run("list", "--all", "--page-size", "4")
    assert code == 0 and "page 1/3 | trajectories 1–4 of 11" in out.out and "/elsewhere" in out.out
    code, out = run("list", "--all", "--page", "9")
    assert code == 1 and "out of range" in out.err
    code, out = run("search", "probe here")
    assert "| 1 | probe here |" in out.out
    code, out = run("search", "codex", "--fast")
    assert "codex here" in out.out
    code, out = run("show", "one.jsonl", "--step", "2", "--page-size", "1")
    assert "page 2/2" in out.out and "**Tool call:** `Write`" in out.out and "**Steps:** 2" in out.out
    assert run("show", "one.jsonl", "--step", "9")[0] == 1 and run("show", "nope")[0] == 1
    assert "<section" in run("show", "one.jsonl", "--html")[1].out
    assert json.loads(run("info", "one.jsonl")[1].out)["session_id"] == "S1"
    with pytest.raises(SystemExit):
        run("info", "nope")
    assert json.loads(capsys.readouterr().out) == {"error": "trajectory `nope` not found"}
    assert json.loads(run("stats", "--all")[1].out)["total_trajectories"] == 11
    assert json.loads(run("advanced", "tools", "--id", "one.jsonl", "--json")[1].out)["programs"] == [{"program": "git", "count": 1}]
    assert "No agent edits" in run("blame", "/nothing", "--all")[1].out


def test_command_line_scopes(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(config, "load", lambda path=None: {})
    place, other = tmp_path / "work", tmp_path / "other"
    place.mkdir()
    slug = lambda p: "".join(c if c.isalnum() and c.isascii() else "-" for c in str(p))
    for where, said in ((place, "inside here"), (other, "outside here")):
        put(tmp_path / ".claude/projects" / slug(where) / f"{said[:3]}.jsonl", [{"type": "user", "cwd": str(where), "message": {"content": said}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "b", "name": "Bash", "input": {"command": "git status"}}]}}])
    monkeypatch.chdir(place)

    def run(*argv):
        assert cli.main(["--home", str(tmp_path), *argv], spark) == 0
        return capsys.readouterr().out

    assert "inside" in (out := run("list")) and "outside" not in out
    assert "inside" in (out := run("list", "--all")) and "outside" in out
    assert "outside" in (out := run("list", "--dir", str(other))) and "inside" not in out
    assert "of 2 -->" in run("search", r"outside\|inside") and "of 1 -->" in run("search", "here", "--local")
    index = ["--index", str(tmp_path / "index")]
    assert "Nothing" in run("refresh", "--config-only", *index) and "Nothing" in run("refresh", "--no-recoll", "--no-sqlite", *index)
    assert "Indexed 2" in run("refresh", "--no-recoll", *index) and "Indexed 0 session(s), skipped 2" in run("refresh", *index)
    assert "of 2 -->" in run("search", "here", "--backend", "sqlite", *index) and "of 1 -->" in run("search", r"inside\|git rebase", "--backend", "recoll", *index)
    assert json.loads(run("advanced", "tools", "--dir", str(other), "--json"))["programs"] == [{"program": "git", "count": 1}]


def test_only_changed_sessions_are_read(spark, tmp_path, monkeypatch):
    paths = [put(tmp_path / f".claude/projects/p/{i}.jsonl", [{"type": "user", "message": {"content": f"number {i}"}}]) for i in range(4)]
    read = []
    real = files.lines
    monkeypatch.setattr(files, "lines", lambda spark, paths: read.extend(paths) or real(spark, paths))

    def lines_read(f):
        fresh = Lake(spark, str(tmp_path), settings={})
        fresh.records.count()  # first messages are read anew
        read.clear()
        out = f(fresh)
        return out, sorted(read)

    where, folder = f"file://{tmp_path}/parsed", f"file://{tmp_path}/index"
    (steps, _), got = lines_read(lambda lake: lake.materialise(where))
    assert got == paths and steps.count() == 4
    (steps, _), got = lines_read(lambda lake: lake.materialise(where))
    assert got == [] and steps.count() == 4
    assert lines_read(lambda lake: lake.refresh(folder)) == ((4, 0), paths)
    assert lines_read(lambda lake: lake.refresh(folder)) == ((0, 4), [])
    put(tmp_path / ".claude/projects/p/2.jsonl", [{"type": "user", "message": {"content": "changed"}}, {"type": "user", "message": {"content": "more"}}])
    os.utime(paths[2], (1, 1))
    (steps, traj), got = lines_read(lambda lake: lake.materialise(where))
    assert got == [paths[2]] and steps.count() == 5 and traj.count() == 4
    assert lines_read(lambda lake: lake.refresh(folder)) == ((1, 3), [paths[2]])
    (step, row), got = lines_read(lambda lake: lake.one(lake.find("3.jsonl").first().asDict(recursive=True)))
    assert got == [paths[3]] and row["n_steps"] == 1 and [r.message for r in step.collect()] == ["number 3"]


def test_agents_of_files(spark, home, tmp_path):
    known = [str(home / ".claude/projects/-w-p/one.jsonl"), str(home / ".copilot/session-state/x/events.jsonl")]
    loose = [put(tmp_path / "a.jsonl", [{"type": "session_meta"}]), put(tmp_path / "b.jsonl", [{"x": 1}])]
    got = files.agents_of(spark, str(home), spark.createDataFrame([(p,) for p in known + loose], "path string"))
    assert {tuple(r) for r in got.collect()} == {(known[0], "claude", "cl"), (known[1], "copilot", "cp"), (loose[0], "codex", "cx")}


def test_delete_asks_first(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(config, "load", lambda path=None: {})
    path = put(tmp_path / ".claude/projects/x/a.jsonl", [{"type": "user", "message": {"content": "Ping"}}])
    monkeypatch.setattr("builtins.input", lambda prompt: "n")
    cli.main(["--home", str(tmp_path), "delete", "ping", "--all"], spark)
    assert os.path.exists(path) and "Aborted." in capsys.readouterr().out
    cli.main(["--home", str(tmp_path), "delete", "ping", "--all", "--yes"], spark)
    assert not os.path.exists(path) and "Deleted 1" in capsys.readouterr().out


def test_streams(spark, tmp_path):
    put(tmp_path / "in/a.jsonl", [{"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hello stream"}}])
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), "claude", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        put(tmp_path / "in/b.jsonl", [{"type": "user", "message": {"content": "second"}}])
    out = str(tmp_path / "out")
    assert sorted(r.message for r in ingest.ingested(spark, out, "steps").collect()) == ["hello stream", "second"]
    # another checkpoint begins at batch 0 again, takes all files anew and leaves the batches before as they are
    put(tmp_path / "in/c.jsonl", [{"type": "user", "message": {"content": "third"}}])
    ingest.ingest(spark, str(tmp_path / "in"), "claude", out, str(tmp_path / "ck2")).awaitTermination()
    assert len(list((tmp_path / "out/steps").glob("run=*"))) == 2
    assert sorted(r.message for r in ingest.ingested(spark, out, "steps").collect()) == ["hello stream", "second", "third"]
    assert ingest.ingested(spark, out, "trajectories").count() == 3
    hits = ingest.matches(ingest.landed(spark, str(tmp_path / "in")), "STREAM")
    hits.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("hits").count() == 1
    put(tmp_path / "timed/a.jsonl", [{"type": k, "timestamp": f"2026-01-01T0{h}:30:00Z", "message": {}} for k, h in (("user", 0), ("user", 0), ("assistant", 0), ("user", 1))])
    whole = ingest.landed(spark, str(tmp_path / "timed"))
    lines = whole.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))
    ingest.event_counts(lines, "claude").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start.hour, r["name"], r["count"]) for r in spark.table("counts").collect()) == [(0, "assistant", 1), (0, "user", 2), (1, "user", 1)]


def test_the_package_can_be_shipped(tmp_path):
    import subprocess
    import sys

    path = ship.archive(str(tmp_path))
    code = f"import sys; sys.path.insert(0, {path!r}); from loomtrace.functions import decode; print(decode.__file__)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True).stdout.startswith(path)
