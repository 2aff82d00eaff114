import json

import pytest

from loomtrace.operators import sessions


def run(spark, fmt, entries, fallback=None):
    body = "\n".join(e if isinstance(e, str) else json.dumps(e, ensure_ascii=False) for e in entries)
    step, traj = sessions.parse(sessions.lines_of(spark, [("/s.jsonl", body)]), fmt, fallback)
    return [r.asDict(recursive=True) for r in step.orderBy("step_id").collect()], traj.first().asDict(recursive=True)


def brief(steps):
    return [(s["step_id"], s["source"], s["message"]) for s in steps]


CLAUDE = [
    {"type": "user", "sessionId": "s1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w", "message": {"content": "fix the bug"}},
    {"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "version": "1.2", "message": {"model": "m", "usage": {"input_tokens": 5, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 1, "output_tokens": 3}, "content": [{"type": "thinking", "thinking": "hm"}, {"type": "thinking", "thinking": "ha"}, {"type": "text", "text": " looking "}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "git status", "n": 2.50}}, {"type": "tool_use", "id": "c2", "name": "Read", "input": {}}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}]}},
    {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": {"odd": 1}}, "and this", {"type": "image"}, {"type": "text", "text": ""}]}},
    "not json", "", "[1, 2]", '{"type": "user", "type": "system", "subtype": "compact_boundary", "x": NaN}',
    {"type": "user", "isMeta": True, "message": {"content": "meta"}},
    {"type": "user", "message": {"content": " \n "}},
    {"type": "assistant", "message": {"content": "no list"}},
]


def test_claude(spark):
    steps, traj = run(spark, "claude", CLAUDE)
    assert brief(steps) == [(1, "user", "fix the bug"), (2, "agent", "looking"), (3, "user", "and this\n[image]"), (4, "user", "meta"), (5, "agent", "")]
    two = steps[1]
    assert two["reasoning_content"] == "ha" and [c["function_name"] for c in two["tool_calls"]] == ["Bash", "Read"]
    assert two["tool_calls"][0]["arguments_json"] == '{"command": "git status", "n": 2.5}'
    assert two["results"] == [{"source_call_id": "c1", "content": "{'odd': 1}"}]
    assert two["metrics"] == {"prompt_tokens": 10, "completion_tokens": 3, "cached_tokens": 4}
    assert steps[4]["tool_calls"] is None and steps[4]["metrics"] is None and steps[4]["timestamp"] == ""
    assert (traj["session_id"], traj["model_name"], traj["agent_version"], traj["cwd"]) == ("s1", "m", "1.2", "/w")
    assert (traj["total_prompt_tokens"], traj["total_completion_tokens"], traj["total_cached_tokens"], traj["total_tokens"]) == (10, 3, 4, 13)
    assert traj["total_tool_calls"] == 2 and traj["n_steps"] == 5 and traj["compaction_count"] == 1
    assert traj["event_types"] == ["user", "assistant", "compact_boundary"] and traj["terminal_event"] == "assistant"


def test_estimated_tokens_and_fallback_time(spark):
    fallback = spark.createDataFrame([("/s.jsonl", "T")], "path string, fallback_ts string")
    steps, traj = run(spark, "claude", [{"type": "user", "message": {"content": "x" * 9}}, {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "a", "name": "f", "input": {"k": "v"}}]}}], fallback)
    assert traj["total_tokens"] == 3 + 3 and {s["timestamp"] for s in steps} == {"T"}


CODEX = [
    {"type": "session_meta", "timestamp": "t0", "payload": {"id": "i0", "cli_version": "0", "cwd": ""}},
    {"type": "turn_context", "payload": {"model": "gpt", "cwd": "/turn"}},
    {"type": "turn_context", "payload": {"model": "other", "cwd": "/other"}},
    {"type": "session_meta", "payload": {"id": "i1", "cwd": "/late"}},
    {"type": "event_msg", "timestamp": "t1", "payload": {"type": "user_message", "message": " hello "}},
    {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 9}}}},
    {"type": "response_item", "timestamp": "t2", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]}},
    {"type": "response_item", "timestamp": "t3", "payload": {"type": "function_call", "call_id": "c", "name": "shell", "arguments": '{"z": 1, "a": [1.50]}'}},
    {"type": "response_item", "payload": {"type": "function_call", "call_id": "d", "name": "shell", "arguments": "broken{"}},
    {"type": "response_item", "payload": {"type": "custom_tool_call", "call_id": "e", "name": "apply_patch", "input": "p"}},
    {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": {"k": [1]}}},
    {"type": "response_item", "payload": {"type": "custom_tool_call_output", "call_id": "e", "output": "x" * 4001}},
    {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 100, "output_tokens": 7, "cached_input_tokens": 3}, "last_token_usage": {"input_tokens": 50, "output_tokens": 5}}}},
    {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 80}}}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "c"}]}},
    {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "output_text", "text": "no"}]}},
    {"type": "event_msg", "payload": {"type": "task_complete"}},
    {"type": "response_item", "timestamp": "t4", "payload": {"type": "message", "role": "assistant", "content": []}},
    {"type": "event_msg", "payload": {"type": "user_message", "message": ""}},
    {"type": "response_item", "timestamp": "t5", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "end"}]}},
]


def test_codex(spark):
    steps, traj = run(spark, "codex", CODEX)
    assert brief(steps) == [(1, "user", "hello"), (2, "agent", "ab\nc"), (3, "agent", ""), (4, "agent", "end")]
    two = steps[1]
    assert two["timestamp"] == "t2" and [c["arguments_json"] for c in two["tool_calls"]] == ['{"z": 1, "a": [1.5]}', '{"raw": "broken{"}', '{"input": "p"}']
    assert [r["source_call_id"] for r in two["results"]] == ["c", "e"] and two["results"][0]["content"] == "{'k': [1]}"
    assert two["results"][1]["content"] == "x" * 4000 + "\n… [1 chars truncated]"
    assert two["metrics"] == {"prompt_tokens": 50, "completion_tokens": 5, "cached_tokens": 0}
    assert (traj["session_id"], traj["agent_version"], traj["model_name"], traj["cwd"]) == ("i1", None, "gpt", "/turn")
    assert (traj["total_prompt_tokens"], traj["total_completion_tokens"], traj["total_cached_tokens"], traj["total_tokens"]) == (100, 7, 3, 107)
    assert traj["terminal_event"] == "message" and traj["total_tool_calls"] == 3


def test_copilot(spark):
    steps, traj = run(spark, "copilot", [
        {"type": "session.start", "data": {"sessionId": "s", "copilotVersion": "v", "workingDirectory": "/c"}},
        {"type": "session.model_change", "data": {"newModel": None}}, {"type": "session.model_change", "data": {"newModel": "m"}},
        {"type": "user.message", "data": {"content": "hi"}},
        {"type": "assistant.message", "data": {"content": "one", "toolRequests": [{"toolCallId": "c", "name": "bash", "arguments": {"a": 1}}]}},
        {"type": "tool.execution_complete", "data": {"toolCallId": "c", "result": {"content": "short", "detailedContent": "long"}}},
        {"type": "assistant.message", "data": {"content": "two"}}, {"type": "assistant.turn_end"},
        {"type": "assistant.message", "data": {"content": "three"}}, {"type": "session.shutdown", "data": {}},
    ])
    assert brief(steps) == [(1, "user", "hi"), (2, "agent", "one\ntwo"), (3, "agent", "three")]
    assert steps[1]["results"] == [{"source_call_id": "c", "content": "long"}]
    assert (traj["session_id"], traj["agent_version"], traj["model_name"], traj["cwd"]) == ("s", "v", "m", "/c")
    assert traj["total_tokens"] == 1 + 2 + 2 + 1 + 2 and traj["terminal_event"] == "session.shutdown"


def test_agent_probe(spark):
    steps, traj = run(spark, "agent_probe", [
        {"type": "session_start", "session_id": "s", "model": "m", "cwd": "/p"}, {"type": "tool_result", "result": "lost"},
        {"type": "user", "ts": "t", "content": "go"}, {"type": "tool_call", "name": "f", "args": None}, {"type": "tool_result", "result": [1, "a"]},
        {"type": "tool_call", "name": "g", "args": {"x": 1}}, {"type": "assistant", "content": "done"}, {"type": "tool_result", "result": "late"},
        {"type": "assistant", "content": "more"}, {"type": "tool_call", "name": "h"},
        {"type": "error"}, {"type": "compaction"}, {"type": "fatal_error"}, {"type": "token_limit"}, {"type": "usage", "prompt_tokens": 2, "completion_tokens": 3},
    ])
    assert brief(steps) == [(1, "user", "go"), (2, "agent", "done"), (3, "agent", "more"), (4, "agent", "")]
    assert [c["arguments_json"] for c in steps[1]["tool_calls"]] == ["{}", '{"x": 1}'] and steps[1]["results"] == [{"source_call_id": None, "content": "[1, 'a']"}]
    assert traj["terminal_event"] == "token_limit" and [traj[k] for k in ("error_count", "fatal_error_count", "token_limit_count", "compaction_count")] == [1, 1, 1, 1]
    assert traj["total_tokens"] == 5 and traj["cwd"] == "/p"
    assert run(spark, "agent_probe", [{"type": "user", "content": "abcd"}, {"type": "usage"}])[1]["total_tokens"] == 0
    assert run(spark, "agent_probe", [{"type": "user", "content": "abcd"}])[1]["total_tokens"] == 1


def test_exec(spark):
    lines = [{"type": "thread.started", "thread_id": 7}, {"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "exit_code": 0, "aggregated_output": "out"}}, {"type": "item.completed", "item": {"id": "x", "type": "command_execution", "command": "a"}}, {"type": "item.completed", "item": {"type": "agent_message", "text": "first \n"}}, {"type": "item.completed", "item": {"type": "agent_message", "text": " second"}}, {"type": "turn.completed", "usage": {"input_tokens": 4, "output_tokens": 2}}, {"type": "item.completed", "item": {"type": "agent_message", "text": "last"}}]
    body = "\n".join(map(json.dumps, lines))
    df = spark.createDataFrame([("good", body, "please"), ("bad", body + "\n{", "please"), ("none", "", "")], "path string, output string, prompt string")
    step, traj = sessions.parse_exec(df, "T")
    got = [r.asDict(recursive=True) for r in step.orderBy("path", "step_id").collect()]
    assert [(s["path"], *b) for s, b in zip(got, brief(got))] == [("good", 1, "user", "please"), ("good", 2, "agent", "first\n second"), ("good", 3, "agent", "last")]
    assert [c["tool_call_id"] for c in got[1]["tool_calls"]] == ["command_1", "x"] and got[1]["results"] == [{"source_call_id": "command_1", "content": "out"}]
    assert got[1]["metrics"]["prompt_tokens"] == 4 and {s["timestamp"] for s in got} == {"T"}
    t = traj.first()
    assert t.session_id == "7" and t.total_tokens == 6 and t.total_tool_calls == 2
    said = {r.path: r.message for r in sessions.exec_final_message(df).collect()}
    assert said == {"good": "last", "bad": None, "none": None}


def test_hermes(spark):
    ses = spark.createDataFrame([("s", "m", None, 1700000000.5, 4, 5, 1, 2), ("e", None, "/x", None, None, None, None, None)], "id string, model string, cwd string, started_at double, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long")
    calls = json.dumps([{"id": "c", "function": {"name": "f", "arguments": '{"a": 1}'}}, {"call_id": "d", "name": "g", "arguments": "oops"}])
    rows = [(1, "s", "user", " hi ", None, None, 1700000000.0, None), (2, "s", "assistant", "x", calls, None, None, "why"), (3, "s", "tool", "res", None, "c", None, None), (4, "s", "assistant", "y", "[", None, None, None), (5, "s", "assistant", "z", None, None, None, None)]
    msg = spark.createDataFrame(rows, "id long, session_id string, role string, content string, tool_calls string, tool_call_id string, timestamp double, reasoning_content string")
    step, traj = sessions.hermes(ses, msg)
    got = [r.asDict(recursive=True) for r in step.orderBy("step_id").collect()]
    assert brief(got) == [(1, "user", "hi"), (2, "agent", "x\ny"), (3, "agent", "z")]
    assert [c["arguments_json"] for c in got[1]["tool_calls"]] == ['{"a": 1}', '{"raw": "oops"}'] and got[1]["results"] == [{"source_call_id": "c", "content": "res"}]
    assert got[1]["reasoning_content"] == "why" and got[0]["timestamp"] == "2023-11-14T22:13:20" and got[1]["timestamp"] == "2023-11-14T22:13:20.500000"
    t = {r.path: r for r in traj.collect()}
    assert t["s"].total_tokens == 9 and t["s"].total_cached_tokens == 3 and t["e"].n_steps == 0 and t["e"].cwd == "/x"


def test_turn_database(spark):
    ses = spark.createDataFrame([("s", "2026", "/c", "r", None), ("e", None, None, None, None)], "id string, created_at string, cwd string, repository string, summary string")
    turns = spark.createDataFrame([("s", 1, "b", " ", "t1"), ("s", 0, " a ", "A", None), ("gone", 0, "x", "y", "t")], "session_id string, turn_index long, user_message string, assistant_response string, timestamp string")
    step, traj = sessions.copilot_db(ses, turns)
    got = [r.asDict() for r in step.orderBy("step_id").collect()]
    assert brief(got) == [(1, "user", "a"), (2, "agent", "A"), (3, "user", "b")] and [s["timestamp"] for s in got] == ["2026", "2026", "t1"]
    t = {r.path: r for r in traj.collect()}
    assert set(t) == {"s", "e"} and t["s"].total_tokens == 3 and t["s"].extra_agent == {"copilot_repository": "r", "copilot_summary": ""}


@pytest.mark.parametrize("fmt", ["claude", "codex", "copilot", "agent_probe"])
def test_empty_and_foreign_sessions(spark, fmt):
    step, traj = sessions.parse(sessions.lines_of(spark, [("/a", ""), ("/b", "nope\n[]\n1")]), fmt)
    assert step.count() == 0 and traj.count() == 0
    steps, t = run(spark, fmt, [{"other": 1}, {"type": 3}])
    assert steps == [] and t["n_steps"] == 0 and t["total_tokens"] == 0
