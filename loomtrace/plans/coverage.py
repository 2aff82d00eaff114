"""Further queries: openings, token totals, tool calls, stores, rendering and edits, driven from the tables through the library's own functions."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, edits, index, records, render, search, sessions
from ..sources import files
from . import scratch
from .catalogue import _L, _cut, _doc_corpus, _edit, _lines, _query, _s, _str, _t
from .lake import Lake

T = lambda: F.col("text")
_TS = lambda: F.concat(F.lit("t"), F.col("turn").cast("string"))
_CWD = lambda: F.concat(F.lit("/w/"), F.col("conv_id").cast("string"))
_N = lambda: F.length("text").cast("long")
_TURN = lambda: F.col("turn").cast("long")
_USED = lambda: _s(input_tokens=_TURN() * 7, output_tokens=_N(), cached_input_tokens=_TURN())
_NUMBER = lambda: F.regexp_extract("path", r"(\d+)(?:/events)?\.jsonl$", 1).cast("long").alias("conv_id")

#: Turns are turned into lines of each format; what such a turn says in SQL.
_SAID = "arg_min(trim(text), turn) FILTER (role = 'user' AND trim(text) <> '')"
_BY = "FROM conversations GROUP BY conv_id"
_TRUNC = "CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '… [' || (length(text) - 4000) || ' chars truncated]' ELSE text END"


def _conv(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col("path").cast("long").alias("conv_id"), *columns)


# ── first messages ────────────────────────────────────────────────────────────


def _opening(spark, sf_dir, fmt: str, user: Column, agent: Column) -> DataFrame:
    return _conv(records.openings(sessions.events(_lines(spark, sf_dir, [user], [agent]), fmt), fmt), "ts", "first_msg", "cwd")




@_query("""SELECT conv_id, 't' || min(turn) FILTER (role <> 'system') AS ts, coalesce(arg_min(trim(text), turn) FILTER (role = 'user' AND turn > 0), '') AS first_msg, '/w/' || conv_id AS cwd FROM conversations GROUP BY conv_id""")
def opening_claude(spark, sf_dir):
    """A user's line at turn 0 is marked as meta and passed over."""
    return _opening(spark, sf_dir, "claude", _s(type="user", timestamp=_TS(), cwd=_CWD(), isMeta=F.col("turn") == 0, message=_s(content=F.array(_s(type="text", text=T())))), _s(type="assistant", timestamp=_TS(), cwd=_CWD(), message=_s(model="m")))


@_query(f"SELECT conv_id, 't' || min(turn) FILTER (role <> 'system') AS ts, coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS cwd {_BY}")
def opening_codex(spark, sf_dir):
    return _opening(spark, sf_dir, "codex", _s(type="event_msg", timestamp=_TS(), cwd=_CWD(), payload=_s(type="user_message", message=T())), _s(type="event_msg", timestamp=_TS(), workingDirectory=_CWD(), payload=_s(type="task_complete")))


@_query(f"SELECT conv_id, 't' || min(turn) FILTER (role <> 'system') AS ts, coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS cwd {_BY}")
def opening_copilot(spark, sf_dir):
    return _opening(spark, sf_dir, "copilot", _s(type="user.message", timestamp=_TS(), cwd=_CWD(), data=_s(content=T())), _s(type="assistant.message", timestamp=_TS(), working_directory=_CWD(), data=_s(content=T())))


@_query(f"SELECT conv_id, coalesce('t' || min(turn) FILTER (role = 'user'), '') AS ts, coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS cwd {_BY}")
def opening_probe(spark, sf_dir):
    return _opening(spark, sf_dir, "agent_probe", _s(type="user", ts=_TS(), cwd=_CWD(), content=T()), _s(type="assistant", ts=_TS(), cwd=_CWD(), content=T()))


# ── ids, models and token totals ─────────────────────────────────────────────

_TOTALS = ("total_prompt_tokens", "total_completion_tokens", "total_cached_tokens", "total_tokens")


def _totals(lines: DataFrame, fmt: str) -> DataFrame:
    return _conv(sessions.parse(lines, fmt)[1].where("total_prompt_tokens > 0"), *_TOTALS)


@_query(f"""SELECT conv_id, sum(turn + 4)::BIGINT AS total_prompt_tokens, sum(length(text))::BIGINT AS total_completion_tokens, sum(2)::BIGINT AS total_cached_tokens, sum(turn + 4 + length(text))::BIGINT AS total_tokens
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def tokens_claude(spark, sf_dir):
    use = _s(input_tokens=_TURN() + 1, cache_creation_input_tokens=F.lit(1), cache_read_input_tokens=F.lit(2), output_tokens=_N())
    return _totals(_lines(spark, sf_dir, [_s(type="user", message=_s(content=T()))], [_s(type="assistant", message=_s(usage=use, content=F.array(_s(type="text", text=T()))))]), "claude")


_MAX = "SELECT conv_id, max(turn * 7)::BIGINT AS total_prompt_tokens, max(length(text))::BIGINT AS total_completion_tokens, max(turn)::BIGINT AS total_cached_tokens, (max(turn * 7) + max(length(text)))::BIGINT AS total_tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


@_query(_MAX)
def tokens_codex(spark, sf_dir):
    lines = [_s(type="response_item", payload=_s(type="message", role="assistant", content=F.array(_s(type="output_text", text=T())))), _s(type="event_msg", payload=_s(type="token_count", info=_s(total_token_usage=_USED(), last_token_usage=_USED())))]
    return _totals(_lines(spark, sf_dir, [_s(type="event_msg", payload=_s(type="user_message", message=T()))], lines), "codex")


def _outputs(spark, sf_dir, bad: Column | None = None) -> DataFrame:
    """Captured output of a run for each conversation; where ``bad`` holds, with a line cut off."""
    lines = _lines(spark, sf_dir, [_s(type="turn.started")], [_s(type="item.completed", item=_s(type="agent_message", text=T())), _s(type="turn.completed", usage=_USED())])
    if bad is not None:
        lines = lines.withColumn("value", F.when(bad & (F.col("line_no") % 4 == 1), '{"type": ').otherwise(F.col("value")))
    return lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x.value), "\n").alias("output"))


@_query(_MAX)
def tokens_exec(spark, sf_dir):
    return _conv(sessions.parse_exec(_outputs(spark, sf_dir))[1].where("total_prompt_tokens > 0"), *_TOTALS)


@_query("SELECT conv_id, sum(turn * 7)::BIGINT AS total_prompt_tokens, sum(length(text))::BIGINT AS total_completion_tokens, sum(turn)::BIGINT AS total_cached_tokens, sum(turn * 7 + length(text))::BIGINT AS total_tokens FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def tokens_probe(spark, sf_dir):
    lines = [_s(type="usage", prompt_tokens=_TURN() * 7, completion_tokens=_N(), cached_tokens=_TURN()), _s(type="assistant", content=T())]
    return _totals(_lines(spark, sf_dir, [_s(type="user", content=T())], lines), "agent_probe")


def _hermes_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    messages = c.select(_str("conv_id").alias("session_id"), (F.col("turn") + 1).alias("id"), "role", F.col("text").alias("content"), none.alias("tool_calls"), none.alias("tool_name"), none.alias("tool_call_id"), F.lit(1.5).alias("timestamp"), none.alias("reasoning_content"))
    n = F.col("conv_id")
    rows = c.select("conv_id").distinct().select(_str("conv_id").alias("id"), F.lit("m").alias("model"), F.concat(F.lit("/w/"), n).alias("cwd"), (n * 60.5).alias("started_at"), (n + 1).alias("input_tokens"), n.alias("output_tokens"), F.lit(1).cast("long").alias("cache_read_tokens"), F.lit(2).cast("long").alias("cache_write_tokens"))
    return rows, messages


@_query(f"SELECT conv_id, conv_id + 1 AS total_prompt_tokens, conv_id AS total_completion_tokens, 3::BIGINT AS total_cached_tokens, 2 * conv_id + 1 AS total_tokens {_BY}")
def tokens_hermes(spark, sf_dir):
    return _conv(sessions.hermes(*_hermes_tables(spark, sf_dir))[1], *_TOTALS)


@_query(f"""SELECT conv_id, 's' || conv_id AS session_id, 'm' || min(turn) FILTER (role = 'assistant') AS model_name, '9' AS agent_version, '/w/' || conv_id AS cwd, count(*) FILTER (role <> 'system') AS n_steps,
count(*) FILTER (role = 'assistant') AS total_tool_calls {_BY} HAVING count(*) FILTER (role = 'assistant') > 0""")
def session_heads(spark, sf_dir):
    head = {"sessionId": F.concat(F.lit("s"), F.col("conv_id").cast("string")), "cwd": _CWD()}
    call = F.array(_s(type="tool_use", id="a", name="Bash", input=_s(command=T())))
    lines = _lines(spark, sf_dir, [_s(type="user", message=_s(content=T()), **head)], [_s(type="assistant", version="9", message=_s(model=F.concat(F.lit("m"), F.col("turn").cast("string")), content=call), **head)])
    got = sessions.parse(lines, "claude")[1].where("total_tool_calls > 0")
    return _conv(got, "session_id", "model_name", "agent_version", "cwd", "n_steps", "total_tool_calls")


# ── tool calls ────────────────────────────────────────────────────────────────


@_query(f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS step_id, {_TRUNC} AS result, text AS message FROM conversations WHERE role <> 'system' QUALIFY role = 'assistant'")
def positional_results(spark, sf_dir):
    """Results without an id belong to the step that they stand in."""
    lines = [_s(type="tool_call", name="x", args=_s(a=1)), _s(type="tool_result", result=T()), _s(type="assistant", content=T())]
    step = sessions.parse(_lines(spark, sf_dir, [_s(type="user", content=T())], lines), "agent_probe")[0].where("source = 'agent'")
    return _conv(step, "step_id", F.get("results", F.lit(0)).content.alias("result"), "message")


@_query(f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS step_id, 'c' || turn AS call_id, {_TRUNC} AS result FROM conversations WHERE role <> 'system' QUALIFY role = 'assistant'""")
def results_codex(spark, sf_dir):
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    lines = [_s(type="response_item", payload=_s(type="function_call", name="shell", call_id=name, arguments=F.to_json(_s(command=T())))), _s(type="response_item", payload=_s(type="function_call_output", call_id=name, output=T())), _s(type="event_msg", payload=_s(type="task_complete"))]
    step = sessions.parse(_lines(spark, sf_dir, [_s(type="event_msg", payload=_s(type="user_message", message=T()))], lines), "codex")[0].where("source = 'agent'")
    return _conv(step, "step_id", F.get("tool_calls", F.lit(0)).tool_call_id.alias("call_id"), F.get("results", F.lit(0)).content.alias("result"))


@_query(f"""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS step_id, 'c' || turn AS call_id, {_TRUNC} AS result FROM conversations WHERE role <> 'system' QUALIFY role = 'assistant'""")
def results_copilot(spark, sf_dir):
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    lines = [_s(type="assistant.message", data=_s(content="", toolRequests=F.array(_s(toolCallId=name, name="bash", arguments=_s(command=T()))))), _s(type="tool.execution_complete", data=_s(toolCallId=name, result=_s(content="short", detailedContent=T()))), _s(type="assistant.turn_end")]
    step = sessions.parse(_lines(spark, sf_dir, [_s(type="user.message", data=_s(content=T()))], lines), "copilot")[0].where("source = 'agent'")
    return _conv(step, "step_id", F.get("tool_calls", F.lit(0)).tool_call_id.alias("call_id"), F.get("results", F.lit(0)).content.alias("result"))


@_query("SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS message FROM conversations GROUP BY conv_id")
def exec_message(spark, sf_dir):
    return _conv(sessions.exec_final_message(_outputs(spark, sf_dir)), "message")


@_query("SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 GROUP BY conv_id")
def exec_with_bad_lines(spark, sf_dir):
    """A run with any invalid line has no steps at all."""
    bad = F.col("path").cast("long") % 3 == 0
    return _conv(sessions.parse_exec(_outputs(spark, sf_dir, bad))[0].groupBy("path").agg(F.count("*").alias("n")), "n")


_KINDS = {"view": "user", "signup": "token_limit", "click": "compaction", "error": "error", "purchase": "usage"}
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _KINDS.items()) + " END"


@_query(f"""SELECT user_id, arg_max({_KIND}, event_id) FILTER (event_type <> 'purchase') AS terminal_event, count(*) FILTER (event_type = 'error') AS error_count, 0::BIGINT AS fatal_error_count,
count(*) FILTER (event_type = 'signup') AS token_limit_count, count(*) FILTER (event_type = 'click') AS compaction_count FROM events GROUP BY user_id""")
def event_outcomes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv))[F.col("event_type")]
    out = sessions.event_summary(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line_no"), kind.alias("name")))
    return out.drop("event_types").withColumnRenamed("path", "user_id")


@_query("""SELECT count(DISTINCT conv_id) AS total_trajectories, count(DISTINCT conv_id) AS parsed_trajectories, 0::BIGINT AS unparsed_trajectories, 'claude=' || count(DISTINCT conv_id) AS agents, count(*) FILTER (role <> 'system') AS total_steps,
count(*) FILTER (role = 'assistant') AS total_tool_calls, sum(turn + 1) FILTER (role = 'assistant')::BIGINT AS total_prompt_tokens, sum(length(text)) FILTER (role = 'assistant')::BIGINT AS total_completion_tokens, 0::BIGINT AS total_cached_tokens FROM conversations""")
def stats_of_calls(spark, sf_dir):
    said = _s(usage=_s(input_tokens=_TURN() + 1, output_tokens=_N()), content=F.array(_s(type="tool_use", id="a", name="Bash", input=_s(command=T()))))
    lines = _lines(spark, sf_dir, [_s(type="user", message=_s(content=T()))], [_s(type="assistant", message=said)])
    rec = lines.select("path", F.lit("claude").alias("agent")).distinct()
    out = analytics.stats(rec, sessions.parse(lines, "claude")[1])
    return out.withColumn("agents", F.array_join(F.transform(F.map_entries("agents"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")).drop("total_tokens")


# ── records of stored sessions ───────────────────────────────────────────────

_ID = "'{}-' || substr(sha256(conv_id::VARCHAR), 1, 8) AS id"


def _rows(rec: DataFrame) -> DataFrame:
    place = F.row_number().over(search_order())
    return rec.select(F.col("session_id").cast("long").alias("conv_id"), "id", "timestamp", "first_msg", records.source_dir(rec).alias("dir"), place.alias("place"))


def search_order():
    from pyspark.sql import Window

    return Window.orderBy("disc_ord")


@_query(f"SELECT conv_id, {_ID.format('oc')}, (conv_id + 10)::VARCHAR AS timestamp, coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS dir, row_number() OVER (ORDER BY conv_id DESC)::INTEGER AS place {_BY}")
def records_opencode(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    n = F.col("conv_id")
    session = c.select("conv_id").distinct().select(_str("conv_id").alias("id"), n.alias("time_created"), (n + 10).alias("time_updated"), F.lit("m").alias("model"), F.concat(F.lit("/w/"), n).alias("directory"))
    key = F.concat_ws("-", n.cast("string"), F.col("turn").cast("string"))
    message = c.select(key.alias("id"), _str("conv_id").alias("session_id"), F.col("turn").alias("time_created"), F.to_json(F.struct("role")).alias("data"))
    parts = F.explode(F.array(F.struct(F.lit("1").alias("k"), T().alias("text")), F.struct(F.lit("2").alias("k"), F.lit("later part").alias("text"))))
    part = c.select(key.alias("message_id"), F.col("turn").alias("time_created"), parts.alias("p")).select(F.concat("message_id", F.lit("."), "p.k").alias("id"), "message_id", "time_created", F.to_json(F.struct("p.text")).alias("data"))
    return _rows(records.opencode(session, message, part, 4))


@_query(f"""SELECT conv_id, {_ID.format('hm')}, CASE WHEN conv_id = 0 THEN '' WHEN conv_id % 2 = 0 THEN strftime(make_timestamp(conv_id * 60500000), '%Y-%m-%dT%H:%M:%S') ELSE strftime(make_timestamp(conv_id * 60500000), '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS dir, row_number() OVER (ORDER BY conv_id DESC)::INTEGER AS place {_BY}""")
def records_hermes(spark, sf_dir):
    return _rows(records.hermes(*_hermes_tables(spark, sf_dir), 6))


@_query(f"SELECT conv_id, {_ID.format('gh')}, '2026-' || conv_id AS timestamp, '' AS first_msg, '—' AS dir, row_number() OVER (ORDER BY conv_id::VARCHAR)::INTEGER AS place {_BY}")
def records_copilot_db(spark, sf_dir):
    n = F.col("conv_id")
    return _rows(records.copilot_db(_t(spark, sf_dir, "conversations").select("conv_id").distinct().select(_str("conv_id").alias("id"), F.concat(F.lit("2026-"), n).alias("created_at")), 7))


@_query(f"SELECT conv_id, {_ID.format('cd')}, (conv_id + 1)::VARCHAR AS timestamp, coalesce({_SAID}, '') AS first_msg, '/w/' || conv_id AS dir, row_number() OVER (ORDER BY conv_id DESC)::INTEGER AS place FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id")
def records_codex_db(spark, sf_dir):
    """Threads with a rollout file that is found (those of even number) are left to that file."""
    c = _t(spark, sf_dir, "conversations")
    n = F.col("conv_id")
    threads = c.groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("said")).select(_str("conv_id").alias("id"), F.concat(F.lit("/r//"), n).alias("rollout_path"), (n + 1).alias("updated_at_ms"), F.col("said").alias("first_user_message"), F.concat(F.lit("/w/"), n).alias("cwd"), F.lit("m").alias("model"))
    return _rows(records.codex_db(threads, c.where(n % 2 == 0).select(F.concat(F.lit("/r/"), n).alias("path")).distinct(), 5))


@_query(f"SELECT 'cv' AS asked, min(conv_id) AS conv_id {_BY.replace('GROUP BY conv_id', '')} UNION ALL SELECT 'file', max(conv_id) FROM conversations")
def find_record(spark, sf_dir):
    """By short id and by file name."""
    c = _t(spark, sf_dir, "conversations").select("conv_id").distinct()
    rec = c.select("conv_id", text.short_id("cv", _str("conv_id")).alias("id"), F.concat(F.lit("/s/"), _str("conv_id"), F.lit(".jsonl")).alias("path"), F.lit(None).cast("string").alias("session_id"), F.col("conv_id").alias("disc_ord"))
    low, high = c.agg(F.min("conv_id"), F.max("conv_id")).first()
    first = rec.where(F.col("conv_id") == low).first().id
    return analytics.find(rec, first).select(F.lit("cv").alias("asked"), "conv_id").unionByName(analytics.find(rec, f"{high}.jsonl").select(F.lit("file").alias("asked"), "conv_id"))


@_query("SELECT event_id, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_id)::INTEGER AS place FROM events")
def order_of_records(spark, sf_dir):
    from pyspark.sql import Window

    rec = _t(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_id").alias("disc_ord"))
    placed = search.newest(rec).withColumn("at", F.monotonically_increasing_id())
    return placed.select("event_id", F.row_number().over(Window.orderBy("at")).alias("place"))


# ── snapshots ─────────────────────────────────────────────────────────────────


@_query("""WITH a AS (SELECT user_id::VARCHAR AS key, epoch_us(max(ts)) AS m FROM events GROUP BY user_id),
b AS (SELECT user_id::VARCHAR AS key, epoch_us(max(ts)) AS m FROM events WHERE event_id < (SELECT count(*) / 2 FROM events) GROUP BY user_id)
SELECT 'claude' AS kind, (SELECT arg_max(a.key, (a.m, a.key)) FROM a LEFT JOIN b USING (key) WHERE b.m IS NULL OR a.m > b.m) AS picked
UNION ALL SELECT 'codex', (SELECT arg_max('/x/' || a.key || '.jsonl', (a.m, a.key)) FROM a LEFT JOIN b USING (key) WHERE b.m IS NULL OR a.m <> b.m)
UNION ALL SELECT 'copilot', (SELECT arg_max('/x/' || a.key || '.jsonl', (a.m, a.key)) FROM a)""")
def snapshot_pick(spark, sf_dir):
    """What a run made: files that are new or later; without any, of a database the last of all."""
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/x/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    half = e.count() / 2
    before, after = (df.groupBy("key").agg(F.max("t").alias("mtime")) for df in (e.where(F.col("event_id") < half), e))
    out = analytics.pick("claude_project_jsonl", before, after).select(F.lit("claude").alias("kind"), "picked")
    out = out.unionByName(analytics.pick("codex_rollout_jsonl", before, after).select(F.lit("codex").alias("kind"), "picked"))
    return out.unionByName(analytics.pick("copilot_sqlite", after, after).select(F.lit("copilot").alias("kind"), "picked"))


# ── edits ─────────────────────────────────────────────────────────────────────


@_query(f"SELECT doc_id, source AS file, 'edit' AS op, {_L} + 1 AS lines_added, {_L} + 1 AS lines_removed, length(text) + length(lang) AS chars_added, length(text) + length(lang) AS chars_removed, '+' || ({_L} + 1) || '/-' || ({_L} + 1) || ' lines' AS delta FROM documents")
def blame_multi(spark, sf_dir):
    change = lambda old, new: _s(old_string=F.col(old), new_string=F.col(new))
    return _edit(spark, sf_dir, "MultiEdit", file_path=F.col("source"), edits=F.array(change("lang", "text"), change("text", "lang")))


@_query(f"SELECT doc_id, source AS file, 'edit' AS op, {_L} AS lines_added, 1::BIGINT AS lines_removed, length(text) AS chars_added, length(lang) AS chars_removed, '+' || {_L} || '/-1 lines' AS delta FROM documents")
def blame_replace(spark, sf_dir):
    return _edit(spark, sf_dir, "str_replace_editor", command=F.lit("str_replace"), path=F.col("source"), old_str=F.col("lang"), new_str=T())


@_query(f"SELECT doc_id, source || '.py' AS file, 'edit' AS op, {_L} AS lines_added, 1::BIGINT AS lines_removed, length(text) + 1 AS chars_added, 4::BIGINT AS chars_removed, '+' || {_L} || '/-1 lines' AS delta FROM (SELECT doc_id, source, lang, replace(text, chr(10), chr(10) || 'x') AS text FROM documents)".replace("length(text) + 1 AS", "(SELECT length(text) + 1 - (len(string_split(text, chr(10))) - 1)) AS"))
def blame_unified(spark, sf_dir):
    """A unified diff; each line of a text stands behind an ``x``, so that none looks like a header."""
    added = F.array_join(F.transform(F.split(T(), "\n", -1), lambda x: F.concat(F.lit("+x"), x)), "\n")
    name = F.concat(F.col("source"), F.lit(".py"))
    patch = F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n@@ -1 +1 @@\n"), added, F.lit("\n-gone"))
    return _edit(spark, sf_dir, "apply_patch", patch=patch)


@_query(f"SELECT 'claude' AS agent, 'd' || doc_id AS id, 'write' AS op, {_L} AS lines_added, length(text) AS chars_added, '+' || {_L} || ' lines' AS delta, substr(text, 1, 60) AS first_msg FROM documents WHERE source = 'src3'")
def blame_file(spark, sf_dir):
    """All edits of one file, named by its whole path or by its end."""
    d = _t(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "/w/p/").otherwise("./p/"), F.col("source"))
    call = F.array(_s(function_name="Write", arguments_json=F.to_json(_s(file_path=path, content=T()))))
    step = d.select(_str("doc_id").alias("path"), F.lit(1).alias("step_id"), F.lit("agent").alias("source"), F.lit("").alias("timestamp"), call.alias("tool_calls"))
    rec = d.select(_str("doc_id").alias("path"), F.concat(F.lit("d"), _str("doc_id")).alias("id"), F.lit("claude").alias("agent"), F.col("doc_id").alias("disc_ord"), F.lit("2026").alias("timestamp"), T().alias("first_msg"))
    return edits.blame(rec, step, "/w/p/src3", "newlines").select("agent", "id", "op", "lines_added", "chars_added", "delta", "first_msg")


# ── rendering ─────────────────────────────────────────────────────────────────


def _shown(spark, sf_dir) -> DataFrame:
    call = F.array(_s(tool_call_id="a", function_name="Bash", arguments_json='{"command": "ls"}'))
    return _t(spark, sf_dir, "documents").select(_str("doc_id").alias("path"), F.lit(1).alias("step_id"), F.lit("2026-01-02T03:04:05.678Z").alias("timestamp"), F.lit("agent").alias("source"), F.col("lang").alias("message"), call.alias("tool_calls"), F.array(_s(source_call_id="a", content=F.concat(F.lit("\x1b[31m"), T()))).alias("results"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@_query("""SELECT doc_id, '---' || chr(10) || '## Step 1 — AGENT *2026-01-02T03:04:05*' || chr(10) || chr(10) || '**Tool call:** `Bash`' || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "command": "ls"' || chr(10) || '}' || chr(10) || '```' || chr(10) || chr(10)
|| '**Tool result:**' || chr(10) || '```' || chr(10) || chr(27) || '[31m' || CASE WHEN length(text) > 995 THEN substr(text, 1, 995) || chr(10) || '…' ELSE text END || chr(10) || '```' || chr(10) || chr(10) || lang || chr(10) AS body FROM documents""")
def markdown_steps(spark, sf_dir):
    return render.rendered(_shown(spark, sf_dir)).select(F.col("path").cast("long").alias("doc_id"), "body")


@_query(f"""SELECT doc_id, '<section class="agent"><h2>Agent <small>2026-01-02T03:04:05</small></h2>' || chr(10) || '<div>' || chr(10) || '<b>&#9654; Bash</b><pre>{{&quot;command&quot;:&quot;ls&quot;}}</pre>' || chr(10) || '<details><summary>&#9664; result</summary><pre><span style="color:#c0392b">'
|| {_ESC.format("CASE WHEN length(text) > 995 THEN substr(text, 1, 995) || chr(10) || '…' ELSE text END")} || '</span></pre></details>' || chr(10) || '</div>' || chr(10) || '<p>' || lang || '</p>' || chr(10) || '</section>' AS body FROM documents""")
def html_steps(spark, sf_dir):
    return render.rendered(_shown(spark, sf_dir), True).select(F.col("path").cast("long").alias("doc_id"), "body")


@_query("SELECT doc_id, replace(replace(substr(text, 1, 80), '|', chr(92) || '|'), chr(10), ' ') AS cell FROM documents")
def table_cells(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.table_cell(F.substring("text", 1, 80)).alias("cell"))


# ── a home folder with stores ────────────────────────────────────────────────

_PLACES = ("claude", "codex", "copilot", "agent_probe", "codex")
_WHERE = (".claude/projects/-w-p/{}.jsonl", ".codex/sessions/2026/rollout-{}.jsonl", ".copilot/session-state/{}/events.jsonl", ".local/share/agent_probe/a/b/{}.jsonl", "more/{}.jsonl")
_AGENT = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_PLACES)) + " END"


def _home(spark, sf_dir) -> str:
    """Conversations as session files of four stores and a further folder, each with a line that is cut off."""
    cwd = F.concat(F.lit("/w/p"), F.when(F.col("conv_id") % 2 == 0, "/x").otherwise("q"))
    said = {
        "claude": (_s(type="user", cwd=cwd, message=_s(content=T())), _s(type="assistant", message=_s(content=F.array(_s(type="text", text=T()))))),
        "codex": (_s(type="event_msg", cwd=cwd, payload=_s(type="user_message", message=T())), _s(type="response_item", payload=_s(type="message", role="assistant", content=F.array(_s(type="output_text", text=T()))))),
        "copilot": (_s(type="user.message", cwd=cwd, data=_s(content=T())), _s(type="assistant.message", data=_s(content=T()))),
        "agent_probe": (_s(type="user", cwd=cwd, content=T()), _s(type="assistant", ts="t", content=T())),
    }
    place = F.array(*map(F.lit, _PLACES))[F.col("conv_id") % 5]
    c = _t(spark, sf_dir, "conversations")
    value = F.lit(None).cast("string")
    for fmt, (user, agent) in said.items():
        value = F.when(place == fmt, F.when(F.col("role") == "user", F.to_json(user)).when(F.col("role") == "assistant", F.to_json(agent)).otherwise('{"type": "cut o')).otherwise(value)
    lines = c.select("conv_id", F.struct("turn", value.alias("value")).alias("v")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda x: x.value), "\n").alias("content"))
    base = scratch.folder(spark, "home")
    base = base.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for b in batches:
            for n, content in zip(b.column("conv_id").to_pylist(), b.column("content").to_pylist()):
                path = os.path.join(base, _WHERE[n % 5].format(n))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(content + "\n")
            yield pa.RecordBatch.from_arrays([b.column("conv_id")], ["conv_id"])

    lines.mapInArrow(write, "conv_id long").write.format("noop").mode("overwrite").save()
    return base




def _lake(spark, sf_dir, scope: str | None = None) -> Lake:
    home = _home(spark, sf_dir)
    return Lake(spark, home, scope, {"folders": [f"{home}/more"]})


@_query(f"SELECT conv_id, {_AGENT} AS agent, coalesce({_SAID}, '') AS first_msg {_BY}")
def lake_records(spark, sf_dir):
    """Records of all stores of a home folder."""
    return _lake(spark, sf_dir).records.select(_NUMBER(), "agent", "first_msg")


@_query(f"SELECT conv_id, {_AGENT} AS agent {_BY} HAVING count(*) FILTER (role = 'user') > 0 AND conv_id % 2 = 0 AND conv_id % 5 > 0")
def lake_scope(spark, sf_dir):
    """Records of sessions that worked in /w/p/x or below; the folder of a project by that name has none of them."""
    return _lake(spark, sf_dir, "/w/p/x").records.where("first_msg <> ''").select(_NUMBER(), "agent")


@_query("SELECT conv_id, step_id, source, message FROM (SELECT conv_id, role, CASE role WHEN 'user' THEN 'user' ELSE 'agent' END AS source, trim(text) AS message, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS step_id FROM conversations WHERE role <> 'system')")
def lake_steps(spark, sf_dir):
    """Steps of all stores, each parsed as its format."""
    return _lake(spark, sf_dir).steps.select(_NUMBER(), "step_id", "source", "message")


@_query(f"SELECT conv_id, {_AGENT} AS fmt {_BY} HAVING {_AGENT} <> 'agent_probe' OR count(*) FILTER (role = 'assistant') > 0")
def sniffed(spark, sf_dir):
    """The format of every file, told by its lines alone; a file of agent_probe shows it in what the agent says only."""
    home = _home(spark, sf_dir)
    found = [p for p, *_ in files.list_files(spark, home, ("**/*.jsonl",))]
    return files.sniff(files.lines(spark, found)).select(_NUMBER(), "fmt")


# ── the index after changes ──────────────────────────────────────────────────


@_query("SELECT doc_id, lang = 'de' AS fresh FROM documents WHERE lang = 'de' OR list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'license')")
def index_changes(spark, sf_dir):
    """Documents in German change; a second build takes them alone, and what they said before is found no more."""
    rec, step = _doc_corpus(spark, sf_dir)
    lang = _t(spark, sf_dir, "documents").select(_str("doc_id").alias("path"), "lang")
    where = scratch.folder(spark, "index")
    index.build(rec, step, where)
    new = F.col("lang") == "de"
    rec = rec.join(lang, "path").withColumn("mtime", F.when(new, 2.5).otherwise(F.col("mtime")))
    step = step.join(lang, "path").withColumn("message", F.when(new, "xyzzyfresh words").otherwise(F.col("message"))).drop("lang")
    index.build(rec, step, where)
    return index.lookup(spark, where, r"license\|xyzzyfresh").select(F.col("path").cast("long").alias("doc_id"), F.contains("snippet", F.lit("xyzzyfresh")).alias("fresh"))


@_query(f"SELECT doc_id, {_cut('text', 'license')} AS snippet FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 'license')")
def backend_index(spark, sf_dir):
    """The index as a registered backend."""
    rec, step = _doc_corpus(spark, sf_dir)
    where = scratch.folder(spark, "index")
    index.build(rec, step, where)
    hits = search.backend("sqlite")(search.Corpus(spark, rec, lambda: step, where), "license")
    return hits.select(F.col("path").cast("long").alias("doc_id"), "snippet")
