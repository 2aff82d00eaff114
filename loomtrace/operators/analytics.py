"""Counts over sessions: statistics, programs, snapshots, sessions to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import edits

SHELLS = ("bash", "run_bash", "execute_bash", "shell", "run_shell", "run_terminal_cmd", "run_command", "execute_command", "terminal", "computer", "execute")


def stats(records: DataFrame, trajectories: DataFrame) -> DataFrame:
    """One row of totals over records; those without a parsed session count as unparsed."""
    t = trajectories.select("path", "n_steps", "total_tool_calls", "total_prompt_tokens", "total_completion_tokens", "total_cached_tokens", "total_tokens", F.lit(True).alias("parsed"))
    both = records.select("path", "agent").join(t, "path", "left")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0)).cast("long")
    # one pass: per agent first, then over the few agents
    per = both.groupBy("agent").agg(F.count("*").alias("n"), F.count_if("parsed").alias("parsed"), *(F.sum(k).alias(k) for k in t.columns[1:-1]))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_trajectories"),
        total("parsed").alias("parsed_trajectories"),
        total(F.col("n") - F.col("parsed")).alias("unparsed_trajectories"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agent", "n")))).alias("agents"),
        total("n_steps").alias("total_steps"),
        *(total(k).alias(k) for k in t.columns[2:-1]),
    )


def shell_command(name: Column, arguments_json: Column) -> Column:
    """The command of a shell tool's call; null for other tools."""
    first = lambda *keys: F.coalesce(*(F.nullif(F.get_json_object(arguments_json, f"$.{k}"), F.lit("")) for k in keys))
    return F.when(F.lower(name).isin(*SHELLS), first("command", "cmd", "input"))


def programs(calls: DataFrame) -> DataFrame:
    """How often each program was run through shell tools, most frequent first."""
    prog = text.first_word(shell_command(F.col("function_name"), F.col("arguments_json")))
    return calls.select(prog.alias("program")).where("program <> ''").groupBy("program").count().orderBy(F.desc("count"), "program")


def session_programs(steps: DataFrame) -> DataFrame:
    return programs(edits.calls(steps))


def find(records: DataFrame, target: str) -> DataFrame:
    """The first record, in order of discovery, with this id, stored session id or file name."""
    native = F.coalesce("session_id", F.element_at(F.split("path", "/"), -1))
    return records.where((F.col("id") == target) | (native == target)).orderBy("disc_ord").limit(1)


def delete_candidates(records: DataFrame, steps: DataFrame, message: str) -> DataFrame:
    """Records whose only user message is ``message``, without regard to case. Claude and Codex files have to hold one user step only; others are told by their first message."""
    same = records.where(F.lower(text.strip(F.coalesce("first_msg", F.lit("")))) == message.lower())
    single = steps.where("source = 'user'").groupBy("path").agg(F.count("*").alias("n")).where("n = 1").select("path")
    checked = F.col("agent").isin("claude", "codex") & F.col("session_id").isNull()
    return same.where(checked).join(single, "path", "left_semi").unionByName(same.where(~checked))


def new_or_changed(before: DataFrame, after: DataFrame, newer_only: bool = True) -> DataFrame:
    """Rows of ``after(key, mtime)`` that aren't in ``before``, or have another (later) time there."""
    old = before.select("key", F.col("mtime").alias("old"))
    changed = F.col("mtime") > F.col("old") if newer_only else F.col("mtime") != F.col("old")
    return after.join(old, "key", "left").where(F.col("old").isNull() | changed).drop("old")


def pick(kind: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """The session that a run made, as one row ``picked`` (null without any).

    ``claude_project_jsonl``: the newest new or later file, else the newest of all, by name without its ending.
    ``codex_rollout_jsonl``: the newest new or otherwise dated file, else none. ``copilot_sqlite``: the unseen id that was
    created last, else the last of all; ``mtime`` is the creation time there.
    """
    newest = lambda df: df.agg(F.max_by("key", F.struct("mtime", "key")).alias("k"))
    if kind == "codex_rollout_jsonl":
        return newest(new_or_changed(before, after, False)).select(F.col("k").alias("picked"))
    if kind == "copilot_sqlite":
        fresh = after.join(before.select("key"), "key", "left_anti")
    elif kind == "claude_project_jsonl":
        fresh = new_or_changed(before, after)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    both = newest(fresh).withColumn("a", F.lit(1)).unionByName(newest(after).withColumn("a", F.lit(2))).where("k is not null")
    name = F.col("k") if kind == "copilot_sqlite" else F.regexp_replace(F.element_at(F.split("k", "/"), -1), r"(?<=.)\.[^.]*\z", "")
    return both.agg(F.min_by(name, "a").alias("picked"))
