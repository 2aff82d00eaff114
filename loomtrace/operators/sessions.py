"""Sessions: events to steps and trajectories, the same way for every format.

Each session is a window over its lines. A running count of cuts numbers the spans between them; every span with an
agent's content is one step. Calls meet results in a left join on the call's id. All windows and groups are by path, so
one exchange serves them; nothing is gathered on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import decode, text


@dataclass(frozen=True)
class Format:
    """How a format's events add up."""

    replaces: bool = False  # a later message of a step takes the place of the one before
    model_last: bool = False  # the model is the one set last, not the first one named
    totals: str = "max"  # "sum", "max" or "none"
    estimate: str = "zero"  # when token totals are estimated: "zero" (they are 0), "always", "unseen" (no usage line)
    named: bool = True  # events have names that make an outcome
    sets: bool = True  # id and version are overwritten by each opening line


FORMATS = {
    "claude": Format(totals="sum", sets=False),
    "codex": Format(),
    "copilot": Format(totals="none", estimate="always"),
    "agent_probe": Format(replaces=True, model_last=True, totals="sum", estimate="unseen"),
    "exec": Format(),
    "hermes": Format(totals="none", named=False),
    "copilot_db": Format(totals="none", estimate="always", named=False),
}

_CALL = "struct<tool_call_id:string,function_name:string,arguments_json:string>"


def events(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """``lines(path, line_no, value[, fmt])`` decoded; lines without a JSON object are left out."""
    keep = ["path", "line_no", "value"] + ([] if fmt else ["fmt"])
    useful = lines.select(*keep).withColumn("line_no", F.col("line_no").cast("long")).where(F.length(F.trim("value")) > 0)
    return useful.mapInArrow(decode.batches(fmt), f"path string, line_no long, {decode.EVENT}")


def _spans(ev: DataFrame) -> DataFrame:
    """Events with their span ``g`` and whether an agent's step is open there."""
    order = Window.partitionBy("path").orderBy("line_no")
    before = F.sum(F.coalesce("cut_before", F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.sum(F.coalesce("cut_after", F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ev = ev.withColumn("g", before + F.coalesce(after, F.lit(0)))
    inside = Window.partitionBy("path", "g").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return ev.withColumn("open", F.max(F.coalesce("opens", F.lit(False))).over(inside))


def _in_order(value: str, keep: str, out: str):
    rows = F.array_sort(F.collect_list(F.when(F.expr(keep), F.struct("line_no", F.col(value).alias("v")))))
    return F.transform(rows, lambda x: x.v).alias(out)


def steps(ev: DataFrame, fmt: str, fallback: DataFrame | None = None) -> DataFrame:
    """Numbered steps of each session: path, step_id, timestamp, source, message, reasoning_content, tool_calls, results, metrics.

    ``fallback(path, fallback_ts)`` stands in for missing times.
    """
    rule = FORMATS[fmt]
    ev = ev.join(fallback, "path", "left") if fallback is not None else ev.withColumn("fallback_ts", F.lit(""))
    ev = ev.withColumn("ts", text.or_else(F.col("ts"), F.coalesce("fallback_ts", F.lit(""))))
    spans = _spans(ev)
    message = F.max_by("message", F.when(F.col("opens") & F.col("message").isNotNull(), F.col("line_no"))) if rule.replaces else text.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("opens") & (F.col("message") != ""), F.struct("line_no", "message")))), lambda x: x.message), "\n"))
    agent = spans.where("open").groupBy("path", "g").agg(
        F.min(F.when(F.col("opens"), F.col("line_no"))).alias("line_no"),
        F.min_by("ts", F.when(F.col("opens"), F.col("line_no"))).alias("timestamp"),
        F.coalesce(message, F.lit("")).alias("message"),
        F.max_by("reasoning", F.when(F.col("opens") & (F.col("reasoning") != ""), F.col("line_no"))).alias("reasoning_content"),
        F.flatten(_in_order("calls", "size(calls) > 0", "calls")).alias("calls"),
        F.flatten(_in_order("attached", "size(attached) > 0", "attached")).alias("attached"),
        F.max_by("metrics", F.when(F.col("metrics").isNotNull(), F.col("line_no"))).alias("metrics"),
    )
    answers = ev.select("path", "line_no", F.posexplode("results").alias("pos", "r")).groupBy("path", F.col("r.call_id").alias("call_id")).agg(F.max_by("r.content", F.struct("line_no", "pos")).alias("content"))
    asked = agent.select("path", "g", F.posexplode("calls").alias("pos", "c"))
    paired = asked.join(answers, (asked.path == answers.path) & (F.col("c.tool_call_id") == answers.call_id)).select(asked.path, "g", "pos", "call_id", "content")
    paired = paired.groupBy("path", "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "call_id", "content"))), lambda x: F.struct(x.call_id.alias("source_call_id"), text.truncate(x.content).alias("content"))).alias("paired"))
    agent = agent.join(paired, ["path", "g"], "left")
    attached = F.transform("attached", lambda x: F.struct(x.source_call_id.alias("source_call_id"), text.truncate(x.content).alias("content")))
    agent = agent.select(
        "path", "line_no", "timestamp", F.lit("agent").alias("source"), "message", "reasoning_content",
        F.when(F.size("calls") > 0, F.col("calls")).alias("calls"),
        F.coalesce("paired", F.when(F.size(attached) > 0, attached)).alias("results"),
        "metrics",
    )
    user = ev.where(~text.is_blank(F.col("user_text"))).select(
        "path", "line_no", F.col("ts").alias("timestamp"), F.lit("user").alias("source"), text.strip(F.col("user_text")).alias("message"), F.lit(None).cast("string").alias("reasoning_content"),
        *(F.lit(None).cast(agent.schema[k].dataType).alias(k) for k in ("calls", "results", "metrics")),
    )
    number = F.row_number().over(Window.partitionBy("path").orderBy("line_no"))
    calls = F.transform("calls", lambda x: F.struct(x.tool_call_id, x.function_name, x.arguments_json)).cast(f"array<{_CALL}>")
    told = text.estimate_tokens(F.col("message")) + text.estimate_tokens(F.col("reasoning_content"))
    told += F.coalesce(F.aggregate("calls", F.lit(0).cast("long"), lambda a, x: a + x.tokens), F.lit(0))
    told += F.coalesce(F.aggregate("results", F.lit(0).cast("long"), lambda a, x: a + text.estimate_tokens(x.content)), F.lit(0))
    both = agent.unionByName(user).withColumn("step_id", number)
    return both.select("path", "step_id", "timestamp", "source", "message", "reasoning_content", calls.alias("tool_calls"), "results", "metrics", told.alias("estimated_tokens"))


def _name_calls(ev: DataFrame) -> DataFrame:
    """Commands without an id, and their outputs, are named after the command's number in the session."""
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.concat(F.lit("command_"), F.count_if(F.size("calls") > 0).over(order).cast("string"))
    return ev.withColumn("nth", nth).withColumns(
        {
            "calls": F.transform("calls", lambda x: x.withField("tool_call_id", F.coalesce(x.tool_call_id, F.col("nth")))),
            "attached": F.transform("attached", lambda x: x.withField("source_call_id", F.coalesce(x.source_call_id, F.col("nth")))),
        }
    )


def event_summary(ev: DataFrame) -> DataFrame:
    """Per session: names in the order they first occur, the last one that isn't an accounting line, and four counts."""
    named = F.col("name") != ""
    count = lambda *names: F.count_if(F.col("name").isin(*names))
    return ev.groupBy("path").agg(
        F.max_by("name", F.when(named & ~F.col("name").isin("usage", "token_count"), F.col("line_no"))).alias("terminal_event"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(named, F.struct("line_no", "name")))), lambda x: x["name"])).alias("event_types"),
        count("error").alias("error_count"),
        count("fatal_error").alias("fatal_error_count"),
        count("token_limit").alias("token_limit_count"),
        count("compaction", "compact_boundary").alias("compaction_count"),
    )


def trajectories(ev: DataFrame, step: DataFrame, fmt: str) -> DataFrame:
    """One row per session: ids, model, place, token totals, outcome, number of steps."""
    rule = FORMATS[fmt]
    at = F.col("line_no")
    first = lambda k: F.min_by(k, F.when(F.col(k) != "", at))
    last_set = lambda k: F.max_by(k, F.when(F.col("sets"), at))
    own = F.min(F.when(F.col("cwd") != "", F.struct("line_no", "cwd")))
    turn = F.min(F.when(F.col("model") != "", F.struct("line_no", F.col("turn_cwd").alias("cwd"))))
    place = F.when((turn.cwd != "") & (own.isNull() | (turn.line_no < own.line_no)), turn.cwd).otherwise(own.cwd)
    fold = {"sum": F.sum, "max": F.max}.get(rule.totals)
    total = lambda k: (F.coalesce(F.greatest(fold(f"usage.{k}"), F.lit(0)), F.lit(0)) if fold else F.lit(0)).cast("long")
    meta = ev.groupBy("path").agg(
        (last_set("session_id") if rule.sets else first("session_id")).alias("session_id"),
        (last_set("model") if rule.model_last else first("model")).alias("model_name"),
        (last_set("version") if rule.sets else first("version")).alias("agent_version"),
        F.coalesce(place, F.lit("")).alias("cwd"),
        total("prompt_tokens").alias("total_prompt_tokens"),
        total("completion_tokens").alias("total_completion_tokens"),
        total("cached_tokens").alias("total_cached_tokens"),
        F.count_if(F.col("usage").isNotNull()).alias("usages"),
    )
    sums = step.groupBy("path").agg(F.count("*").alias("n_steps"), F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("total_tool_calls"), F.sum("estimated_tokens").alias("estimated_tokens"))
    zero = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    out = meta.join(sums, "path", "left").join(event_summary(ev), "path").withColumns({k: zero(k) for k in ("n_steps", "total_tool_calls", "estimated_tokens")})
    real = F.col("total_prompt_tokens") + F.col("total_completion_tokens")
    known = {"zero": real != 0, "always": F.lit(False), "unseen": F.col("usages") > 0}[rule.estimate]
    if not rule.named:
        out = out.withColumns({"terminal_event": F.lit(None).cast("string"), "event_types": F.array().cast("array<string>")})
    return out.withColumn("total_tokens", F.when(known, real).otherwise(F.col("estimated_tokens"))).drop("usages", "estimated_tokens")


def parse(lines: DataFrame, fmt: str, fallback: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(steps, trajectories) of JSONL sessions ``lines(path, line_no, value)``."""
    ev = events(lines, fmt)
    step = steps(ev, fmt, fallback)
    return step, trajectories(ev, step, fmt)


def parse_exec(outputs: DataFrame, fallback_ts: str = "") -> tuple[DataFrame, DataFrame]:
    """Captured output of single runs, ``outputs(path, output[, prompt])``; a run with any invalid line has no steps at all.

    The prompt, where there is one, is the first step.
    """
    lines = outputs.select("path", F.posexplode(F.split("output", text.BREAK, -1)).alias("line_no", "value")).where(~text.is_blank(F.col("value")))
    bad = lines.where(F.try_parse_json("value").isNull()).select("path").distinct()
    ev = _name_calls(events(lines.join(bad, "path", "left_anti"), "exec"))
    if "prompt" in outputs.columns:
        said = outputs.where("prompt <> ''").join(bad, "path", "left_anti").select("path", F.lit(-1).cast("long").alias("line_no"), F.col("prompt").alias("user_text"))
        ev = ev.unionByName(said, allowMissingColumns=True)
    step = steps(ev, "exec", outputs.select("path", F.lit(fallback_ts).alias("fallback_ts")))
    return step, trajectories(ev, step, "exec")


def exec_final_message(outputs: DataFrame) -> DataFrame:
    """(path, message): the last thing an agent said in each run; null where a line is invalid or nothing was said."""
    lines = outputs.select("path", F.posexplode(F.split("output", text.BREAK, -1)).alias("line_no", "value")).where(~text.is_blank(F.col("value")))
    v = F.try_parse_json("value")
    said = F.get_json_object("value", "$.item.text")
    ok = (F.get_json_object("value", "$.type") == "item.completed") & (F.get_json_object("value", "$.item.type") == "agent_message") & (F.schema_of_variant(F.try_variant_get(v, "$.item.text", "variant")) == "STRING") & (said != "")
    got = lines.groupBy("path").agg(F.bool_and(v.isNotNull()).alias("valid"), F.max_by(said, F.when(ok, F.col("line_no"))).alias("message"))
    return outputs.select("path").join(got.where("valid").select("path", "message"), "path", "left")


def hermes(sessions: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, trajectories) of a session database's tables ``sessions`` and ``messages``; path is the session's id."""
    rows = messages.select(F.col("session_id").alias("path"), F.col("id").cast("long").alias("line_no"), "role", F.col("content").cast("string").alias("content"), "tool_calls", "tool_call_id", "reasoning_content", text.iso_local(F.col("timestamp").cast("double")).alias("ts"))
    ev = rows.mapInArrow(decode.hermes_batches, f"path string, line_no long, {decode.EVENT}")
    fallback = sessions.select(F.col("id").alias("path"), text.iso_local(F.col("started_at").cast("double")).alias("fallback_ts"))
    step = steps(ev, "hermes", fallback)
    n = lambda *ks: sum((F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in ks), F.lit(0).cast("long"))
    row = sessions.select(F.col("id").alias("path"), F.col("id").alias("session_id"), F.col("model").alias("model_name"), F.coalesce("cwd", F.lit("")).alias("cwd"), n("input_tokens").alias("total_prompt_tokens"), n("output_tokens").alias("total_completion_tokens"), n("cache_read_tokens", "cache_write_tokens").alias("total_cached_tokens"))
    return step, _stored(row, step, "zero")


def copilot_db(sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, trajectories) of a turn database: each turn is what the user said, then what the agent said."""
    said = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("source"), F.col("user_message").alias("message")), F.struct(F.lit(1).alias("k"), F.lit("agent").alias("source"), F.col("assistant_response").alias("message"))))
    ids = sessions.select(F.col("id").alias("path"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("fallback_ts"))
    rows = turns.select(F.col("session_id").alias("path"), "turn_index", F.col("timestamp").cast("string").alias("ts"), said.alias("s")).where(~text.is_blank(F.col("s.message"))).join(ids, "path")
    number = F.row_number().over(Window.partitionBy("path").orderBy("turn_index", "s.k"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    said = text.strip(F.col("s.message"))
    step = rows.select("path", number.alias("step_id"), text.or_else(F.col("ts"), F.col("fallback_ts")).alias("timestamp"), F.col("s.source").alias("source"), said.alias("message"), none("string", "reasoning_content"), none(f"array<{_CALL}>", "tool_calls"), none("array<struct<source_call_id:string,content:string>>", "results"), none("struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint>", "metrics"), text.estimate_tokens(said).alias("estimated_tokens"))
    zero = F.lit(0).cast("long")
    row = sessions.select(F.col("id").alias("path"), none("string", "session_id"), none("string", "model_name"), F.coalesce("cwd", F.lit("")).alias("cwd"), zero.alias("total_prompt_tokens"), zero.alias("total_completion_tokens"), zero.alias("total_cached_tokens"), F.create_map(F.lit("copilot_repository"), F.coalesce("repository", F.lit("")), F.lit("copilot_summary"), F.coalesce("summary", F.lit(""))).alias("extra_agent"))
    return step, _stored(row, step, "always")


def _stored(row: DataFrame, step: DataFrame, estimate: str) -> DataFrame:
    sums = step.groupBy("path").agg(F.count("*").alias("n_steps"), F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("total_tool_calls"), F.sum("estimated_tokens").alias("told"))
    out = row.join(sums, "path", "left").withColumns({k: F.coalesce(k, F.lit(0)).cast("long") for k in ("n_steps", "total_tool_calls", "told")})
    real = F.col("total_prompt_tokens") + F.col("total_completion_tokens")
    out = out.withColumn("total_tokens", F.when((real != 0) & F.lit(estimate == "zero"), real).otherwise(F.col("told"))).drop("told")
    zero = F.lit(0).cast("long")
    return out.withColumns({"agent_version": F.lit(None).cast("string"), "terminal_event": F.lit(None).cast("string"), "event_types": F.array().cast("array<string>"), "error_count": zero, "fatal_error_count": zero, "token_limit_count": zero, "compaction_count": zero})


def lines_of(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Lines of texts given by name, for small inputs."""
    df = spark.createDataFrame(rows, "path string, content string")
    return df.select("path", F.posexplode(F.split("content", r"\r\n|\n|\r", -1)).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("long"))
