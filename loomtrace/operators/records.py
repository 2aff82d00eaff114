"""Records: one row for each session of any store, in the order of discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

COLUMNS = ("id", "agent", "timestamp", "first_msg", "path", "session_id", "source", "disc_ord", "mtime")


def openings(ev: DataFrame, fmt: str) -> DataFrame:
    """(path, ts, first_msg, cwd): the first time and user's text of each session, and the folder named in its first 31 lines.

    Claude lines marked as meta are passed over, and user lines with a prompt id of an earlier meta line too. The time is
    the first one up to the line of the text.
    """
    at = F.col("line_no")
    if fmt == "claude":
        order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.collect_set(F.when(F.col("is_meta"), F.coalesce("prompt_id", F.lit("")))).over(order)
        ev = ev.withColumn("counts", ~F.col("is_meta") & ~F.coalesce(F.array_contains(seen, F.col("prompt_id")), F.lit(False)))
    else:
        ev = ev.withColumn("counts", F.lit(True))
    hit = F.col("counts") & (F.col("first_text") != "")
    got = ev.groupBy("path").agg(
        F.min(F.when(hit, F.struct("line_no", "first_text"))).alias("hit"),
        F.min(F.when(F.col("top_ts") != "", F.struct("line_no", "top_ts"))).alias("t"),
        F.min_by("top_cwd", F.when((F.col("top_cwd") != "") & (at <= 30), at)).alias("cwd"),
    )
    early = F.col("hit").isNull() | (F.col("t.line_no") <= F.col("hit.line_no"))
    return got.select("path", F.coalesce(F.when(early, F.col("t.top_ts")), F.lit("")).alias("ts"), F.coalesce("hit.first_text", F.lit("")).alias("first_msg"), F.coalesce("cwd", F.lit("")).alias("cwd"))


def _shape(df: DataFrame, rank: int, id: Column, agent: Column | str, ts: Column, msg: Column, path: Column, session: Column, source: Column, ord: Column, mtime: Column, cwd: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        id.alias("id"), (F.lit(agent) if isinstance(agent, str) else agent).alias("agent"), F.coalesce(ts, F.lit("")).alias("timestamp"), F.coalesce(msg, F.lit("")).alias("first_msg"),
        F.coalesce(path, none).alias("path"), F.coalesce(session, none).alias("session_id"), source.alias("source"), (F.lit(rank).cast("long") * (1 << 58) + ord).alias("disc_ord"), mtime.cast("double").alias("mtime"), cwd.alias("cwd"),
    )



def file_records(files: DataFrame, opening: DataFrame, agent: Column | str, prefix: Column | str, rank: int) -> DataFrame:
    """Records of session files; a file without any readable line has no time and no text."""
    both = files.join(opening, "path", "left")
    null = F.lit(None)
    return _shape(both, rank, text.short_id(prefix, F.col("path")), agent, F.col("ts"), F.col("first_msg"), F.col("path"), null.cast("string"), null.cast("map<string,string>"), F.col("ord"), F.col("mtime"), F.coalesce("cwd", F.lit("")))


def _map(**kv: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _placed(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its place ``o`` in an order: numbers that grow along a distributed sort, not without gaps."""
    return df.orderBy(*order).withColumn("o", F.monotonically_increasing_id())


def _stored(df: DataFrame, rank: int, agent: str, prefix: str, key: Column, ts: Column, msg: Column, place: Column, ord: Column, **source: Column) -> DataFrame:
    return _shape(df, rank, text.short_id(prefix, key), agent, ts, msg, F.concat(F.lit(f"{agent}:"), key), key, _map(type=F.lit(agent), session_id=key, **source), ord, F.lit(0.0), F.coalesce(place, F.lit("")))


def opencode(session: DataFrame, message: DataFrame, part: DataFrame, rank: int) -> DataFrame:
    """The first prompt is the text of the first part of the first user's message that has parts."""
    asked = message.where(F.get_json_object("data", "$.role") == "user").select(F.col("id").alias("m"), F.col("session_id").alias("s"), F.col("time_created").alias("mt"))
    first = part.join(asked, F.col("message_id") == F.col("m")).groupBy("s").agg(F.min_by("data", F.struct("mt", "time_created", "id")).alias("data"))
    both = _placed(session.join(first, session.id == F.col("s"), "left"), F.desc("time_updated"), F.col("id"))
    said = text.strip(F.coalesce(F.get_json_object("data", "$.text"), F.lit("")))
    when = F.coalesce(F.nullif(F.col("time_updated"), F.lit(0)), F.nullif(F.col("time_created"), F.lit(0))).cast("string")
    return _stored(both, rank, "opencode", "oc", F.col("id"), when, said, F.col("directory"), F.col("o"), model=F.col("model"), dir=F.col("directory"))


def codex_db(threads: DataFrame, rollouts: DataFrame, rank: int) -> DataFrame:
    """Threads whose rollout file isn't among the files found; those without such a path stay."""
    ordered = _placed(threads, F.desc("updated_at_ms"), F.col("id"))
    known = rollouts.select(F.col("path").alias("p"))
    left = ordered.join(known, text.clean_path(F.col("rollout_path")) == F.col("p"), "left_anti")
    when = F.nullif(F.col("updated_at_ms"), F.lit(0)).cast("string")
    return _stored(left, rank, "codex_db", "cd", F.col("id").cast("string"), when, F.col("first_user_message"), F.col("cwd"), F.col("o"), model=F.col("model"), cwd=F.col("cwd"), rollout_path=F.col("rollout_path"))


def hermes(sessions: DataFrame, messages: DataFrame, rank: int) -> DataFrame:
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "id").alias("said"))
    both = _placed(sessions.join(first, sessions.id == first.session_id, "left").drop("session_id"), F.desc("started_at"), F.col("id"))
    return _stored(both, rank, "hermes", "hm", F.col("id"), text.iso_local(F.col("started_at")), text.strip(F.col("said")), F.col("cwd"), F.col("o"), model=F.col("model"), cwd=F.col("cwd"))


def copilot_db(sessions: DataFrame, rank: int) -> DataFrame:
    return _stored(_placed(sessions, F.col("id")), rank, "copilot_db", "gh", F.col("id"), F.col("created_at"), F.lit(""), F.lit(None).cast("string"), F.col("o"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_dir(rec: DataFrame) -> Column:
    """The folder of a record as shown in lists."""
    held = F.coalesce(F.nullif(F.try_element_at("source", F.lit("dir")), F.lit("")), F.nullif(F.try_element_at("source", F.lit("cwd")), F.lit("")), F.lit("—"))
    return F.when(F.col("source").isNull(), F.regexp_extract("path", r"^(.*)/[^/]*\z", 1)).otherwise(held)
