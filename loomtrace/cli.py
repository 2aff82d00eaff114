"""The command line: list, search, show, info, blame, stats, delete, advanced tools, refresh."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import analytics, index, records, render, search
from .plans.lake import Lake

INDEX = "~/.cache/loomtrace/index"
HINT = "\nUse `show <id>` to view the whole session."


def session() -> SparkSession:
    spark = SparkSession.builder.appName("loomtrace").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _page(args) -> int:
    return -1 if args.last else args.page


def _rows(df: DataFrame, *cols, args, head: str, unit: str, foot: str = "", finish=lambda page: page) -> str:
    """A page of a table: Spark counts and cuts, the driver sees one page. ``finish`` adds what only rows that are shown need."""
    total = df.count()
    last = max(1, -(-total // args.page_size))
    number = last if args.last else args.page
    if not 1 <= number <= last:
        raise ValueError(f"page {number} out of range (1–{last})")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |"))
    got = [r[0] for r in finish(search.page(df, number, args.page_size)).select(cells).collect()]
    first = (number - 1) * args.page_size
    out = [f"<!-- page {number}/{last} | {unit} {first + 1}–{first + len(got)} of {total} -->", head, *got]
    if number == last:
        out += [foot] if foot else []
    else:
        out.append(f"\n<!-- {last - number} more page(s): --page {number + 1} -->")
    return "\n".join(out)


def _day() -> F.Column:
    return F.when(F.col("timestamp") == "", "—").otherwise(F.substring("timestamp", 1, 10))


def _cells(rec: DataFrame, with_dir: bool = False) -> list:
    said = text.table_cell(F.substring("first_msg", 1, 80))
    return [F.concat(F.lit("`"), F.col("id"), F.lit("`")), F.col("agent"), _day(), *([records.source_dir(rec)] if with_dir else []), said]


def _table(*names: str) -> str:
    return "| " + " | ".join(names) + " |\n" + "|---" * len(names) + "|"


def _lake(spark, args, everything: bool) -> Lake:
    folder = getattr(args, "dir", None)
    scope = folder or (None if everything else os.getcwd())
    return Lake(spark, getattr(args, "home", None), scope)


def _one(df: DataFrame) -> dict | None:
    r = df.first()
    return r.asDict(recursive=True) if r else None


def cmd_list(spark, args) -> str:
    lake = _lake(spark, args, args.all)
    df = lake.list(args.since, args.date)
    names = ("ID", "Agent", "Date", *(("Directory",) if args.all else ()), "First message")
    return _rows(df, *_cells(df, args.all), args=args, head=_table(*names), unit="trajectories", foot=HINT)


def cmd_search(spark, args) -> str:
    lake = _lake(spark, args, not args.local)
    if args.fast:
        df = lake.search(args.query, "fast")
        return _rows(df, *_cells(df), args=args, head=_table("ID", "Agent", "Date", "First message"), unit="results", foot=HINT)
    where, finish = os.path.expanduser(args.index), lambda page: page
    if args.backend in ("index", "sqlite"):
        df = index.ranked(spark, where, args.query, lake.records)
        finish = lambda page: index.attach(spark, where, args.query, page).orderBy("rank", "path", "step_id")
    else:
        df = lake.search(args.query, args.backend, where)
    cells = [F.concat(F.lit("`"), F.col("id"), F.lit("`")), F.col("agent"), _day(), F.col("step_id").cast("string"), text.table_cell(F.col("snippet"))]
    return _rows(df, *cells, args=args, head=_table("ID", "Agent", "Date", "Step", "Match"), unit="results", foot=HINT, finish=finish)


def _found(spark, args) -> tuple[Lake, dict, DataFrame, dict | None]:
    """The record asked for, its steps and its trajectory. Of all sessions only this one is parsed."""
    lake = Lake(spark, args.home)
    rec = _one(lake.find(args.id))
    if rec is None:
        raise LookupError(args.id)
    return lake, rec, *lake.one(rec)


def cmd_show(spark, args) -> str:
    lake, rec, mine, traj = _found(spark, args)
    if args.html:
        one = lake.records.where(F.col("path") == rec["path"]).limit(1)
        return render.documents(one, mine, args.full).first().html
    body = [r.body for r in render.rendered(mine, False, args.full).orderBy("step_id").collect()]
    number = _page(args)
    if args.step is not None:
        if not 1 <= args.step <= len(body):
            raise ValueError(f"step {args.step} out of range (1–{len(body)})")
        number = -(-args.step // args.page_size)
    return render.pages(body, number, args.page_size, "\n".join(render.header(rec, traj)), "steps")


def cmd_info(spark, args) -> str:
    try:
        _, rec, _, traj = _found(spark, args)
    except LookupError:
        print(json.dumps({"error": f"trajectory `{args.id}` not found"}, indent=2))
        raise SystemExit(1) from None
    return json.dumps(render.info(rec, traj), indent=2)


def cmd_blame(spark, args) -> str:
    target = os.path.realpath(args.file)
    df = _lake(spark, args, args.all).blame(target)
    home = os.path.expanduser("~")
    shown = "~/" + os.path.relpath(target, home) if target.startswith(home + "/") else target
    n = df.count()
    if not n:
        return f"No agent edits found for `{shown}`."
    cells = [F.when(F.col("timestamp") == "", "—").otherwise(F.substring("timestamp", 1, 19)), F.col("agent"), F.concat(F.lit("`"), F.col("id"), F.lit("`")), F.col("op"), F.col("delta"), text.table_cell(F.col("first_msg"))]
    head = f"## Blame: `{shown}` — {n} agent edit(s)\n\n" + _table("Timestamp", "Agent", "ID", "Op", "Delta", "First message")
    return _rows(df, *cells, args=args, head=head, unit="edits", foot=HINT)


def cmd_stats(spark, args) -> str:
    return json.dumps(_one(_lake(spark, args, args.all).stats()), indent=2)


def cmd_delete(spark, args) -> str:
    """Lists matching sessions and deletes their files once that is confirmed; stored sessions are passed over."""
    rows = _lake(spark, args, args.all).delete_candidates(args.message).select("id", "agent", "timestamp", "path", "session_id").collect()
    if not rows:
        return f"No trajectories found with only one user message '{args.message}'."
    for r in rows:
        print(f"  {r.id}  {r.agent:12s}  {r.timestamp[:10] or '—'}  {r.session_id or r.path}")
    if not args.yes:
        try:
            sure = input(f"\nDelete these {len(rows)}? [y/N] ").strip().lower() == "y"
        except (EOFError, KeyboardInterrupt):
            sure = False
        if not sure:
            return "Aborted."
    gone = kept = 0
    for r in rows:
        if r.session_id is not None:
            kept += 1
            continue
        try:
            os.unlink(r.path)
            gone += 1
        except OSError as e:
            print(f"Error deleting {r.path}: {e}", file=sys.stderr)
    return f"Deleted {gone} trajectory file(s)." + (f" Skipped {kept}." if kept else "")


def cmd_tools(spark, args) -> str:
    if args.dir:
        args.dir = os.path.realpath(args.dir)
        df, scope, label = Lake(spark, args.home, args.dir).programs(), {"type": "dir", "path": args.dir}, f"all trajectories in `{args.dir}`"
    else:
        _, _, mine, traj = _found(spark, args)
        if traj is None:
            raise ValueError(f"trajectory `{args.id}` cannot be parsed")
        df, scope, label = analytics.session_programs(mine), {"type": "id", "id": args.id}, f"`{args.id}`"
    got = [{"program": r["program"], "count": r["count"]} for r in df.collect()]
    if args.json:
        return json.dumps({"scope": scope, "programs": got}, indent=2)
    if not got:
        return "No shell tool calls found."
    return "\n".join([f"## Programs called in {label}\n", "| Program | Count |\n|---|---|", *(f"| `{g['program']}` | {g['count']} |" for g in got)])


def cmd_refresh(spark, args) -> str:
    """One index serves both ranked backends, so it is built unless every reason to build it is ruled out; it needs no configuration."""
    if args.config_only or (args.no_recoll and args.no_sqlite):
        return "Nothing to index."
    done, passed = Lake(spark, args.home).refresh(os.path.expanduser(args.index), args.force)
    return f"Indexed {done} session(s), skipped {passed} unchanged."


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("loomtrace", description=__doc__)
    top.add_argument("--home", help="the home folder that holds the stores")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *, paged=0, scoped=False, into=sub, **kw):
        p = into.add_parser(name, **kw)
        p.set_defaults(run=run)
        if paged:
            p.add_argument("--page", type=int, default=1)
            p.add_argument("--page-size", type=int, default=paged)
            p.add_argument("--last", action="store_true")
        if scoped:
            p.add_argument("--all", action="store_true")
            p.add_argument("--dir")
        return p

    p = command("list", cmd_list, paged=50, scoped=True)
    p.add_argument("--since")
    p.add_argument("--date")
    p = command("search", cmd_search, paged=50)
    p.add_argument("query")
    p.add_argument("--local", action="store_true")
    p.add_argument("--dir")
    p.add_argument("--fast", action="store_true")
    p.add_argument("--content", "--grep", action="store_true", help="has no effect any more")
    p.add_argument("--backend", choices=("grep", "index", "sqlite", "candidates", "recoll"), default="grep", help="sqlite is index, recoll is candidates")
    p.add_argument("--index", default=INDEX)
    p = command("show", cmd_show, paged=20)
    p.add_argument("id")
    p.add_argument("--step", type=int)
    p.add_argument("--full", "--no-truncate", action="store_true")
    p.add_argument("--html", action="store_true")
    command("info", cmd_info).add_argument("id")
    command("blame", cmd_blame, paged=50, scoped=True).add_argument("file")
    command("stats", cmd_stats).add_argument("--all", action="store_true")
    p = command("delete", cmd_delete)
    p.add_argument("message")
    p.add_argument("--yes", "-y", action="store_true")
    p.add_argument("--all", action="store_true")
    more = sub.add_parser("advanced").add_subparsers(dest="advanced", required=True)
    p = command("tools", cmd_tools, into=more)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--id")
    which.add_argument("--dir")
    p.add_argument("--json", action="store_true")
    p = command("refresh", cmd_refresh)
    for flag, what in (("--config-only", "don't index"), ("--no-recoll", "don't build for candidates"), ("--no-sqlite", "don't build for index")):
        p.add_argument(flag, action="store_true", help=what)
    p.add_argument("--force", action="store_true")
    p.add_argument("--index", default=INDEX)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        print(args.run(spark or session(), args))
    except LookupError as e:
        print(f"Error: trajectory `{e}` not found.", file=sys.stderr)
        return 1
    except (ValueError, FileNotFoundError) as e:
        print(f"Error: {e}.", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
