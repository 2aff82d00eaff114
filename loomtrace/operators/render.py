"""Steps and sessions for people: Markdown and HTML."""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

COLOURS = dict(zip([str(i) for i in (*range(30, 38), *range(90, 98))], "#1a1a1a #c0392b #27ae60 #f39c12 #2980b9 #8e44ad #16a085 #bdc3c7 #7f8c8d #e74c3c #2ecc71 #f1c40f #3498db #9b59b6 #1abc9c #ecf0f1".split()))
_CODES = re.compile("\x1b\\[([0-9;]*)m")
STYLE = "body{font:16px/1.5 sans-serif;margin:2em auto;max-width:60em}section{border-left:4px solid #999;margin:1em 0;padding-left:1em}section.user{border-color:#393}section.agent{border-color:#36c}pre{white-space:pre-wrap;background:#f4f4f4;padding:.5em}"


def ansi_to_html(shown: str) -> str:
    """Escaped text in which colour and weight codes are spans; a reset closes all that are open, and so does the end."""
    out, at, open_ = [], 0, 0
    for m in _CODES.finditer(shown):
        out.append(html.escape(shown[at : m.start()]))
        at = m.end()
        for code in m.group(1).split(";"):
            if code in ("", "0"):
                out.append("</span>" * open_)
                open_ = 0
            elif code == "1" or code in COLOURS:
                rule = "font-weight:bold" if code == "1" else f"color:{COLOURS[code]}"
                out.append(f'<span style="{rule}">')
                open_ += 1
    return "".join(out) + html.escape(shown[at:]) + "</span>" * open_


def _cut(s: str, limit: int, full: bool) -> str:
    return s if full or len(s) <= limit else s[:limit] + "\n…"


def _value(arguments_json: str | None):
    try:
        return json.loads(arguments_json or "{}")
    except ValueError:
        return {}


def step_markdown(step: dict, full: bool = False) -> str:
    """A step with its calls, then their results, then its message. Long arguments and results are cut unless ``full``."""
    who = {"user": "USER"}.get(step["source"], "AGENT")
    when = f" *{step['timestamp'][:19]}*" if step.get("timestamp") else ""
    out = ["---", f"## Step {step['step_id']} — {who}{when}", ""]
    for c in step.get("tool_calls") or []:
        shown = _cut(json.dumps(_value(c["arguments_json"]), indent=2), 600, full)
        out += [f"**Tool call:** `{c['function_name']}`", "```json", shown, "```", ""]
    for r in step.get("results") or []:
        out += ["**Tool result:**", "```", _cut(r["content"] or "*empty output*", 1000, full), "```", ""]
    if step.get("message"):
        out += [step["message"], ""]
    return "\n".join(out)


def step_html(step: dict, full: bool = False) -> str:
    """A step as HTML. The i-th result stands with the i-th call; results without a call come after them."""
    who = "user" if step["source"] == "user" else "agent"
    out = [f'<section class="{who}"><h2>{who.title()} <small>{html.escape((step.get("timestamp") or "")[:19])}</small></h2>']
    calls, results = step.get("tool_calls") or [], step.get("results") or []
    for i in range(max(len(calls), len(results))):
        out.append("<div>")
        if i < len(calls):
            name, args = calls[i]["function_name"] or "", _value(calls[i]["arguments_json"])
            hidden = None
            if name == "create_tool" and isinstance(args, dict) and "source_code" in args and not full:
                hidden = str(args.get("source_code") or "")
                shown = json.dumps({k: v for k, v in args.items() if k != "source_code"}, indent=2)
            else:
                short = json.dumps(args, separators=(",", ":"))
                shown = _cut(short if len(short) <= 120 else json.dumps(args, indent=2), 600, full)
            out.append(f"<b>&#9654; {html.escape(name)}</b><pre>{html.escape(shown)}</pre>")
            if hidden is not None:
                out.append(f"<details><summary>source_code</summary><pre>{html.escape(hidden)}</pre></details>")
        if i < len(results):
            said = results[i]["content"] or ""
            said = _cut(said, 1000, full or i >= len(calls))
            out.append(f"<details><summary>&#9664; result</summary><pre>{ansi_to_html(said) if said else '<i>empty output</i>'}</pre></details>")
        out.append("</div>")
    if step.get("message"):
        out.append(f"<p>{html.escape(step['message'])}</p>")
    return "\n".join([*out, "</section>"])


def rendered(steps: DataFrame, as_html: bool = False, full: bool = False) -> DataFrame:
    """(path, step_id, body) of many steps, in Arrow batches."""
    make = step_html if as_html else step_markdown

    def run(parts):
        for b in parts:
            body = [make(r, full) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("step_id"), pa.array(body, pa.string())], ["path", "step_id", "body"])

    return steps.select("path", "step_id", "timestamp", "source", "message", "tool_calls", "results").mapInArrow(run, "path string, step_id int, body string")


def documents(records: DataFrame, steps: DataFrame, full: bool = False) -> DataFrame:
    """(path, html): a whole page for each session, ready for ``write.text``."""
    body = rendered(steps, True, full).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_id", "body"))), lambda x: x.body), "\n").alias("body"))
    title = text.escape_html(F.col("id"))
    head = F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), title, F.lit(f"</title><style>{STYLE}</style></head><body><h1>"), title, F.lit("</h1><p>"), text.escape_html(F.substring("first_msg", 1, 120)), F.lit("</p>\n"))
    return records.join(body, "path", "left").select("path", F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n</body></html>")).alias("html"))


def header(rec: dict, traj: dict | None) -> list[str]:
    """What is known about a session, as lines of Markdown."""
    out = [f"# Trajectory `{rec['id']}`", f"**Agent:** {rec['agent']}"]
    put = lambda name, value: out.append(f"**{name}:** {value}") if value else None
    put("Date", (rec["timestamp"] or "")[:19])
    if rec["agent"] == "agent_probe":
        put("Source", rec["path"])
    if traj is None:
        source = rec.get("source") or {}
        put("Session ID", source.get("session_id"))
        put("Model", source.get("model"))
        put("Directory", source.get("dir") or source.get("cwd"))
        return [*out, "", "*The steps of this kind of session can't be read.*"]
    out.append(f"**Steps:** {traj['n_steps']}")
    put("Model", traj["model_name"])
    put("Directory", traj["cwd"])
    put("Tool calls", traj["total_tool_calls"])
    p, q, total = (traj[f"total_{k}"] for k in ("prompt_tokens", "completion_tokens", "tokens"))
    put("Tokens", f"{p} prompt / {q} completion / {total} total" if p or q else f"~{total} (estimated)" if total else "")
    return out


def info(rec: dict, traj: dict | None) -> dict:
    """A session's metadata for JSON."""
    out = {"id": rec["id"], "agent": rec["agent"], "timestamp": rec["timestamp"], "first_message": rec["first_msg"]}
    if traj is None:
        return out | {"source": dict(rec["source"]) if rec.get("source") else rec["path"]}
    names = {"steps": "n_steps", "model": "model_name", "directory": "cwd", "tool_calls": "total_tool_calls"}
    names |= {k: f"total_{k}" for k in ("prompt_tokens", "completion_tokens", "cached_tokens")} | {"total_tokens": "total_tokens"}
    out |= {k: traj[v] for k, v in names.items()}
    return out | {k: traj[k] for k in ("session_id", "agent_version") if traj[k]}


def pages(items: list[str], number: int, size: int, head: str, unit: str, foot: str = "") -> str:
    """One page of lines that are there already. -1 is the last one; a page that doesn't exist is an error."""
    total, last = len(items), max(1, -(-len(items) // size))
    number = last if number == -1 else number
    if not 1 <= number <= last:
        raise ValueError(f"page {number} out of range (1–{last})")
    first = (number - 1) * size
    out = [f"<!-- page {number}/{last} | {unit} {first + 1}–{min(first + size, total)} of {total} -->"]
    out += [head] * bool(head) + items[first : first + size]
    out += [foot] if foot and number == last else []
    out += [f"\n<!-- {last - number} more page(s): --page {number + 1} -->"] if number < last else []
    return "\n".join(out)
