"""Log lines of each format as events of one shape.

JSON text is read by Arrow batches in Python, because canonical argument text (key order, number text, separators) and
the printed form of values that aren't text have no counterpart in the JVM. Nothing here looks beyond its own line: which
events make a step is left to windows and aggregates.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa

_CALL = "struct<tool_call_id:string,function_name:string,arguments_json:string,tokens:bigint>"
_USE = "struct<prompt_tokens:bigint,completion_tokens:bigint,cached_tokens:bigint>"

#: What a line says. ``opens``: content of an agent's step; ``cut_before`` and ``cut_after``: a step ends there.
EVENT = (
    "name string, ts string, user_text string, opens boolean, cut_before boolean, cut_after boolean, "
    "message string, reasoning string, "
    f"calls array<{_CALL}>, results array<struct<call_id:string,content:string>>, attached array<struct<source_call_id:string,content:string>>, "
    f"metrics {_USE}, usage {_USE}, "
    "sets boolean, session_id string, model string, version string, cwd string, turn_cwd string, "
    "top_ts string, top_cwd string, first_text string, is_meta boolean, prompt_id string, votes array<string>"
)

_ARROW_CALL = pa.struct([("tool_call_id", pa.string()), ("function_name", pa.string()), ("arguments_json", pa.string()), ("tokens", pa.int64())])
_ARROW_USE = pa.struct([("prompt_tokens", pa.int64()), ("completion_tokens", pa.int64()), ("cached_tokens", pa.int64())])
_RESULT = lambda key: pa.list_(pa.struct([(key, pa.string()), ("content", pa.string())]))
ARROW = {f.split(" ")[0]: pa.string() for f in ("name", "ts", "user_text", "message", "reasoning", "session_id", "model", "version", "cwd", "turn_cwd", "top_ts", "top_cwd", "first_text", "prompt_id")}
ARROW |= {f: pa.bool_() for f in ("opens", "cut_before", "cut_after", "sets", "is_meta")}
ARROW |= {"calls": pa.list_(_ARROW_CALL), "results": _RESULT("call_id"), "attached": _RESULT("source_call_id"), "metrics": _ARROW_USE, "usage": _ARROW_USE, "votes": pa.list_(pa.string())}
FIELDS = [f.strip().split(" ")[0] for f in EVENT.replace(_CALL, "x").replace(_USE, "x").replace("struct<call_id:string,content:string>", "x").replace("struct<source_call_id:string,content:string>", "x").split(",")]


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def tokens_of(value: object) -> int:
    """A quarter of the length of a text, or of a value's canonical text."""
    if value is None or value == "":
        return 0
    text = value if isinstance(value, str) else canonical(value)
    return max(1, math.ceil(len(text) / 4))


def _str(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def _obj(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _seq(value: object) -> list:
    return value if isinstance(value, list) else []


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _int(value: object) -> int:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else 0


def _call(call_id: object, name: object, arguments: object) -> dict:
    return {"tool_call_id": _str(call_id), "function_name": _str(name), "arguments_json": canonical(arguments), "tokens": tokens_of(arguments)}


def _use(prompt: object, completion: object, cached: object) -> dict:
    return {"prompt_tokens": _int(prompt), "completion_tokens": _int(completion), "cached_tokens": _int(cached)}


def opening_text(content: object) -> str:
    """What a user's message says in a list of sessions."""
    if isinstance(content, list):
        content = " ".join(_text(p.get("text", "")) for p in content if isinstance(p, dict) and p.get("type") == "text")
    return _text(content).strip()


def _body(content: object) -> str:
    """Text of a user's message: its texts and ``[image]`` marks, one below the other."""
    if not isinstance(content, list):
        return _text(content)
    said = [p if isinstance(p, str) else _text(p.get("text", "")) if p.get("type") == "text" else "[image]" if p.get("type") == "image" else "" for p in content if isinstance(p, (str, dict))]
    return "\n".join(s for s in said if s)


def claude(d: dict) -> dict:
    kind, msg = d.get("type"), _obj(d.get("message"))
    content = msg.get("content", [])
    out = {"name": "compact_boundary" if kind == "system" and d.get("subtype") == "compact_boundary" else kind, "ts": d.get("timestamp"), "session_id": d.get("sessionId")}
    out["is_meta"], out["prompt_id"] = bool(d.get("isMeta")), _str(d.get("promptId", "" if d.get("isMeta") else None))
    if kind == "user":
        out["first_text"] = opening_text(_obj(d.get("message")).get("content", ""))
        parts = _seq(content)
        answers = [p for p in parts if isinstance(p, dict) and p.get("type") == "tool_result"]
        out["results"] = []
        for p in answers:
            inner = p.get("content", "")
            if isinstance(inner, list):
                inner = "\n".join(_text(x.get("text", "")) for x in inner if isinstance(x, dict) and x.get("type") == "text")
            if p.get("tool_use_id", ""):
                out["results"].append({"call_id": _str(p["tool_use_id"]), "content": "" if inner is None else _str(inner)})
        if not parts or len(answers) < len(parts):
            out["user_text"] = _body(content)
    elif kind == "assistant":
        parts = [p for p in _seq(content) if isinstance(p, dict)]
        out |= {"opens": True, "cut_before": True, "cut_after": True, "model": msg.get("model"), "version": d.get("version")}
        out["message"] = "\n".join(_text(p.get("text", "")) for p in parts if p.get("type") == "text").strip()
        thoughts = [p.get("thinking", "") for p in parts if p.get("type") == "thinking"]
        out["reasoning"] = thoughts[-1] if thoughts else None
        out["calls"] = [_call(p.get("id", ""), p.get("name", ""), p.get("input") or {}) for p in parts if p.get("type") == "tool_use"]
        use = _obj(msg.get("usage"))
        seen = _int(use.get("cache_read_input_tokens"))
        out["usage"] = _use(_int(use.get("input_tokens")) + _int(use.get("cache_creation_input_tokens")) + seen, use.get("output_tokens"), seen)
        if out["usage"]["prompt_tokens"] or out["usage"]["completion_tokens"]:
            out["metrics"] = out["usage"]
    for key in ("cwd", "workingDirectory", "working_directory"):
        if isinstance(d.get(key), str) and d[key]:
            out["cwd"] = d[key]
            break
    return out


def codex(d: dict) -> dict:
    kind, p = d.get("type", ""), _obj(d.get("payload"))
    sub = p.get("type", "")
    out: dict = {"name": sub or kind, "ts": d.get("timestamp")}
    if kind == "session_meta":
        out |= {"sets": True, "session_id": p.get("id"), "version": p.get("cli_version"), "cwd": p.get("cwd")}
    elif kind == "turn_context":
        out |= {"model": p.get("model"), "turn_cwd": p.get("cwd")}
    elif kind == "event_msg" and sub == "user_message":
        out |= {"cut_before": True, "user_text": _text(p.get("message")), "first_text": _text(p.get("message")).strip()}
    elif kind == "event_msg" and sub in ("task_complete", "turn_aborted"):
        out["cut_after"] = True
    elif kind == "event_msg" and sub == "token_count":
        info = _obj(p.get("info"))
        total, last = _obj(info.get("total_token_usage")), _obj(info.get("last_token_usage"))
        out["usage"] = _use(total.get("input_tokens"), total.get("output_tokens"), total.get("cached_input_tokens"))
        if last:
            out["metrics"] = _use(last.get("input_tokens"), last.get("output_tokens"), last.get("cached_input_tokens"))
    elif kind == "response_item" and sub == "message" and p.get("role") == "assistant":
        out["opens"] = True
        out["message"] = "".join(_text(x.get("text", "")) for x in _seq(p.get("content")) if isinstance(x, dict) and x.get("type") == "output_text").strip()
    elif kind == "response_item" and sub in ("function_call", "custom_tool_call"):
        arguments: object = {"input": p.get("input", "")}
        if sub == "function_call":
            try:
                arguments = json.loads(p.get("arguments") or "{}")
            except (ValueError, TypeError):
                arguments = {"raw": p.get("arguments", "")}
        out |= {"opens": True, "calls": [_call(p.get("call_id", ""), p.get("name", ""), arguments)]}
    elif kind == "response_item" and sub in ("function_call_output", "custom_tool_call_output") and p.get("call_id", ""):
        out["results"] = [{"call_id": _str(p["call_id"]), "content": str(p.get("output", ""))}]
    return out


def copilot(d: dict) -> dict:
    kind, data = d.get("type", ""), _obj(d.get("data"))
    out: dict = {"name": kind, "ts": d.get("timestamp")}
    if kind == "session.start":
        out |= {"sets": True, "session_id": data.get("sessionId"), "version": data.get("copilotVersion"), "cwd": data.get("cwd") or data.get("workingDirectory")}
    elif kind == "session.model_change":
        out["model"] = data.get("newModel")
    elif kind == "user.message":
        out |= {"cut_before": True, "user_text": _text(data.get("content")), "first_text": opening_text(data.get("content", ""))}
    elif kind == "assistant.message":
        calls = [_call(r.get("toolCallId", ""), r.get("name", ""), r.get("arguments") or {}) for r in _seq(data.get("toolRequests")) if isinstance(r, dict)]
        out |= {"opens": True, "message": _text(data.get("content")).strip(), "calls": calls}
    elif kind in ("assistant.turn_end", "session.shutdown"):
        out["cut_after"] = True
    elif kind == "tool.execution_complete" and data.get("toolCallId", ""):
        result = _obj(data.get("result"))
        out["results"] = [{"call_id": _str(data["toolCallId"]), "content": str(result.get("detailedContent") or result.get("content", ""))}]
    return out


def agent_probe(d: dict) -> dict:
    kind = d.get("type", "")
    out: dict = {"name": kind, "ts": d.get("ts")}
    if kind == "session_start":
        out |= {"sets": True, "session_id": d.get("session_id"), "model": d.get("model"), "cwd": d.get("cwd")}
    elif kind in ("user", "user.message"):
        if kind == "user":
            out |= {"cut_before": True, "user_text": _text(d.get("content"))}
            content = d.get("content", "") or _obj(d.get("message")).get("content", "")
        else:
            content = _obj(d.get("data")).get("content", "")
        out |= {"first_text": opening_text(content), "top_ts": d.get("ts") or d.get("timestamp")}
    elif kind == "tool_call":
        out |= {"opens": True, "calls": [_call("", d.get("name", ""), d.get("args") or {})]}
    elif kind == "tool_result":
        out["attached"] = [{"source_call_id": None, "content": str(d.get("result", ""))}]
    elif kind == "assistant":
        out |= {"opens": True, "cut_after": True, "message": _text(d.get("content")).strip()}
    elif kind == "usage":
        out["usage"] = _use(d.get("prompt_tokens"), d.get("completion_tokens"), d.get("cached_tokens"))
    return out


def exec_output(d: dict) -> dict:
    kind, item = d.get("type"), _obj(d.get("item"))
    out: dict = {"name": kind}
    if kind == "thread.started" and d.get("thread_id"):
        out |= {"sets": True, "session_id": str(d["thread_id"])}
    elif kind == "item.completed" and item.get("type") == "agent_message":
        said = item.get("text")
        if isinstance(said, str) and said:
            out |= {"opens": True, "message": said.rstrip()}
    elif kind == "item.completed" and item.get("type") == "command_execution":
        # without an id the call is named after its place, which a window tells later
        call_id = str(item["id"]) if item.get("id") else None
        arguments = {"command": item.get("command", ""), "exit_code": item.get("exit_code"), "status": item.get("status", "")}
        out |= {"opens": True, "calls": [_call(call_id, "command_execution", arguments)]}
        shown = item.get("aggregated_output")
        if isinstance(shown, str) and shown:
            out["attached"] = [{"source_call_id": call_id, "content": shown}]
    elif kind == "turn.completed":
        use = _obj(d.get("usage"))
        out["usage"] = out["metrics"] = _use(use.get("input_tokens"), use.get("output_tokens"), use.get("cached_input_tokens"))
        out["cut_after"] = True
    return out


def sniff(d: dict) -> list[str]:
    """Formats that this line speaks for."""
    kind = d.get("type", "")
    rules = {
        "claude": "sessionId" in d or (kind in ("user", "assistant") and "message" in d),
        "codex": kind == "session_meta" or (kind == "event_msg" and "payload" in d),
        "copilot": kind in ("session.start", "user.message", "assistant.message", "assistant.turn_end"),
        "agent_probe": kind in ("session_start", "tool_call", "tool_result") or (kind == "assistant" and "content" in d and "ts" in d),
    }
    return [name for name, hit in rules.items() if hit]


FORMATS = {"claude": claude, "codex": codex, "copilot": copilot, "agent_probe": agent_probe, "exec": exec_output}


def event(fmt: str, value: str | None) -> dict | None:
    """The event of a line; None for blank lines, invalid JSON and JSON that isn't an object."""
    value = (value or "").strip()
    if not value:
        return None
    try:
        d = json.loads(value)
    except ValueError:
        return None
    if not isinstance(d, dict):
        return None
    out = FORMATS[fmt](d)
    if "top_ts" not in out and fmt != "agent_probe":
        out["top_ts"] = d.get("timestamp")
    out["top_cwd"] = next((d[k] for k in ("cwd", "workingDirectory", "working_directory") if isinstance(d.get(k), str) and d[k]), None)
    out["votes"] = sniff(d)
    for k, kind in ARROW.items():
        if kind == pa.string() and k in out:
            out[k] = _str(out[k])
    if not isinstance(out.get("name"), str):
        out["name"] = None
    return out


def batches(fmt: str | None):
    """For mapInArrow over (path, line_no, value), with the format in a column ``fmt`` where it isn't given."""

    def run(parts):
        for b in parts:
            values = b.column("value").to_pylist()
            names = [fmt] * len(values) if fmt else b.column("fmt").to_pylist()
            found = [event(f, v) if f in FORMATS else None for f, v in zip(names, values)]
            keep = [i for i, e in enumerate(found) if e is not None]
            cols = [b.column("path").take(pa.array(keep, pa.int64())), b.column("line_no").take(pa.array(keep, pa.int64()))]
            cols += [pa.array([found[i].get(f) for i in keep], ARROW[f]) for f in FIELDS]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "line_no", *FIELDS])

    return run


def hermes_event(role, content, tool_calls, call_id, reasoning) -> dict:
    """A stored message of a session database as an event."""
    out: dict = {"name": None}
    if role == "user":
        out |= {"cut_before": True, "user_text": content or ""}
    elif role == "tool" and call_id:
        out["results"] = [{"call_id": call_id, "content": content or ""}]
    elif role == "assistant":
        calls: list[dict] = []
        try:
            for c in json.loads(tool_calls) if tool_calls else []:
                fn = c.get("function") or {}
                raw = fn.get("arguments") or c.get("arguments") or "{}"
                try:
                    arguments = json.loads(raw) if isinstance(raw, str) else raw
                except (ValueError, TypeError):
                    arguments = {"raw": raw}
                calls.append(_call(c.get("id") or c.get("call_id", ""), fn.get("name") or c.get("name", ""), arguments))
        except (ValueError, TypeError, AttributeError):
            pass
        out |= {"opens": True, "message": (content or "").strip(), "reasoning": reasoning, "calls": calls, "cut_after": not calls}
    return out


def hermes_batches(parts):
    for b in parts:
        rows = zip(*(b.column(k).to_pylist() for k in ("role", "content", "tool_calls", "tool_call_id", "reasoning_content")))
        found = [hermes_event(*r) for r in rows]
        cols = [b.column("path"), b.column("line_no")]
        cols += [b.column("ts") if f == "ts" else pa.array([e.get(f) for e in found], ARROW[f]) for f in FIELDS]
        yield pa.RecordBatch.from_arrays(cols, names=["path", "line_no", *FIELDS])
