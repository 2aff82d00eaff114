"""The configuration file: further folders with session files."""

from __future__ import annotations

import os

PATH = "~/.config/loomtrace.yaml"


def parse(content: str) -> dict:
    """``key: value`` lines, and ``key:`` lines with indented ``- item`` lines below; ``#`` begins a remark. There is no quoting."""
    out: dict = {}
    key = None
    for raw in content.splitlines():
        line = raw.rstrip()
        bare = line.lstrip()
        if not bare or bare[0] == "#":
            continue
        if line.startswith(("  ", "\t")):
            if key is not None and bare.startswith("- "):
                if not isinstance(out.get(key), list):
                    out[key] = []
                out[key].append(bare[2:].strip())
            continue
        name, colon, value = line.partition(":")
        if colon:
            key = name.strip()
            if value.strip():
                out[key] = value.strip()
    return out


def load(path: str | None = None) -> dict:
    """The configuration; empty where there is no file or it can't be read."""
    try:
        with open(os.path.expanduser(path or PATH), encoding="utf-8") as f:
            return parse(f.read())
    except OSError:
        return {}


def folders(config: dict) -> list[str]:
    held = config.get("folders", [])
    return [held] if isinstance(held, str) else [str(f) for f in held] if isinstance(held, list) else []
