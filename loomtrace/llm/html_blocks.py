"""Main text of HTML pages: flat text blocks, classified by a decision tree."""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

#: Tags that don't end a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text.
SILENT = frozenset(("script", "style", "noscript", "template", "textarea", "select", "svg", "head", "iframe", "object"))
#: Of these, elements whose content has no tags of its own; scripts and styles without an end go on to the end of the page.
RAW = frozenset(("script", "style", "textarea", "iframe"))
#: Elements that may stand in a head. Any other, and any text, ends a head that has no end tag.
META = frozenset("head title meta link base basefont bgsound noframes script style noscript template".split())
_ENDS = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in (*RAW, "title")}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_SPACE = re.compile(r"\s+")
#: Words and link density of a block and of its neighbours.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")


class _Finder:
    """Where something next stands in a page: each part of the page is searched once, however often one asks."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def next(self, what, at: int) -> int:
        """The first place of a text, or of a pattern of _ENDS by its name, at ``at`` or after; -1 if there is none."""
        asked, found = self.known.get(what, (len(self.page) + 1, -1))
        if at < asked or -1 < found < at:
            m = _ENDS[what].search(self.page, at) if what in _ENDS else None
            found = self.page.find(what, at) if what not in _ENDS else m.start() if m else -1
            self.known[what] = (at, found)
        return found


def _tags(page: str) -> tuple[list[tuple[int, int, str, bool, bool]], dict[int, int]]:
    """Tags and comments in order: (start, end, name or "", closes, ends itself), and where silent elements and titles end, by their start.

    Ends belong to the last open element of their name; an element that is never closed has none. A comment without an
    end hides the rest; a tag without an end is text.
    """
    out, ends, at, find = [], {}, 0, _Finder(page)
    waiting: dict[str, list[int]] = {}
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        second = page[start + 1 : start + 2]
        if second in ("!", "?"):
            if page.startswith("<!--", start):
                stop = find.next("-->", start + 4)
                at = stop + 3 if stop >= 0 else len(page)
            else:
                stop = find.next("]]>", start) if page.startswith("<![CDATA[", start) else -1
                stop = stop + 2 if stop >= 0 else find.next(">", start)
                if stop < 0:
                    at = start + 1
                    continue
                at = stop + 1
            out.append((start, at, "", False, False))
            continue
        m = _TAG.match(page, start) if start < last else None
        if not m:
            at = start + 1
            continue
        at = m.end()
        tag, close = m.group(2).lower(), bool(m.group(1))
        alone = m.group(3).rstrip().endswith("/")
        out.append((start, at, tag, close, alone))
        if tag == "title" and not close and (stop := find.next(tag, at)) >= 0:
            ends[start] = stop
        if tag not in SILENT or tag == "head" or alone and not close:
            continue
        if tag not in RAW:
            if not close:
                waiting.setdefault(tag, []).append(start)
            elif waiting.get(tag):
                ends[waiting[tag].pop()] = start
        elif not close:
            if (stop := find.next(tag, at)) >= 0:
                ends[start] = at = stop
            elif tag in ("script", "style"):
                ends[start] = at = len(page)
    return out, ends


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """Flat text blocks in order: (text, words, share of words in links). Broken markup is read as far as it goes.

    A head without an end tag ends at the first text or element that can't stand in it. Other silent elements that are
    never closed are passed over and what follows them is read, except after scripts and styles.
    """
    if not page:
        return []
    out: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked = at = 0
    depth_a, head, titled, until = 0, False, False, 0

    def text(chunk: str) -> None:
        nonlocal linked
        if chunk:
            chunk = entities.unescape(chunk)
            parts.append(chunk)
            if depth_a:
                linked += len(chunk.split())

    def end() -> None:
        nonlocal linked
        if parts:
            joined = _SPACE.sub(" ", "".join(parts)).strip()
            if joined:
                n = len(joined.split())
                out.append((joined, n, min(1.0, linked / n)))
            parts.clear()
        linked = 0

    tags, ends = _tags(page)
    for start, after, tag, close, alone in tags:
        if start < until:
            continue
        chunk, at = page[at:start], after
        head = head and not chunk.strip()
        if not head:
            text(chunk)
        if not tag:
            continue
        if tag == "title" and titled and not close and start in ends:
            end()
            at = until = ends[start]
            continue
        if head:
            head = tag not in ("head", "body", "html") if close else tag in META
            if head and (close or tag not in SILENT):
                continue
        if tag == "head":
            end()
            head = not close and not alone
            titled = True
        elif tag in SILENT:
            end()
            if not close and start in ends:
                at = until = ends[start]
        elif tag == "a":
            depth_a = 0 if close else 1
        elif tag not in INLINE:
            end()
            depth_a = 0
    if not head or page[at:].strip():
        text(page[at:])
    end()
    return out


def features(found: list[tuple[str, int, float]]) -> np.ndarray:
    """A row of FEATURES for each block; there is nothing before the first and after the last."""
    x = np.zeros((len(found), 6), np.float32)
    if found:
        x[:, 0], x[:, 1] = [b[1] for b in found], [b[2] for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return x


class Tree:
    """A CART of Gini splits. ``nodes``: (feature, threshold, left, right) or (-1, share of content, 0, 0)."""

    def __init__(self, nodes):
        self.nodes = nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, t, left, right = (np.array(v) for v in zip(*self.nodes))
        at = np.zeros(len(x), np.int64)
        while (inner := f[at] >= 0).any():
            row = np.flatnonzero(inner)
            n = at[row]
            at[row] = np.where(x[row, f[n]] <= t[n], left[n], right[n])
        return t[at] >= 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 5) -> Tree:
    nodes: list = []

    def split(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, share, 0, 0))
        if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= leaf) & (len(order) - n >= leaf)
            if not ok.any():
                continue
            a, b = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(order) - n)
            cost = np.where(ok, n * a * (1 - a) + (len(order) - n) * b * (1 - b), np.inf)
            i = int(np.argmin(cost))
            if cost[i] < best[0]:
                best = (cost[i], f, float((v[i] + v[i + 1]) / 2))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me] = (best[1], best[2], split(rows[go], level + 1), split(rows[~go], level + 1))
        return me

    split(np.arange(len(y)), 0)
    return Tree(nodes)


def labelled_pages(n: int = 400, seed: int = 5) -> list[list[tuple[str, int, float, int]]]:
    """The small labelled table: pages as rows of (text, words, link density, 1 for content), with the usual parts of a page."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice("aeiounrstl") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def row(text: str, links: float, content: int):
        return (text, len(text.split()), links, content)

    pages = []
    for _ in range(n):
        page = []
        if rng.random() < 0.8:
            page += [row(words(1, 3), 1.0, 0) for _ in range(rng.randint(2, 8))]
        if rng.random() < 0.3:
            page.append(row(words(2, 6), 0.0, 0))  # a slogan beside the logo
        if rng.random() < 0.6:
            page += [row(words(5, 18), rng.choice((0.0, 0.0, 1.0)), 0) for _ in range(1)]  # an advertisement
        if rng.random() < 0.9:
            page.append(row(words(3, 14), 0.0, 1))  # the title
        for _ in range(rng.randint(1, 12)):
            size = rng.choice((words(1, 8), words(8, 30), words(30, 160), words(30, 160)))
            page.append(row(size, rng.choice((0.0, 0.0, 0.0, rng.uniform(0.02, 0.25))), 1))
        if rng.random() < 0.5:
            page += [row(words(2, 8), 1.0, 0) for _ in range(rng.randint(2, 6))]  # related pages
        if rng.random() < 0.5:
            page.append(row(words(2, 6), rng.choice((0.0, 0.5, 1.0)), 0))
        if rng.random() < 0.9:
            page.append(row("© " + words(2, rng.choice((12, 30))), rng.choice((0.0, 0.0, 0.3, 0.8)), 0))
        pages.append(page)
    return pages


def train(pages: list[list[tuple[str, int, float, int]]] | None = None) -> Tree:
    pages = pages if pages is not None else labelled_pages()
    return grow(np.concatenate([features([r[:3] for r in p]) for p in pages]), np.array([r[3] for p in pages for r in p], np.float64))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b[0] for b, good in zip(found, tree.predict(features(found))) if good)


def extract(pages: DataFrame, html: str = "html", into: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` with the main text of ``html`` in the column ``into`` instead of the markup.

    Every page is cut into flat blocks, each described by its own words and link density and its neighbours', and the
    blocks that the tree calls content are joined by line breaks. Works on one row at a time without any shuffle.

    A null page has a null text; an empty page, one without text or one without content has the empty text. Pages of any
    length are read whole, in time that grows with their length; broken markup is read as far as it goes. Repeated rows each have their
    text, and a block on whose class the tree's leaf is evenly split (a tie) counts as content. An empty table gives an empty table. A column
    called like ``into`` is replaced; other columns of any name are kept.
    """
    tree = tree or train()

    def run(batch):
        for part in c.slices(batch, html):
            yield {}, [pa.array([None if p is None else main_text(p, tree) for p in part.column(html).to_pylist()], pa.string())], part

    return c.through(pages, run, f"`{into}` string", html)
