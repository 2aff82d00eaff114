"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Letters of a passage (the last of a text may be shorter).
PASSAGE = 400
#: Labelled documents the model is fitted on, at most: those with the least hash of their id.
MAX_LABELLED = 4000
HIDDEN = 12
ATTENTION = 8

_KIND = np.zeros(0, np.uint8)
#: Kinds of signs: lower, upper, digit, space, line break, sentence mark, quote or bracket, other mark, bar, letter outside ASCII.
KINDS = 10


def _kinds() -> np.ndarray:
    global _KIND
    if not len(_KIND):
        k = np.full(0x110000, 7, np.uint8)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isupper():
                k[i] = 1
            elif ch.isalpha():
                k[i] = 0 if i < 128 else 9
            elif ch.isdigit():
                k[i] = 2
            elif ch.isspace():
                k[i] = 4 if ch == "\n" else 3
        for ch in ".,;:!?":
            k[ord(ch)] = 5
        for ch in "'\"()[]«»„“”‘’":
            k[ord(ch)] = 6
        k[ord("|")] = 8
        _KIND = k
    return _KIND


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, text number of each passage). A null or empty text is one passage of zeros."""
    texts = [t or "" for t in texts]
    lens = np.array([len(t) for t in texts], np.int64)
    parts = np.maximum(1, -(-lens // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), parts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[codes]
    begins = np.concatenate(([0], np.cumsum(lens)))[:-1]
    within = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(parts)))[:-1], parts)
    start = begins[owner] + within * PASSAGE
    size = np.minimum(PASSAGE, lens[owner] - within * PASSAGE)
    real = size > 0
    x = np.zeros((len(owner), 2 * KINDS + 8), np.float32)
    if real.any():
        at, n = start[real], size[real].astype(np.float32)
        add = lambda flags: np.add.reduceat(flags, at, dtype=np.int64).astype(np.float32)
        share = np.stack([add(kind == i) for i in range(KINDS)], 1) / n[:, None]
        edge = np.empty(len(kind), bool)
        edge[0], edge[1:] = False, kind[1:] != kind[:-1]
        edge[at] = False
        blank = (kind == 3) | (kind == 4)
        starts = np.empty(len(kind), bool)
        starts[0], starts[1:] = False, blank[:-1] & ~blank[1:]
        starts[at] = False
        words = add(starts) + 1
        mark = (kind == 5) | (kind == 7) | (kind == 8)
        twice = np.zeros(len(kind), bool)
        twice[1:] = mark[1:] & (codes[1:] == codes[:-1])
        twice[at] = False
        shout = np.zeros(len(kind), bool)
        shout[1:] = (kind[1:] == 1) & (kind[:-1] == 1)
        shout[at] = False
        hold = np.concatenate((share, np.sqrt(share)), 1)
        more = np.stack([add(edge) / n, words / n * 10, add(twice) / n * 10, add(shout) / n, add(kind == 5) / words, add(kind == 2) / words, add((kind == 7) | (kind == 8)) / words, np.log1p(n) / 6], 1)
        x[real] = np.concatenate((hold, more), 1)
    return x, owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _first(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, np.int64)


class MIL:
    """Gated attention over passages: h = tanh(Wx), weight = softmax of w(tanh(Vh) * sigmoid(Uh)), score = sigmoid of c(sum weight h)."""

    def __init__(self, mean, scale, params):
        self.mean, self.scale, self.params = mean, scale, params

    def forward(self, x, owner):
        W, b, V, U, w, o, ob = self.params
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ W + b)
        tv, su = np.tanh(h @ V), _sigmoid(h @ U)
        e = (tv * su) @ w
        first = _first(owner)
        size = np.diff(np.concatenate((first, [len(owner)])))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return x, h, tv, su, a, z, size, first, _sigmoid(z @ o + ob)

    def score(self, texts):
        """Probability that each text is good. Every text has one; blank texts score 0."""
        if not texts:
            return np.empty(0)
        p = self.forward(*encode(texts))[-1].astype(np.float64)
        p[[not (t or "").strip() for t in texts]] = 0.0
        return p


def gradients(model: MIL, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, list[np.ndarray]]:
    """The loss (weighted mean of log-losses, plus half the decay times the squares of the matrices' weights) and its derivatives by the parameters."""
    xb, h, tv, su, a, z, size, first, p = model.forward(x, owner)
    W, b, V, U, w, o, ob = model.params
    safe = np.clip(p, 1e-12, 1 - 1e-12)
    loss = -(weight * (y * np.log(safe) + (1 - y) * np.log(1 - safe))).mean() + decay / 2 * sum((m**2).sum() for m in (W, V, U, o))
    g = weight * (p - y) / len(y)
    gz = np.repeat(g[:, None] * o, size, axis=0)
    ga = (gz * h).sum(1)
    ge = a * (ga - np.repeat(np.add.reduceat(a * ga, first), size))
    gtv, gsu = ge[:, None] * w * su * (1 - tv**2), ge[:, None] * w * tv * su * (1 - su)
    gh = (gz * a[:, None] + gtv @ V.T + gsu @ U.T) * (1 - h**2)
    return loss, [xb.T @ gh + decay * W, gh.sum(0), h.T @ gtv + decay * V, h.T @ gsu + decay * U, (ge[:, None] * tv * su).sum(0), z.T @ g + decay * o, g.sum()]


def train(texts: list[str], good: list[int], epochs: int = 60, rate: float = 0.01, seed: int = 7, decay: float = 1e-4) -> MIL:
    """Adam on mini-batches of documents; both classes weigh the same. Fixed seed, so the same rows give the same model."""
    x, owner = encode(texts)
    y = np.asarray(good, np.float64)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, (HIDDEN, ATTENTION)), rng.normal(0, 0.3, (HIDDEN, ATTENTION)), rng.normal(0, 0.3, ATTENTION), rng.normal(0, 0.3, HIDDEN), np.zeros(())]
    scale = np.maximum(x.std(axis=0), 0.02).astype(np.float64)
    model = MIL(x.mean(axis=0).astype(np.float64), scale, params)
    weight = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    spans = np.concatenate((_first(owner), [len(owner)]))
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), 64):
            docs = np.sort(order[s : s + 64])
            rows = np.concatenate([np.arange(spans[i], spans[i + 1]) for i in docs])
            _, grads = gradients(model, x[rows], np.repeat(np.arange(len(docs)), spans[docs + 1] - spans[docs]), y[docs], weight[docs], decay)
            t += 1
            lr = rate * (1 if epoch < epochs * 0.7 else 0.2)
            for i, gr in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr**2
                model.params[i] = model.params[i] - lr * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_labelled: int = MAX_LABELLED) -> MIL | None:
    """The model learnt from at most ``max_labelled`` labelled documents; None where the labels lack one of the two classes.

    Rows of ``labels`` with a null id or a label other than 0 and 1 are left out; where an id has several labels the least counts.
    """
    pick = labels.where(c.col(doc_id).isNotNull() & c.col(label).isin(0, 1)).groupBy(c.col(doc_id).alias("id")).agg(F.min(c.col(label)).alias("y"))
    pick = pick.orderBy(F.xxhash64("id"), "id").limit(max_labelled)  # bounded, so it may be broadcast
    rows = docs.select(c.col(doc_id).alias("id"), c.col(text).alias("text")).join(F.broadcast(pick), "id").where("text is not null").orderBy("id", "text").limit(max_labelled).collect()
    if len({r.y for r in rows}) < 2:
        return None
    return train([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: MIL | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the model's score in the column ``into``, in place of one called so. A missing model scores 1 for every
    text with a letter or sign, blank texts 0 always. Texts of any length are scored whole, rows each by themselves."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        for part in c.slices(batch, text):
            texts = part.column(text).to_pylist()
            p = held.value.score(texts) if held.value else np.array([float(bool((t or "").strip())) for t in texts])
            yield {}, [pa.array(p, pa.float64())], part

    return c.through(docs, run, f"`{into}` double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``; columns as they came.

    Every row is judged by itself on its whole text, however long, so repeated rows share their fate and ties (a score equal to the
    threshold) stay. Null and blank texts score 0 and go. Without usable labels (none, or of one class only) all texts
    that are not blank stay. An empty table gives an empty table.
    """
    into = c.fresh(docs, "score")[0]
    return score(docs, fit(docs, labels, text, doc_id), text, into).where(c.col(into) >= threshold).select(*c.cols(docs))
