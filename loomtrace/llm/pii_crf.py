"""Personal data and secrets: a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET")

_SHAPE = np.zeros(0, np.uint8)
_RUN = re.compile(r"(.)\1*")


def _shape_table() -> np.ndarray:
    """Per code point one byte: x and X for letters, 9 for digits, a blank for white space, other ASCII as it is, ~ for the rest."""
    global _SHAPE
    if not len(_SHAPE):
        t = np.full(0x110000, ord("~"), np.uint8)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isspace():
                t[i] = 32
            elif ch.isupper():
                t[i] = ord("X")
            elif ch.isalpha():
                t[i] = ord("x")
            elif ch.isdigit():
                t[i] = ord("9")
            elif 32 < i < 127:
                t[i] = i
        _SHAPE = t
    return _SHAPE


def tokens(texts: list[str]):
    """Of all words between white space: text number, first and last position (exclusive), shape code; and the shapes."""
    lens = np.array([len(t) + 1 for t in texts])
    flat = _shape_table()[np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.zeros(len(flat) + 2, bool)
    inside[1:-1] = flat != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int64)
    shapes = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat[inside[1:-1]].tobytes()))
    coded = shapes.dictionary_encode()
    text_end = np.cumsum(lens)
    owner = np.searchsorted(text_end, begin, side="right")
    return owner, begin - (text_end - lens)[owner], end - (text_end - lens)[owner], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def shape_features(shape: str) -> list[str]:
    """Features of one word, from its shape alone."""
    core = shape.strip("\"'.,;:!?()[]{}<>*#$%&~")
    if not core:
        return ["blank"]
    kinds = "".join(m.group(1) for m in _RUN.finditer(core))
    out = []
    if core.strip("xX'-~") == "":
        return ["word"]  # letters only, whatever stands around them
    digits = core.count("9")
    letters = core.count("x") + core.count("X")
    out.append("k=" + kinds if len(kinds) <= 14 else "k=long")
    out.append(f"d={min(digits, 8)}")
    if letters == 0:
        out.append(f"plain-digits={min(digits, 20)}")
    if digits == len(core):
        out.append("card-length" if 13 <= digits <= 19 else "number")
    if re.fullmatch(r"9{1,3}(\.9{1,3}){3}", core):
        out.append("four-groups")
    if re.fullmatch(r"[^@]+@[^@]+\.[xX]{2,}", core):
        out.append("address")
    if shape.startswith("+9"):
        out.append("plus")
    if re.match(r"\(9{2,4}\)", shape):
        out.append("area")
    if re.fullmatch(r"9{3}[-.]9{4}|9{3}[-.]9{3}[-.]9{4}", core):
        out.append("local")
    if re.fullmatch(r"9{4}([- ]9{4}){3}", core):
        out.append("card-groups")
    mixed = max((len(p) for p in re.split(r"[^xX9]", core) if "9" in p and ("x" in p or "X" in p)), default=0)
    swaps = len(re.findall(r"(?<=9)[xX]|(?<=[xX])9", core))
    if mixed:
        out.append(f"mixed={'long' if mixed >= 16 else 'mid' if mixed >= 9 else 'short'}")
        out.append(f"swaps={min(swaps, 4)}")
        if "x" not in core and "X" in core and mixed == len(core):
            out.append("upper-mixed-" + ("20" if len(core) == 20 else "other"))
    if "=" in core:
        out.append("assigned")
    if shape[0] in "\"'":
        out.append("quoted")
    return out


def context_features(shape: str) -> list[str]:
    found = shape_features(shape)
    return [f for f in found if f in ("word", "blank", "plus", "area", "local", "card-groups", "number") or f.startswith("plain-digits")]


class CRF:
    """Scores of features at three places (word before, word, word after) and of label pairs."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray):
        self.index, self.weights, self.trans = index, weights, trans
        self.known: dict[str, np.ndarray] = {}

    def rows(self, shape: str) -> np.ndarray:
        """Three score rows that a word of this shape adds: to the word after it, to itself, to the word before it."""
        got = self.known.get(shape)
        if got is None:
            got = np.zeros((3, len(LABELS)))
            for place, found in enumerate((context_features(shape), shape_features(shape), context_features(shape))):
                for f in found:
                    i = self.index.get("-0+"[place] + f)
                    if i is not None:
                        got[place] += self.weights[i]
            if len(self.known) < 200_000:
                self.known[shape] = got
        return got

    def emissions(self, owner: np.ndarray, codes: np.ndarray, shapes: list[str]) -> np.ndarray:
        table = np.stack([self.rows(s) for s in shapes])[codes]
        e = table[:, 1].copy()
        same = owner[1:] == owner[:-1]
        e[1:][same] += table[:-1, 0][same]
        e[:-1][same] += table[1:, 2][same]
        return e

    def decode(self, owner: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Best label of each word: exact Viterbi paths.

        Where O leads every other label by more than any change of its two transitions can win back, O is on the best
        path; such words cut the chain, and what lies between them is decoded in batches of equal length.
        """
        best = np.zeros(len(e), np.int64)
        sway = 2 * (self.trans.max() - self.trans.min())
        open_ = np.flatnonzero(e[:, 0] - e[:, 1:].max(axis=1) <= sway)
        if not len(open_):
            return best
        cut = np.concatenate(([True], (np.diff(open_) != 1) | (owner[open_[1:]] != owner[open_[:-1]])))
        first = np.flatnonzero(cut)
        size = np.diff(np.concatenate((first, [len(open_)])))
        start = open_[first]
        for n in np.unique(size):
            at = start[size == n]
            before = (at > 0) & (owner[np.maximum(at - 1, 0)] == owner[at])
            last = at + n - 1
            after = (last + 1 < len(e)) & (owner[np.minimum(last + 1, len(e) - 1)] == owner[last])
            score = e[at] + np.where(before[:, None], self.trans[0], 0)
            back = np.zeros((int(n), len(at), len(LABELS)), np.int8)
            for t in range(1, int(n)):
                step = score[:, :, None] + self.trans
                back[t] = step.argmax(axis=1)
                score = step.max(axis=1) + e[at + t]
            label = (score + np.where(after[:, None], self.trans[:, 0], 0)).argmax(axis=1)
            for t in range(int(n) - 1, -1, -1):
                best[at + t] = label
                label = back[t][np.arange(len(at)), label]
        return best

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Spans (first position, last exclusive, label) of each text; neighbours of one label are one span."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        filled = [t or "" for t in texts]
        owner, begin, end, codes, shapes = tokens(filled)
        if not len(owner):
            return out
        best = self.decode(owner, self.emissions(owner, codes, shapes))
        previous = -2
        for i in np.flatnonzero(best).tolist():
            o, a, b, name = int(owner[i]), int(begin[i]), int(end[i]), LABELS[best[i]]
            word = filled[o][a:b]
            if not _possible(name, word):
                continue
            a, b = _core(word, a, name)
            if previous == i - 1 and out[o] and out[o][-1][2] == name and name in ("PHONE", "CARD") and int(owner[i - 1]) == o and _joins(name, filled[o][out[o][-1][0] : b]):
                out[o][-1] = (out[o][-1][0], b, name)
            else:
                out[o].append((a, b, name))
            previous = i
        return out


def _possible(name: str, word: str) -> bool:
    """Whether a word can be what its label says; shapes alone don't tell the size of a number or which letters stand in a word."""
    if name == "IP":
        return all(int(n) <= 255 for n in re.findall(r"[0-9]+", word))
    if name == "EMAIL":
        return "@" in word and "://" not in word
    return name == "SECRET" or any(ch.isdigit() for ch in word)


def _joins(name: str, surface: str) -> bool:
    """Whether words side by side are one number: as many digits as one such number has."""
    return sum(ch.isdigit() for ch in surface) <= (15 if name == "PHONE" else 19)


def _core(word: str, at: int, name: str) -> tuple[int, int]:
    """The word without marks around it that don't belong to the data."""
    strip = "\"'.,;:!?[]{}<>*#$%&" + ("" if name == "PHONE" else "()")
    left = len(word) - len(word.lstrip(strip))
    core = word.strip(strip)
    return at + left, at + left + len(core)


def labelled_table(n: int = 1200, seed: int = 11) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (word, label), made up from a seed, with the numbers and marks of ordinary text among them."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice(string.digits) for _ in range(k))
    letters = lambda a, b: "".join(rng.choice("aeiourstlnmchdé") for _ in range(rng.randint(a, b)))
    hexa = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))

    def word() -> list[tuple[str, str]]:
        w = letters(1, 11)
        r = rng.random()
        w = w.capitalize() if r < 0.15 else w.upper() if r < 0.2 else w
        w += rng.choice(("", "", "", "", "", "", ",", ".", "!!", "?", ":", "-" + letters(2, 5), "'s"))
        if rng.random() < 0.05:
            w = rng.choice(("(", '"', "«")) + w + rng.choice((")", '"', "»"))
        return [(w, "O")]

    def plain() -> list[tuple[str, str]]:
        w = rng.choice((digits(1), digits(2), digits(4), digits(rng.randint(5, 9)), f"{digits(1)}.{digits(1)}", f"{digits(2)}.{digits(2)}", f"{digits(1)},{digits(3)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}%", f"${digits(3)}", f"({digits(1)})", f"({digits(4)})", f"[{digits(2)}]", letters(2, 5) + digits(1), letters(1, 2).upper() + digits(2), f"v{digits(1)}.{digits(1)}", f"{letters(3, 5)}={digits(1)}", f"{letters(3, 5)}={letters(3, 8)}", "=", "==", "|", "&", "-", "+", "@", f"@{letters(3, 8)}", f"{digits(2)}-{digits(2)}", f"{digits(3)}-{digits(3)}", letters(2, 4) + "." + letters(2, 4), f"{digits(1)}th", f"{digits(2)}{letters(2, 3)}", f"#{digits(3)}", f"http://{letters(3, 8)}.com/{digits(3)}"))
        return [(w + rng.choice(("", "", ",", ".")), "O")]

    def email() -> list[tuple[str, str]]:
        name = rng.choice((letters(2, 8), f"{letters(2, 8)}.{digits(rng.randint(1, 3))}", f"{letters(2, 6)}.{letters(2, 8)}", f"{letters(2, 6)}_{letters(2, 6)}{digits(2)}", f"{letters(2, 6)}+{letters(2, 5)}", letters(4, 7) + digits(rng.randint(1, 4))))
        host = rng.choice((f"{letters(3, 8)}.com", f"mail{digits(1)}.{letters(3, 8)}.com", f"{letters(3, 7)}-{letters(2, 5)}.org", f"{letters(2, 5)}.co.uk", f"{letters(3, 9)}.net", f"{letters(3, 6)}{digits(2)}.io"))
        return [(f"{name}@{host}", "EMAIL")]

    def phone() -> list[tuple[str, str]]:
        a, b, d = digits(3), digits(3), digits(4)
        w = rng.choice((f"+{digits(rng.randint(1, 2))} ({a}) {b}-{d}",) * 4 + (f"({a}) {b}-{d}", f"{a}-{b}-{d}", f"+1-{a}-{b}-{d}", f"+{digits(2)} {digits(3)} {digits(rng.randint(6, 8))}", f"{a}.{b}.{d}", f"+{digits(11)}", f"+1 {a} {b} {d}", f"+1 {a}-{b}-{d}"))
        return [(x, "PHONE") for x in w.split(" ")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(str(rng.randint(0, 255)) for _ in range(4)), "IP")]

    def card() -> list[tuple[str, str]]:
        n = rng.choice((16, 16, 16, 16, 15, 13, 19))
        if rng.random() < 0.2:
            return [("-".join(digits(4) for _ in range(4)), "CARD")]
        if rng.random() < 0.2:
            return [(digits(4), "CARD") for _ in range(4)]
        return [(digits(n), "CARD")] * (2 if rng.random() < 0.1 else 1)

    def secret() -> list[tuple[str, str]]:
        while True:
            h = hexa(rng.choice((16, 18, 24, 32, 40, 64)))
            if re.search("[a-f]", h) and re.search("[0-9]", h):
                break
        key = "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(16))
        mixed = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.choice((24, 32, 36))))
        name = rng.choice(("password", "secret", "token", "api_key", "key", "pwd"))
        return rng.choice(
            (
                [("AKIA" + key[:15] + rng.choice(string.digits), "SECRET")],
                [("AKIA" + key[:7] + rng.choice(string.digits) + key[8:], "SECRET")],
                [(f"{name}={h}", "SECRET")],
                [(f"{name}={h}", "SECRET")],
                [(name, "O"), ("=", "O"), (f'"{h}"', "SECRET")],
                [(name, "O"), ("=", "O"), (f'"{h}"', "SECRET")],
                [(f"{name}:", "O"), (h, "SECRET")],
                [(h, "SECRET")],
                [("ghp_" + mixed, "SECRET")],
                [("sk-" + mixed, "SECRET")],
            )
        )

    table = []
    for _ in range(n):
        sentence: list[tuple[str, str]] = []
        for _ in range(rng.randint(4, 12)):
            r = rng.random()
            more = word() if r < 0.72 else plain() if r < 0.84 else rng.choice((email, phone, phone, ip, card, secret, secret))()
            if rng.random() < 0.25:  # marks right behind the last word
                w, label = more[-1]
                more = [*more[:-1], (w + rng.choice((".", ",", ";", "!!", "!", "?", ":", ")", "%%%", "***", "###", "&&&", "$$$")), label)]
            if rng.random() < 0.05:
                more = [(w.upper(), label) for w, label in more]
            if rng.random() < 0.03:
                w, label = more[0]
                more = [("(" + w, label), *more[1:]]
            sentence += more
        table.append(sentence)
    return table


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[list[tuple[str, str]]] | None = None, epochs: int = 40, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> CRF:
    """Log-likelihood by forward-backward over padded batches, Adam, fixed seed."""
    table = table if table is not None else labelled_table()
    index: dict[str, int] = {}
    shape_of = lambda w: _shape_table()[np.frombuffer(w.encode("utf-32-le"), np.uint32)].tobytes().decode()
    longest, L = max(len(s) for s in table), len(LABELS)
    rows = []
    y = np.zeros((len(table), longest), np.int64)
    mask = np.zeros((len(table), longest), bool)
    for i, sentence in enumerate(table):
        shapes = [shape_of(w) for w, _ in sentence]
        for t, (_, label) in enumerate(sentence):
            found = ["0" + f for f in shape_features(shapes[t])]
            found += ["-" + f for f in context_features(shapes[t - 1])] if t else []
            found += ["+" + f for f in context_features(shapes[t + 1])] if t + 1 < len(shapes) else []
            rows += [(i, t, index.setdefault(f, len(index))) for f in found]
            y[i, t], mask[i, t] = LABELS.index(label), True
    ri, rt, rf = map(np.array, zip(*rows))
    weights, trans = np.zeros((len(index), L)), np.zeros((L, L))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, trans)]
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(table))
        for s in range(0, len(order), 200):
            pick = np.zeros(len(table), bool)
            pick[order[s : s + 200]] = True
            new = np.cumsum(pick) - 1
            use = pick[ri]
            bi, bt, bf = new[ri[use]], rt[use], rf[use]
            yb, mb = y[pick], mask[pick]
            n = len(yb)
            e = np.zeros((n, longest, L))
            np.add.at(e, (bi, bt), weights[bf])
            alpha, beta = np.zeros_like(e), np.zeros_like(e)
            alpha[:, 0] = e[:, 0]
            for t in range(1, longest):
                nxt = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
                alpha[:, t] = np.where(mb[:, t, None], nxt, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                prv = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mb[:, t + 1, None], prv, 0)
            z = _logsumexp(alpha[:, -1], 1)
            marg = np.exp(alpha + beta - z[:, None, None]) * mb[:, :, None]
            diff = -marg
            ii, tt = np.nonzero(mb)
            diff[ii, tt, yb[ii, tt]] += 1
            gw = np.zeros_like(weights)
            np.add.at(gw, bf, diff[bi, bt])
            gt = np.zeros_like(trans)
            pair = mb[:, 1:]
            joint = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
            gt -= joint.sum(axis=(0, 1))
            a, b = np.nonzero(pair)
            np.add.at(gt, (yb[a, b], yb[a, b + 1]), 1)
            step += 1
            for p, g, (m1, m2) in zip((weights, trans), (gw / n - decay * weights, gt / n - 10 * decay * trans), state):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                p += rate * (1 if epoch < 0.7 * epochs else 0.2) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return CRF(index, weights, trans)


def redact(docs: DataFrame, crf: CRF | None = None, text: str = "text", spans: str | None = "spans") -> DataFrame:
    """``docs`` with personal data and secrets in ``text`` replaced by ``<LABEL>``; ``spans`` lists what was found.

    Words between white space are labelled by the field, trained by the driver on a small table and broadcast. Whole
    texts are decoded by exact Viterbi paths, a word's own signs then rule out labels that it can't have, in Arrow batches, without any shuffle. ``spans`` holds (first position, last
    exclusive, label) in the given text; None leaves the column out.

    A null text stays null, an empty or blank one as it is, both with no spans; repeated rows are treated alike; ties of
    scores fall to the label that comes first in LABELS. An empty table gives an empty table. A column called like
    ``spans`` is replaced; other columns of any name are kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf or train())
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string())]))
    (spare,) = c.fresh(docs, "spans")

    def run(batch):
        for part in c.slices(batch, text):
            texts = part.column(text).to_pylist()
            found = held.value.find(texts)
            new = []
            for t, f in zip(texts, found):
                if f:
                    pieces, at = [], 0
                    for a, b, name in f:
                        pieces += [t[at:a], f"<{name}>"]
                        at = b
                    t = "".join([*pieces, t[at:]])
                new.append(t)
            marks = pa.array([[{"first": a, "last": b, "label": n} for a, b, n in f] for f in found], kind)
            yield {text: pa.array(new, part.column(text).type)}, [marks], part

    done = c.through(docs, run, f"`{spans or spare}` array<struct<first:int,last:int,label:string>>")
    return done if spans else done.select(*c.cols(docs))
