"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the whole text are cut into bins.  Cyclic boosting visits the
features in turn; each visit fits a shallow tree to the gradient over that
feature's bins and adds a small share of it to the feature's lookup table.
Pairs of features whose coarse joint bins explain most of what is left get
two-way tables, fitted in the same way.  A score is the logistic function of
the sum of looked-up values, so scoring is bin search and addition.

A null text is an empty one and gets the score of its features like any other.
Rows without a label, or with another label than 0 and 1, train nothing; a
label table without both classes gives the constant share of ones (0.5 if
empty).  Several labels of one id count as that many examples.  Repeated rows
are scored alike; empty tables give empty results; only the text is a feature.

Scale: the model is fitted on at most ``sample`` labelled rows, picked by a hash
of their ids; everything else is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: documented bound of the training sample
SAMPLE = 20_000
BINS, COARSE = 48, 12
ROUNDS, RATE, LEAVES, MIN_LEAF = 150, 0.08, 4, 15
PAIRS, PAIR_ROUNDS = 8, 60
RIDGE = 1.0

_CLASSES = ("upper", "lower", "digit", "blank", "line", "stop", "bang", "bar", "symbol", "quote", "bracket", "other", "lead", "follow", "control")
_CLASS = np.full(256, _CLASSES.index("other"), np.int64)
for _name, _chars in {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "blank": b" \t", "line": b"\n\r\x0b\x0c",
    "stop": b".,;:?-", "bang": b"!", "bar": b"|", "symbol": b"*$%&#@^~=+_", "quote": b"'\"`", "bracket": b"()[]{}<>",
    "lead": bytes(range(0xC0, 256)), "follow": bytes(range(0x80, 0xC0)), "control": bytes([*range(9), *range(14, 32), 127]),
}.items():
    _CLASS[list(_chars)] = _CLASSES.index(_name)

FEATURES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "types", "top_word", "same_next", "same_after_next",
    "distinct_pairs", "upper_words", "noisy_words", "bar_words", "run_bytes", "mean_line", "repeated_lines",
)


def features(b: common.Block) -> np.ndarray:
    """One row of numbers for each document of a block."""
    n, size = len(b), np.diff(b.offsets)
    out = np.zeros((n, len(FEATURES)))
    col = dict(zip(FEATURES, out.T, strict=True))
    if not len(b.data):
        return out
    k = len(_CLASSES)
    cls = _CLASS[b.data]
    of = np.repeat(np.arange(n), size)
    counts = np.bincount(of * k + cls, minlength=n * k).reshape(n, k)
    # capitals of Latin-1, two bytes each, count as capitals too
    capital = np.flatnonzero((b.data[:-1] == 0xC3) & (b.data[1:] >= 0x80) & (b.data[1:] <= 0x9E))
    upper = counts[:, 0] + np.bincount(of[capital], minlength=n)
    letters = np.maximum(upper + counts[:, 1] + counts[:, _CLASSES.index("lead")], 1)
    out[:, :k] = counts / np.maximum(size, 1)[:, None]
    col["share_upper"][:] = upper / letters
    col["log_bytes"][:] = np.log1p(size)
    same = np.flatnonzero((b.data[1:] == b.data[:-1]) & (of[1:] == of[:-1]) & (cls[1:] != _CLASSES.index("blank")))
    col["run_bytes"][:] = np.bincount(of[same], minlength=n) / np.maximum(size, 1)
    w = common.find_words(b)
    words = np.diff(w.first)
    some = np.maximum(words, 1)
    if len(w.doc):
        length = w.end - w.start
        col["log_words"][:] = np.log1p(words)
        mean = col["mean_word"][:] = np.bincount(w.doc, length, n) / some
        col["std_word"][:] = np.sqrt(np.maximum(np.bincount(w.doc, length.astype(float) ** 2, n) / some - mean**2, 0))
        np.maximum.at(col["longest_word"], w.doc, np.log1p(length))
        top, types = _repeats(w.doc, w.hash, n)
        col["types"][:] = types / some
        col["top_word"][:] = top / some
        for name, step in (("same_next", 1), ("same_after_next", 2)):
            hit = (w.hash[step:] == w.hash[:-step]) & (w.doc[step:] == w.doc[:-step])
            col[name][:] = np.bincount(w.doc[step:][hit], minlength=n) / some
        pair = common.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])
        inside = w.doc[1:] == w.doc[:-1]
        _, pairs = _repeats(w.doc[1:][inside], pair[inside], n)
        col["distinct_pairs"][:] = pairs / np.maximum(words - 1, 1)

        def spans(mask: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(mask)]
            return total[w.end] - total[w.start]

        shout = spans(cls == 0)
        col["upper_words"][:] = np.bincount(w.doc[(shout >= 2) & (spans(cls == 1) == 0)], minlength=n) / some
        col["noisy_words"][:] = np.bincount(w.doc[spans(cls == _CLASSES.index("symbol")) >= 2], minlength=n) / some
        col["bar_words"][:] = np.bincount(w.doc[(length == 1) & (b.data[w.start] == ord("|"))], minlength=n) / some
    lines = common.find_words(b, common.ASCII_LOWER, _LINE_END)
    per = np.diff(lines.first)
    col["mean_line"][:] = np.log1p(size / np.maximum(per, 1))
    if len(lines.doc):
        _, kinds = _repeats(lines.doc, lines.hash, n)
        col["repeated_lines"][:] = np.where(per > 0, 1 - kinds / np.maximum(per, 1), 0)
    return out


_LINE_END = np.zeros(256, bool)
_LINE_END[[10, 13]] = True


def _repeats(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document how often its most frequent value occurs, and its distinct values."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    if not len(d):
        return np.zeros(n), np.zeros(n)
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
    runs = np.diff(np.r_[new, len(d)])
    top = np.zeros(n)
    np.maximum.at(top, d[new], runs)
    return top, np.bincount(d[new], minlength=n)


@dataclass
class Additive:
    """Lookup tables over bins: one a feature, and one a pair of features."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], "right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.coarse[f], x[:, f], "right"), np.searchsorted(self.coarse[g], x[:, g], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -500, 500)))


def _cuts(v: np.ndarray, most: int) -> np.ndarray:
    """Cut points at quantiles, midway between neighbouring values."""
    u = np.unique(v)
    if len(u) > most:
        u = np.unique(np.quantile(v, np.linspace(0, 1, most + 1), method="nearest"))
    return (u[:-1] + u[1:]) / 2


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over the bins of one feature: cut greedily, best gain first."""
    g, h, c = (np.r_[0, np.cumsum(v)] for v in (grad, hess, count))

    def best(a: int, z: int) -> tuple[float, int]:
        m = np.arange(a + 1, z)
        m = m[(c[m] - c[a] >= MIN_LEAF) & (c[z] - c[m] >= MIN_LEAF)]
        if not len(m):
            return 0.0, -1
        gain = (g[m] - g[a]) ** 2 / (h[m] - h[a] + RIDGE) + (g[z] - g[m]) ** 2 / (h[z] - h[m] + RIDGE) - (g[z] - g[a]) ** 2 / (h[z] - h[a] + RIDGE)
        i = int(np.argmax(gain))
        return float(gain[i]), int(m[i])

    parts = [(0, len(grad), *best(0, len(grad)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        a, z, gain, m = parts[i]
        if gain <= 1e-9:
            break
        parts[i : i + 1] = [(a, m, *best(a, m)), (m, z, *best(m, z))]
    out = np.zeros(len(grad))
    for a, z, _, _ in parts:
        out[a:z] = (g[z] - g[a]) / (h[z] - h[a] + RIDGE)
    return out


def _cross_tree(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of two levels over joint bins: one cut by rows, one by columns on either side."""
    best, out = -1.0, np.zeros_like(grad)
    for flip in (False, True):
        g, h = (x.T if flip else x for x in (grad, hess))
        gr, hr = (np.cumsum(x, 0) for x in (g, h))
        for cut in range(len(g) - 1):
            val, total = np.zeros_like(g), 0.0
            for rows, gs, hs in ((slice(0, cut + 1), gr[cut], hr[cut]), (slice(cut + 1, None), gr[-1] - gr[cut], hr[-1] - hr[cut])):
                a, b = np.cumsum(gs), np.cumsum(hs)
                gain = a**2 / (b + RIDGE) + (a[-1] - a) ** 2 / (b[-1] - b + RIDGE)
                m = int(np.argmax(gain))
                total += float(gain[m])
                val[rows, : m + 1] = a[m] / (b[m] + RIDGE)
                val[rows, m + 1 :] = (a[-1] - a[m]) / (b[-1] - b[m] + RIDGE)
            if total > best:
                best, out = total, val.T if flip else val
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of single features, then of the pairs that explain most of the rest."""
    n, k = x.shape if len(x) else (0, len(FEATURES))
    ones = float(y.sum())
    if n == 0 or ones in (0.0, float(n)):
        share = 0.5 if n == 0 else min(max(ones / n, 1e-6), 1 - 1e-6)
        return Additive(float(np.log(share / (1 - share))), [np.zeros(0)] * k, [np.zeros(1)] * k, [], [np.zeros(0)] * k, [])
    base = float(np.log(ones / (n - ones)))
    cuts = [_cuts(x[:, f], BINS) for f in range(k)]
    at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(n, base)
    counts = [np.bincount(a, minlength=len(t)) for a, t in zip(at, tables, strict=True)]
    for _ in range(ROUNDS):
        for f in range(k):
            if len(tables[f]) > 1:
                p = 1 / (1 + np.exp(-z))
                step = RATE * _tree(np.bincount(at[f], y - p, len(tables[f])), np.bincount(at[f], p * (1 - p), len(tables[f])), counts[f], LEAVES)
                tables[f] += step
                z += step[at[f]]
    coarse = [_cuts(x[:, f], COARSE) for f in range(k)]
    ca = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(coarse)]
    wide = [len(c) + 1 for c in coarse]
    p = 1 / (1 + np.exp(-z))

    def joint(f: int, g: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(ca[f] * wide[g] + ca[g], v, wide[f] * wide[g]).reshape(wide[f], wide[g])

    gains = []
    for f in range(k):
        for g in range(f + 1, k):
            if wide[f] > 1 and wide[g] > 1:
                gr, he = joint(f, g, y - p), joint(f, g, p * (1 - p))
                value = _cross_tree(gr, he)
                gains.append((float((2 * gr * value - he * value**2).sum()), f, g))
    pairs = [(f, g) for _, f, g in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = [np.zeros((wide[f], wide[g])) for f, g in pairs]
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in zip(pairs, pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _cross_tree(joint(f, g, y - p), joint(f, g, p * (1 - p)))
            table += step
            z += step[ca[f], ca[g]]
    return Additive(base, cuts, tables, pairs, coarse, pair_tables)


def with_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``x``, the array of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([b.batch.column(key), pa.array(list(features(b)), pa.list_(pa.float64()))], names=[key, "x"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Additive:
    """Fit on at most ``sample`` labelled rows (those of the smallest id hash) for
    which ``use``, a condition on the key, holds."""
    marked = labels.select(key, F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    if use is not None:
        marked = marked.where(use)
    # bounded by ``sample`` rows of two numbers, so it may be broadcast
    few = marked.orderBy(F.xxhash64(key), key, "_y").limit(sample)
    rows = with_features(docs.join(F.broadcast(few.select(key).distinct()), key, "left_semi"), key, text).join(F.broadcast(few), key).select("_y", "x")
    got = rows.toArrow()
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = got.column("_y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever the order of rows
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([b.batch.column(key), pa.array(model.score(features(b)), pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Additive, least: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            yield b.batch.filter(pa.array(model.score(features(b)) >= least))

    return docs.mapInArrow(run, docs.schema)
