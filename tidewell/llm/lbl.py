"""Language-model scores: a log-bilinear model with exact word statistics.

Tokens are the words of the lower-cased text and one end.  The *vocabulary* is
the words that occur ``MIN_COUNT`` times or more in the training text, the most
frequent ones, so it grows with the corpus up to what executors are sent; all
other words fall into ``RARE`` classes by their last letters.  The vocabulary is
cut into classes of one size by what stands next to a word in the corpus.

A context is the ``CONTEXT`` words before; its vector is the sum of their
vectors, each scaled by weights of its distance.  A logit is the inner product
of the context's vector with that of a class, or of a word, plus a bias.  A
token's probability is that of its class among all classes, times, for a word
of the vocabulary, that of the word among those of its class, or, for a rare
word, its share of the class by corpus counts plus one, with one share for all
unseen words.  Both softmaxes are normalised in full, in batched matrix products.

Training is noise contrastive estimation in numpy.  The training documents are
dealt to ``ROUNDS`` rounds, and within a round to parts of about ``PART_TOKENS``
tokens, by a hash of id and text, so the model does not depend on how tables
are split.  Each part goes on from the parameters of the round before; rows of
parameters are averaged by how often each was trained.  Each training token is
gone over once, whatever the size of the corpus; steps are of ``BATCH`` tokens,
few enough for a small corpus to be learnt in that one pass.

The base score is that of add-one unigrams with the same counts.

Null texts are empty: one token, the end.  Without training rows every class is
as likely as any other.  Repeated rows are counted, and scored, each.  Rows with
a null id aren't held out.  Empty tables give empty results; only key and text
are read.

Scale: word counts are pre-aggregated by batch and summed by Spark, all of them.
Executors are sent the model and the counts of at most ``NEAR`` frequent words,
bounds that don't grow; rarer words are joined.  Texts are split into words
twice, once to count and once to encode; training shuffles two bytes a token.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: words with a vector of their own, at most, and how often each must occur
VOCABULARY, MIN_COUNT = 1 << 13, 16
#: classes of all other words
RARE = 64
#: frequent words whose nearness tells classes of words apart
SIGNS = 64
CONTEXT, WIDTH = 4, 16
NOISE, WORD_NOISE, RATE, BATCH = 64, 32, 0.15, 256
ROUNDS, PART_TOKENS = 3, 1 << 21
#: tokens that are trained, or scored, at once
WINDOW = 1 << 17
#: words whose counts are sent to executors, at most
NEAR = 1 << 18
END = -(1 << 62)
#: rows of parameters that are summed together, and parts that one task sums
ROWS, FAN = 1024, 256


def word_class(b: common.Block, w: common.Words) -> np.ndarray:
    """Class of each word by its last two bytes, and whether it has letters beyond ASCII."""
    data = common.ASCII_LOWER[b.data]
    last = data[w.end - 1].astype(np.uint64)
    second = np.where(w.end - w.start > 1, data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    wide = np.r_[0, np.cumsum(data >= 0x80, dtype=np.int32)]
    odd = (wide[w.end] > wide[w.start]).astype(np.uint64)
    return (common.mix(last * np.uint64(1009) + second * np.uint64(7) + odd + np.uint64(1)) % np.uint64(RARE)).astype(np.int64)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word (hash), class and n over all rows; the end is a word of class -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            h, c, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(c[first]), pa.array(np.bincount(inv, n).astype(np.int64))], names=["word", "class", "n"])

        parts, held = [], 0
        for b in common.blocks(batches, text):
            w = common.find_words(b)
            u, first, n = np.unique(w.hash.view(np.int64), return_index=True, return_counts=True)
            parts.append((np.r_[u, END], np.r_[word_class(b, w)[first], -1], np.r_[n, len(b)]))
            held += len(u)
            if held > 1 << 20:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    return docs.select(text).mapInArrow(run, "word long, class long, n long").groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What executors know of the words: counts of frequent ones, the vocabulary among them."""

    near: np.ndarray  # sorted hashes
    near_n: np.ndarray
    near_word: np.ndarray  # number in the vocabulary, by falling count, or -1
    word_n: np.ndarray  # counts of the vocabulary
    total: int
    types: int
    ends: int
    rare_n: np.ndarray  # counts by class of rare words
    share: np.ndarray  # log10 of each rare class's counts plus one, with one for the unseen

    @property
    def words(self) -> int:
        return len(self.word_n)

    @property
    def end(self) -> int:
        """Number of the end, behind the vocabulary and the rare classes."""
        return self.words + RARE


def lexicon(counts: DataFrame) -> Lexicon:
    words = counts.where(F.col("class") >= 0).withColumn("step", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int"))
    # a row for each sixteenth of a power of two: where to stop so that at most NEAR words are above
    steps = sorted(((r["step"], r["k"]) for r in words.groupBy("step").agg(F.count("*").alias("k")).collect()), reverse=True)
    sums = np.cumsum([k for _, k in steps])
    taken = int(np.searchsorted(sums, NEAR, "right"))
    least = steps[taken - 1][0] if taken else 1 << 30
    top = words.where(F.col("step") >= least).select("word", "n", "class").toArrow()  # bounded by NEAR rows
    h, n, c = (top.column(x).to_numpy() for x in ("word", "n", "class"))
    by = np.argsort(h)
    h, n, c = h[by], n[by], c[by]
    lead = np.lexsort((h, -n))
    lead = lead[n[lead] >= MIN_COUNT][:VOCABULARY]
    word = np.full(len(h), -1, np.int32)
    word[lead] = np.arange(len(lead))
    mass, kinds = -np.bincount(c[lead], n[lead], RARE), -np.bincount(c[lead], minlength=RARE).astype(float)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # RARE rows
        mass[r["class"]] += r["n"]
        kinds[r["class"]] += r["k"]
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("class") < 0, F.col("n"))).alias("ends")).first()
    return Lexicon(h, n, word, n[lead].astype(float), int(whole["n"] or 0), int(whole["v"] or 0), int(whole["ends"] or 0), mass, np.log10(mass + kinds + 1))


def encoded(docs: DataFrame, lex: Lexicon, learn_from: Column, key: str, text: str) -> DataFrame:
    """Each row with its units (two bytes each: vocabulary, then rare classes) and all
    that its scores take from word counts."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        for b in common.blocks(batches):
            n, w = len(b), common.find_words(b)
            h = w.hash.view(np.int64)
            unit, count = lex.words + word_class(b, w) if len(h) else np.zeros(0, np.int64), np.zeros(len(h), np.int64)
            if len(lex.near) and len(h):
                at = np.minimum(np.searchsorted(lex.near, h), len(lex.near) - 1)
                hit = lex.near[at] == h
                count = np.where(hit, lex.near_n[at], 0)
                word = np.where(hit, lex.near_word[at], -1)
                unit = np.where(word >= 0, word, unit)
            rare = unit >= lex.words
            plus = np.log10(count + 1.0)
            sums = lambda at, x, n=n: np.bincount(at, x, n).astype(float)  # noqa: E731 - numbers even of nothing
            inner = sums(w.doc[rare], plus[rare] - lex.share[unit[rare] - lex.words])
            far = np.flatnonzero(count == 0)
            tail, times = _pairs(w.doc[far], h[far])
            cut = pa.array(np.searchsorted(tail[0], np.arange(n + 1)).astype(np.int32))
            raw = unit.astype("<u2").tobytes()
            edge = (2 * w.first).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.batch.column(c) for c in ("key", "learns", "place")),
                    pa.array([raw[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                    pa.array(np.diff(w.first) + 1),
                    pa.array((np.bincount(w.doc, count > 0, n) + (lex.ends > 0)).astype(np.int64)),
                    pa.array(sums(w.doc, plus) + np.log10(lex.ends + 1.0)),
                    pa.array(inner),
                    pa.ListArray.from_arrays(cut, pa.array(tail[1])),
                    pa.ListArray.from_arrays(cut, pa.array(times)),
                ],
                names=["key", "learns", "place", "units", "n_tokens", "known", "plus", "inner", "far_words", "far_times"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn_from, F.lit(True)).alias("learns"), F.xxhash64(key, text).alias("place"))
    return rows.mapInArrow(run, f"key {kind}, learns boolean, place long, units binary, n_tokens long, known long, plus double, inner double, far_words array<long>, far_times array<long>")


def _pairs(doc: np.ndarray, word: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (document, word) in order of documents, and how often each occurs."""
    order = np.lexsort((word, doc))
    d, w = doc[order], word[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (w[1:] != w[:-1])]) if len(d) else np.zeros(0, np.int64)
    return (d[new], w[new]), np.diff(np.r_[new, len(d)])


def streams(rows: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of all tokens of some documents, an end behind each, and their documents."""
    sizes = np.array([len(x) // 2 for x in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes + 1)
    unit = np.full(len(doc), end, np.int32)
    inside = np.ones(len(doc), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    unit[inside] = np.frombuffer(b"".join(rows), "<u2")
    return unit, doc


def contexts(unit: np.ndarray, doc: np.ndarray, begin: int) -> np.ndarray:
    """The CONTEXT units before each token; ``begin`` before the first."""
    out = np.full((CONTEXT, len(unit)), begin, np.int32)
    for o in range(1, CONTEXT + 1):
        same = doc[o:] == doc[:-o]
        out[o - 1, o:][same] = unit[:-o][same]
    return out


def windows(unit: np.ndarray, doc: np.ndarray, begin: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The tokens in windows of a bounded size, whatever the length of a document, with contexts."""
    for a in range(0, len(unit), WINDOW):
        z, lead = min(a + WINDOW, len(unit)), max(0, a - CONTEXT)
        yield slice(a, z), contexts(unit[lead:z], doc[lead:z], begin)[:, a - lead :]


def neighbours(rows: DataFrame, lex: Lexicon) -> np.ndarray:
    """How often each word of the vocabulary stands behind, and before, each of the SIGNS."""
    words = lex.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(words * 2 * SIGNS, np.int64)
        for b in batches:
            unit, doc = streams(b.column("units").to_pylist(), words + RARE)
            a, z, same = unit[:-1].astype(np.int64), unit[1:].astype(np.int64), doc[1:] == doc[:-1]
            for word, sign, side in ((z, a, 0), (a, z, SIGNS)):
                ok = same & (sign < SIGNS) & (sign < words) & (word < words)
                sums += np.bincount(word[ok] * 2 * SIGNS + side + sign[ok], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    # bounded: 2 x SIGNS numbers for each word of the vocabulary
    got = rows.select("units").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(words * 2 * SIGNS)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(words, -1)


def word_classes(near: np.ndarray) -> np.ndarray:
    """Class of each word: about as many classes as words in one, of one size, by
    halving at the widest spread of the words' neighbours."""
    x = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1))
    parts = [np.arange(len(x))]
    while len(parts) ** 2 < len(x):
        parts.sort(key=len)
        some = parts.pop()
        y = x[some] - x[some].mean(0)
        axis = np.ones(y.shape[1]) + np.arange(y.shape[1]) / 100
        for _ in range(8):
            axis = y.T @ (y @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order = some[np.argsort(np.round(y @ axis, 9), kind="stable")]
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    out = np.zeros(len(x), np.int64)
    for k, some in enumerate(parts):
        out[some] = k
    return out


class Model:
    """Vectors of context units (the last is the begin), distances, classes and words.

    ``tables`` are the parameters, one row a thing that is trained; ``squares``
    are Adagrad's sums for them.
    """

    def __init__(self, of: np.ndarray, word_n: np.ndarray, rare_n: np.ndarray, ends: int):
        """``of``: the class of each word; counts of words, rare classes and ends."""
        rng = np.random.default_rng(17)
        words, rare = len(of), len(rare_n)
        self.classes = int(of.max()) + 1 if words else 0
        self.first = np.r_[of, self.classes + np.arange(rare + 1)].astype(np.int32)  # class of each unit
        self.end = words + rare
        self.members = [np.flatnonzero(of == c) for c in range(self.classes)]
        self.slot = np.zeros(words, np.int64)
        for m in self.members:
            self.slot[m] = np.arange(len(m))
        freq = np.bincount(self.first, np.r_[word_n, rare_n, ends], self.classes + rare + 1) + 1
        self.noise = freq / freq.sum()
        self.inside = [word_n[m] / word_n[m].sum() for m in self.members]  # noise within a class
        inside = np.concatenate([np.zeros(0), *self.inside])[np.argsort(np.concatenate([np.zeros(0, int), *self.members]))]

        def vectors(n: int, *bias: np.ndarray) -> np.ndarray:
            return np.column_stack([rng.standard_normal((n, WIDTH)) * 0.1, *bias]).astype(np.float32)

        self.context, self.distance = vectors(self.end + 1), np.ones((CONTEXT, WIDTH), np.float32) / CONTEXT
        # the last column is the bias; a context's vector ends in a one
        self.unit, self.word = vectors(len(freq), np.log(self.noise)), vectors(words, np.log(inside))
        self.tables = [self.context, self.distance, self.unit, self.word]
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in self.tables]

    def copy(self) -> Model:
        """Parameters of its own; what follows from counts is shared."""
        out = copy.copy(self)
        out.tables, out.squares = [p.copy() for p in self.tables], [s.copy() for s in self.squares]
        out.context, out.distance, out.unit, out.word = out.tables
        return out

    def vectors(self, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of contexts, and the rows that they are made of."""
        rows = self.context.take(ctx, 0)
        h = np.ones((ctx.shape[1], WIDTH + 1), np.float32)
        np.einsum("oni,oi->ni", rows, self.distance, out=h[:, :WIDTH])
        return h, rows

    def log10(self, unit: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Normalised log-probabilities of classes, times those of words in them."""
        out, h = np.empty(len(unit)), np.empty((len(unit), WIDTH + 1), np.float32)
        own = self.first[unit]
        for a in range(0, len(unit), 4096):
            h[a : a + 4096] = self.vectors(ctx[:, a : a + 4096])[0]
            out[a : a + 4096] = _log_softmax(h[a : a + 4096], self.unit, own[a : a + 4096])
        known = np.flatnonzero(unit < len(self.slot))
        known = known[np.argsort(own[known], kind="stable")]
        edge = np.searchsorted(own[known], np.arange(self.classes + 1))
        for c, m in enumerate(self.members):
            at = known[edge[c] : edge[c + 1]]
            if len(at):
                out[at] += _log_softmax(h[at], self.word[m], self.slot[unit[at]])
        return out / np.log(10)

    def _step(self, k: int, row: np.ndarray, g: np.ndarray, n: int, rate: float) -> None:
        """Adagrad on the rows of a table that have a gradient; rows may repeat."""
        row = row.astype(np.uint16) if len(self.tables[k]) < 1 << 16 else row
        order = row.argsort(kind="stable")
        row = row[order]
        new = np.ones(len(row), bool)
        np.not_equal(row[1:], row[:-1], out=new[1:])
        new = new.nonzero()[0]
        row = row[new]
        g = np.add.reduceat(g.take(order, 0), new, axis=0)
        self._adagrad(k, row, g, n, rate)

    def _adagrad(self, k: int, row: np.ndarray, g: np.ndarray, n: int, rate: float) -> None:
        """The step itself: rows of a table, each once, and their gradients over ``n`` tokens."""
        g /= np.float32(n)
        s = self.squares[k].take(row, 0)
        s += g * g
        self.squares[k][row] = s
        g *= np.float32(rate)
        g /= np.sqrt(s, out=s)
        g += self.tables[k].take(row, 0)
        self.tables[k][row] = g

    def train(self, unit: np.ndarray, ctx: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """A pass of noise contrastive estimation over tokens in random order: classes
        with their contexts, then words among the others of their class."""
        own, order = self.first[unit], rng.permutation(len(unit))
        mixed, mixed_ctx = own[order], ctx[:, order]
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        drawn = rng.choice(len(self.noise), size=(len(unit) // BATCH + 1, NOISE), p=self.noise)
        for k, a in enumerate(range(0, len(order), BATCH)):
            w, c, x = mixed[a : a + BATCH], mixed_ctx[:, a : a + BATCH], drawn[k]
            n = len(w)
            h, rows = self.vectors(c)
            up, down, of_w, of_x = _contrast(h, self.unit, log_noise, w, x)
            dh = (up * of_w + down @ of_x)[:, :WIDTH]
            near, far = (dh * self.distance[:, None]).reshape(-1, WIDTH), np.einsum("oni,ni->oi", rows, dh)
            self._step(2, np.concatenate([w, x]), np.concatenate([up * h, down.T @ h]), n, rate)
            self._step(0, c.ravel(), near, n, rate)
            self._adagrad(1, np.arange(CONTEXT), far, n, rate)
        known = np.flatnonzero(unit < len(self.slot))
        known = known[np.argsort(own[known], kind="stable")]
        edge = np.searchsorted(own[known], np.arange(self.classes + 1))
        for c, (m, q) in enumerate(zip(self.members, self.inside, strict=True)):
            at = known[edge[c] : edge[c + 1]]
            if len(m) < 2 or not len(at):
                continue
            log_noise = np.log(WORD_NOISE * q).astype(np.float32)
            drawn = rng.choice(len(m), size=(len(at) // BATCH + 1, WORD_NOISE), p=q)
            for k, a in enumerate(range(0, len(at), BATCH)):
                w, x = self.slot[unit[at[a : a + BATCH]]], drawn[k]
                h, _ = self.vectors(ctx[:, at[a : a + BATCH]])
                up, down, _, _ = _contrast(h, self.word[m], log_noise, w, x)
                self._step(3, m[np.concatenate([w, x])], np.concatenate([up * h, down.T @ h]), len(w), rate)


def _contrast(h: np.ndarray, vector: np.ndarray, log_noise: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the logits of data (towards it) and of noise (away from it), and
    the vectors of both."""
    of_w, of_x = vector.take(w, 0), vector.take(x, 0)
    up = 1 / (1 + np.exp(np.einsum("ni,ni->n", h, of_w) - log_noise[w]))
    down = log_noise[x] - h @ of_x.T
    np.exp(down, out=down)
    down += 1
    np.divide(-1, down, out=down)
    return up[:, None], down, of_w, of_x


def _log_softmax(h: np.ndarray, vector: np.ndarray, own: np.ndarray) -> np.ndarray:
    z = h @ vector.T
    # logits within this bound can't overflow, so the largest needn't be sought
    if (np.einsum("ni,ni->n", h, h).max() * np.einsum("ni,ni->n", vector, vector).max()) > 3600:
        z -= z.max(1, keepdims=True)
    out = z[np.arange(len(z)), own].astype(np.float64)
    np.exp(z, out=z)
    return out - np.log(z @ np.ones(z.shape[1], np.float32))


def _weights(model: Model, unit: np.ndarray, ctx: np.ndarray) -> list[np.ndarray]:
    """How often each row of the tables is trained by some tokens; noise counts as one."""
    classes = np.bincount(model.first[unit], minlength=len(model.unit)) + 1.0
    words = np.bincount(unit[unit < len(model.slot)], minlength=len(model.slot)) + 1.0
    return [np.bincount(ctx.ravel(), minlength=len(model.context)).astype(float), np.full(CONTEXT, float(len(unit))), classes, words]


_SUMS = "of int, at int, part long, weight binary, body binary"


def _packed(model: Model, weights: list[np.ndarray], part: int) -> pa.RecordBatch:
    """The tables times their weights, in rows of a bounded size."""
    out = []
    for k, (p, s, w) in enumerate(zip(model.tables, model.squares, weights, strict=True)):
        body = (np.concatenate([p, s], axis=1) * w[:, None]).astype(np.float32)
        for a in range(0, len(w), ROWS):
            out.append((k, a // ROWS, part, w[a : a + ROWS].tobytes(), body[a : a + ROWS].tobytes()))
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["of", "at", "part", "weight", "body"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums in order of parts, so that they don't depend on the order of arrival."""
    rows = rows.sort_values("part")
    weight = sum(np.frombuffer(x) for x in rows["weight"])
    body = sum(np.frombuffer(x, np.float32).astype(float) for x in rows["body"]).astype(np.float32)
    return pd.DataFrame({"of": rows["of"].iloc[:1], "at": rows["at"].iloc[:1], "part": [int(rows["part"].iloc[0]) // FAN], "weight": [weight.tobytes()], "body": [body.tobytes()]})


def fit(rows: DataFrame, lex: Lexicon) -> Model:
    """The model for the encoded rows that learn: rounds over all of them, each row in one."""
    spark = rows.sparkSession
    training = rows.where("learns").select("place", "units")
    of = word_classes(neighbours(training, lex)) if lex.words else np.zeros(0, np.int64)
    model = Model(of, lex.word_n, lex.rare_n, lex.ends)
    mine = -(-lex.total // ROUNDS)  # tokens of a round
    parts = max(1, -(-mine // PART_TOKENS))
    dealt = training.withColumn("round", F.pmod("place", F.lit(ROUNDS))).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(parts)))
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], k=k, sent=sent, rate=RATE if k < ROUNDS - 1 else RATE / 2) -> Iterator[pa.RecordBatch]:
            for part, rows in _by_part(batches):
                own = sent.value.copy()
                weights = [np.zeros(len(p)) for p in own.tables]
                rng = np.random.default_rng((k, part))
                for some in rows:
                    unit, doc = streams(some, own.end)
                    for at, ctx in windows(unit, doc, own.end):
                        own.train(unit[at], ctx, rng, rate)
                        weights = [a + b for a, b in zip(weights, _weights(own, unit[at], ctx), strict=True)]
                yield _packed(own, weights, part)

        now = dealt.where(F.col("round") == k).repartition(parts, "part").sortWithinPartitions("part", "place")
        sums, left = now.select("part", "units").mapInArrow(run, _SUMS), parts
        while True:
            sums = sums.groupBy("of", "at", F.floor(F.col("part") / FAN)).applyInPandas(_summed, _SUMS)
            left = -(-left // FAN)
            if left == 1:
                break
        model = model.copy()
        for r in sums.collect():  # the model, in rows of a bounded size
            table, square = model.tables[r["of"]], model.squares[r["of"]]
            some = slice(r["at"] * ROWS, r["at"] * ROWS + ROWS)
            weight = np.frombuffer(r["weight"])
            mean = np.frombuffer(r["body"], np.float32).reshape(len(weight), -1) / np.maximum(weight, 1e-300)[:, None]
            new = weight > 0  # what was not trained stays
            table[some][new], square[some][new] = mean[new, : table.shape[1]], mean[new, table.shape[1] :]
    return model


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[bytes]]]]:
    """Rows that are sorted by part, each part's in lists of about WINDOW tokens,
    whatever the batches are."""
    rows = ((p, u) for b in batches for p, u in zip(b.column("part").to_pylist(), b.column("units").to_pylist(), strict=True))
    for part, mine in itertools.groupby(rows, key=lambda r: r[0]):

        def lists(mine=mine) -> Iterator[list[bytes]]:
            some, held = [], 0
            for _, u in mine:
                some.append(u)
                held += len(u) // 2 + 1
                if held >= WINDOW:
                    yield some
                    some, held = [], 0
            if some:
                yield some

        yield part, lists()


def scores(docs: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row;
    ``learn_from``, a condition on the key, picks the training rows."""
    spark = docs.sparkSession
    counts = common.staged(word_counts(docs.where(F.coalesce(learn_from, F.lit(True))), text), "word-counts")
    lex = lexicon(counts)
    rows = common.staged(encoded(docs, lex, learn_from, key, text).withColumn("uid", F.monotonically_increasing_id()), "encoded")
    sent = spark.sparkContext.broadcast(fit(rows, lex))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            unit, doc = streams(b.column("units").to_pylist(), model.end)
            out = b.column("inner").to_numpy(zero_copy_only=False).copy()
            for at, ctx in windows(unit, doc, model.end):
                out += np.bincount(doc[at], model.log10(unit[at], ctx), len(out))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "key", "n_tokens", "known", "plus")), pa.array(out)], names=["uid", "key", "n_tokens", "known", "plus", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = rows.select("uid", "key", "n_tokens", "known", "plus", "units", "inner").mapInArrow(run, f"uid long, key {kind}, n_tokens long, known long, plus double, score double")
    # words beyond those whose counts were sent; those not in the counts add nothing
    far = rows.select("uid", F.explode(F.arrays_zip("far_words", "far_times")).alias("f")).select("uid", F.col("f.far_words").alias("word"), F.col("f.far_times").alias("times"))
    more = far.join(counts.select("word", "n"), "word").groupBy("uid").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = F.lit(0.0)
    return scored.join(more, "uid", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("plus") + F.coalesce("more", zero) - F.col("n_tokens") * float(np.log10(lex.total + lex.types + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )
