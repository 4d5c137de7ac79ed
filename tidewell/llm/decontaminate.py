"""Benchmark decontamination: a BM25 index of test items, queried by all training text.

The items are the indexed collection; every training passage is a query.  A
passage is two neighbouring segments of as many words as the longest item has,
so each run of that many words lies in one.  An item's impacts are divided by
the score it has for its own text, so one threshold serves all items.  Items
are cut into blocks; a passage's bound for a block is the sum of its terms'
largest impacts there.  Blocks whose bound stays under the threshold are
skipped, the others are walked by WAND: posting lists in item order, a pivot
where the bounds of the lists before it add up to the threshold, scores only
for items that all those lists have reached.  What is retrieved is verified:
both the item's question and its answer must have enough of their word n-grams
in the document, or, as one changed word costs up to five n-grams, enough of
their words in order, the question's before the answer's, in a passage about as
long as the item (parts of at most ``LONG`` words).

Null and empty texts hold nothing and are clean; empty items, and items that
are null, match nothing; an empty benchmark leaves all documents clean.  Ties
and repeated rows are treated alike: each row is judged by its own text, and
items with equal texts are all reported.  Extra columns pass through
:func:`clean` untouched.

Scale: the index is the only thing sent to executors.  Items are dealt to
shards of at most ``SHARD_CHARS`` characters, one scan each, so what is sent
has a bound whatever the benchmark.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common
from tidewell.llm.pii import _NOT_TERM

K1, B = 1.2, 0.75
#: share of an item's own score that a passage must reach
THRESHOLD = 0.5
#: n-grams of the question and of the answer that the document must hold
GRAM, OVERLAP = 5, 0.6
#: a passage that is compared in order has so many words for one of the item, and this many
SPAN, SPARE = 1.25, 4
#: parts of more words are verified by their n-grams alone, which a few changed words leave
LONG = 200
BLOCKS = 64
#: an item is at least this long as far as segments go
MIN_SEGMENT = 32
SHARD_CHARS = 8 << 20

_SAME = np.arange(256, dtype=np.uint8)


def folded_words(b: common.Block) -> common.Words:
    """Runs of letters and digits, lower-cased (ASCII and Latin-1)."""
    data = common.ASCII_LOWER[b.data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[second] += 0x20
    return common.find_words(b, _SAME, _NOT_TERM, data)


def _grams(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the word n-grams; of all words together if there are fewer."""
    n = min(n, len(words))
    if n == 0:
        return np.zeros(0, np.uint64)
    k = len(words) - n + 1
    h = words[:k].copy()
    for j in range(1, n):
        h = common.mix(h * np.uint64(5)) + words[j : j + k]
    return common.mix(h + np.uint64(n))


def question_length(text: str, n_words: int) -> int:
    """How many of an item's words are its question: all but the last sentence,
    or, if that leaves less than three words on a side, two thirds."""
    cut = max((text.rstrip(" \t\r\n.!?").rfind(c) for c in ".!?\n"), default=-1)
    if cut >= 0:
        head = common.Block(np.frombuffer(text[: cut + 1].encode(), np.uint8), np.array([0, len(text[: cut + 1].encode())]), None)
        n = len(folded_words(head).hash)
        if min(n, n_words - n) >= 3:
            return n
    return max(1, round(n_words * 2 / 3)) if n_words > 1 else n_words


@dataclass
class Index:
    """Postings by term in item order, with the largest impact of each block."""

    item_ids: np.ndarray
    terms: np.ndarray  # sorted hashes
    starts: np.ndarray  # postings of term t: starts[t] to starts[t + 1]
    items: np.ndarray
    impact: np.ndarray
    block_of: np.ndarray  # of an item
    block_max: np.ndarray  # term x block
    segment: int
    question: list[tuple[int, np.ndarray]]  # words in its n-grams, and their hashes
    answer: list[tuple[int, np.ndarray]]
    words: list[np.ndarray]
    n_question: list[int]  # of the words
    maybe: np.ndarray  # whether some term has these low bits


def build(items: list[tuple[int, str]]) -> Index | None:
    """The index of some items; None if none has a word."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())})
    ids, docs, question, answer, n_question = [], [], [], [], []
    for b in common.blocks(iter([batch])):
        w = folded_words(b)
        raw = b.data.tobytes()
        for k in range(len(b)):
            h = w.hash[w.first[k] : w.first[k + 1]]
            if len(h):
                n = question_length(raw[b.offsets[k] : b.offsets[k + 1]].decode(), len(h))
                ids.append(b.batch.column("doc_id")[k].as_py())
                docs.append(h)
                n_question.append(n)
                # n-grams at the seam belong to neither side
                question.append((min(GRAM, n), np.unique(_grams(h[:n]))))
                answer.append((min(GRAM, len(h) - n), np.unique(_grams(h[n:]))))
    if not docs:
        return None
    # neighbours share a block; alike ones (by their smallest words) make tight blocks
    order = sorted(range(len(docs)), key=lambda i: (len(docs[i]) // 8, int(docs[i].min()), ids[i]))
    ids, docs, question, answer, n_question = ([x[i] for i in order] for x in (ids, docs, question, answer, n_question))
    length = np.array([len(d) for d in docs], float)
    n = len(docs)
    who = np.repeat(np.arange(n), length.astype(int))
    pairs, tf = np.unique(np.stack([np.concatenate(docs), who.astype(np.uint64)], 1), axis=0, return_counts=True)
    terms, where, df = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
    item = pairs[:, 1].astype(np.int64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    raw_impact = idf[where] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / length.mean()))
    impact = raw_impact / np.bincount(item, raw_impact, n)[item]
    blocks = min(BLOCKS, n)
    block_of = np.arange(n) * blocks // n
    block_max = np.zeros((len(terms), blocks), np.float32)
    np.maximum.at(block_max, (where, block_of[item]), impact.astype(np.float32) * np.float32(1 + 1e-6))
    maybe = np.zeros(1 << 16, bool)
    maybe[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Index(np.array(ids), terms, np.r_[0, np.cumsum(df)], item, impact, block_of, block_max, int(max(length.max(), MIN_SEGMENT)), question, answer, docs, n_question, maybe)


def _wand(ix: Index, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
    """Items of a block whose score for the terms reaches the threshold."""
    lists = []  # [item at the cursor, cursor, end, bound of the list in this block]
    for t in terms.tolist():
        lo, hi = ix.starts[t], ix.starts[t + 1]
        own = ix.block_of[ix.items[lo:hi]]
        a, z = lo + np.searchsorted(own, block, "left"), lo + np.searchsorted(own, block, "right")
        if a < z:
            lists.append([int(ix.items[a]), int(a), int(z), float(ix.block_max[t, block])])
    out = []
    while lists:
        lists.sort()
        total, pivot = 0.0, None
        for x in lists:
            total += x[3]
            if total >= threshold:
                pivot = x[0]
                break
        if pivot is None:
            break
        if lists[0][0] == pivot:
            score = sum(float(ix.impact[x[1]]) for x in lists if x[0] == pivot)
            if score >= threshold:
                out.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for x in lists:
            if x[0] < target:
                x[1] = x[1] + int(np.searchsorted(ix.items[x[1] : x[2]], target))
                x[0] = int(ix.items[x[1]]) if x[1] < x[2] else -1
        lists = [x for x in lists if x[0] >= 0]
    return out


def _common(part: np.ndarray, passage: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a part and each prefix of a passage."""
    best = np.zeros(len(passage) + 1, np.int64)
    for word in part:
        best[1:] = np.maximum.accumulate(np.where(passage == word, best[:-1] + 1, best[1:]))
    return best


def in_order(q: np.ndarray, a: np.ndarray, words: np.ndarray) -> tuple[float, float]:
    """Shares of the question's and the answer's words that stand in order, the answer's
    after the question's, in that stretch of the words where the smaller one is largest."""
    item = np.r_[q, a]
    n = min(len(words), int(SPAN * len(item)) + SPARE)
    held = np.r_[0, np.cumsum(np.isin(words, item))]
    best = (0.0, 0.0)
    step = max(1, (n - len(item)) // 2)
    for at in sorted({*range(0, len(words) - n, step), len(words) - n}):
        if held[at + n] - held[at] < OVERLAP * len(item):
            continue
        some = words[at : at + n]
        before = _common(q, some) / len(q)
        after = _common(a[::-1], some[::-1])[::-1] / len(a) if len(a) else np.ones(n + 1)
        cut = int(np.minimum(before, after).argmax())
        best = max(best, (float(before[cut]), float(after[cut])), key=min)
    return best


def matches(ix: Index, b: common.Block, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """(row in the block, item id, score, question overlap, answer overlap) of what is verified."""
    w = folded_words(b)
    if not len(w.hash):
        return []
    at = np.flatnonzero(ix.maybe[(w.hash & np.uint64(0xFFFF)).astype(np.int64)])
    term = np.minimum(np.searchsorted(ix.terms, w.hash[at]), len(ix.terms) - 1)
    real = ix.terms[term] == w.hash[at]
    at, term = at[real], term[real]
    if not len(at):
        return []
    segments = -(-np.diff(w.first) // ix.segment)
    base = np.r_[0, np.cumsum(segments)]
    doc = w.doc[at]
    seg = base[doc] + (at - w.first[doc]) // ix.segment
    n_terms = len(ix.terms)
    once = np.unique(seg * n_terms + term)
    seg, term = once // n_terms, once % n_terms
    bounds = np.zeros((base[-1] + 1, ix.block_max.shape[1]), np.float32)
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    bounds[seg[starts]] = np.add.reduceat(ix.block_max[term], starts, axis=0)
    doc_of = np.repeat(np.arange(len(b)), segments)
    passage = bounds[:-1].copy()
    passage[:-1][doc_of[1:] == doc_of[:-1]] += bounds[1:-1][doc_of[1:] == doc_of[:-1]]
    found: dict[tuple[int, int], float] = {}
    where: dict[tuple[int, int], list[int]] = {}  # first words of the passages
    edge = np.r_[starts, len(seg)]
    of_seg = {int(seg[a]): term[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)} if (passage >= threshold).any() else {}
    for s in np.flatnonzero((passage >= threshold).any(1)).tolist():
        d = int(doc_of[s])
        mine = of_seg.get(s, term[:0])
        if s + 1 < len(doc_of) and doc_of[s + 1] == d:
            mine = np.union1d(mine, of_seg.get(s + 1, term[:0]))
        exact = ix.block_max[mine].sum(0)  # each term once now
        for block in np.flatnonzero((passage[s] >= threshold) & (exact >= threshold)).tolist():
            for item, score in _wand(ix, mine, block, threshold):
                found[d, item] = max(score, found.get((d, item), 0.0))
                where.setdefault((d, item), []).append(int(s - base[d]) * ix.segment)
    out = []
    grams: dict[tuple[int, int], np.ndarray] = {}
    for (d, item), score in sorted(found.items()):
        words = w.hash[w.first[d] : w.first[d + 1]]

        def share(part: tuple[int, np.ndarray], d: int = d, words: np.ndarray = words) -> float:
            n, wanted = part
            if not len(wanted):
                return 1.0
            if (d, n) not in grams:
                grams[d, n] = np.unique(_grams(words, n)) if len(words) >= n else np.zeros(0, np.uint64)
            return float(np.isin(wanted, grams[d, n], assume_unique=True).mean())

        q, a = share(ix.question[item]), share(ix.answer[item])
        if q < overlap or a < overlap:
            item_words, n = ix.words[item], ix.n_question[item]
            near_q, near_a = item_words[max(0, n - LONG) : n], item_words[n : n + LONG]
            spare = int(SPAN * len(item_words)) + SPARE  # edits may have made it longer than a passage
            for at in where[d, item]:
                x, y = in_order(near_q, near_a, words[max(0, at - spare) : at + 2 * ix.segment + spare])
                x, y = q if n > LONG else x, a if len(item_words) - n > LONG else y
                if x >= overlap and y >= overlap:
                    q, a = x, y
                    break
        if q >= overlap and a >= overlap:
            out.append((d, int(ix.item_ids[item]), score, q, a))
    return out


def shards(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Items in lists of at most about ``SHARD_CHARS`` characters."""
    some = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    total = some.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // SHARD_CHARS) + 1
    for k in range(n):
        # bounded: a shard's texts have about SHARD_CHARS characters
        rows = some.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield sorted((r["id"], r["text"]) for r in rows)


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and each test item that it holds."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for ix in filter(None, map(build, shards(items, item_key, item_text))):
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches, text):
                rows = matches(sent.value, b)
                cols = [pa.array(c) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), *[pa.float64()] * 3)]
                yield pa.RecordBatch.from_arrays([b.batch.column(key).take(cols[0]), *cols[1:]], names=[key, "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    for ix in filter(None, map(build, shards(items, item_key, item_text))):
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches, text):
                keep = np.ones(len(b), bool)
                keep[[r[0] for r in matches(sent.value, b)]] = False
                yield b.batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
