"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find the entities (e-mail addresses, IP addresses, card and phone
numbers).  Then the corpus itself says which words disclose them.  For a word t
near an entity e, ``P(e|t)`` is the share of all of t's occurrences that stand
within ``WINDOW`` words of e, ``IC(e) = -log2 P(e)`` is the entity's information
and ``PMI(e;t) = log2 P(e|t)/P(e)`` the part of it that t carries.  The
disclosure ``PMI/IC`` is 1 where t always stands by e.  Words above
``GENERALISE`` are generalised wherever they occur, to the kind of entity that
they are tied to (``[EMAIL TERM]``), those above ``REMOVE`` go.  An estimate needs ``SUPPORT`` different surroundings, so copies of one
document don't make evidence.

Null texts are empty and have no spans.  Offsets are code points, ends are
exclusive.  Documents with a null id get term spans like others; rows that share
an id, or have none, share term spans only if their texts are equal.  Repeated
rows have equal spans.  Empty tables give empty results; columns beyond key and
text, whatever their names, pass through :func:`sanitise` untouched.

Scale: three scans.  Shuffled are the words around entities, counts of candidate
words, and places of disclosing words, never texts (but by :func:`sanitise`, once,
by id and text, in Arrow batches).  Executors get a Bloom filter of 1 to 32 MB;
exact joins follow, salted, as one term may have many places.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 5
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
#: a Bloom filter has 16 bits a term, within these bounds
BLOOM_BITS, BLOOM_MOST = 1 << 23, 1 << 28

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS = re.compile(r"[@+0-9]")

#: what separates terms: ASCII that is no letter or digit
_NOT_TERM = np.ones(256, bool)
_NOT_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each ``@``, in time linear in the text: names hold no ``@``."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """A run of dotted numbers has a match for each four of its parts."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of all entities, in order."""
    if not _HAS.search(text):
        return []
    out = [(a, z, 0) for a, z in _emails(text)] + [(a, z, 1) for a, z in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def canonical(kind: int, value: str) -> str:
    """One spelling for each entity."""
    return f"{KINDS[kind]}:" + (re.sub(r"[^0-9+]", "", value) if kind > 1 else value.lower())


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{z}" for a, z, k in spans])


def _doc_texts(b: common.Block) -> Iterator[tuple[int, str]]:
    raw = b.data.tobytes()
    for i in range(len(b)):
        yield i, raw[b.offsets[i] : b.offsets[i + 1]].decode()


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _key_type(docs: DataFrame, key: str) -> str:
    return docs.schema[key].dataType.simpleString()


def near_entities(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """entity, term, around: see :func:`surroundings`."""
    for b in common.blocks(batches, text):
        entity, term, around = [], [], []
        words = None
        for i, t in _doc_texts(b):
            found = base_spans(t)
            if not found:
                continue
            words = words or common.find_words(b, is_space=_NOT_TERM)
            lo, hi = words.first[i], words.first[i + 1]
            start, end, h = words.start[lo:hi] - b.offsets[i], words.end[lo:hi] - b.offsets[i], words.hash[lo:hi]
            raw = b.data[b.offsets[i] : b.offsets[i + 1]]
            byte_of = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # of each code point
            free = np.ones(len(h), bool)
            places = [(int(byte_of[a]), int(byte_of[z])) for a, z, _ in found]
            for a, z in places:
                free[np.searchsorted(end, a, "right") : np.searchsorted(start, z, "left")] = False
            free = np.flatnonzero(free)
            begins, ends = start[free], end[free]
            for (a, z), (ca, cz, kind) in zip(places, found, strict=True):
                last, first = np.searchsorted(ends, a, "right"), np.searchsorted(begins, z, "left")
                near = np.r_[free[max(0, last - WINDOW) : last], free[first : first + WINDOW]]
                ctx = int.from_bytes(hashlib.blake2b(h[near].tobytes(), digest_size=8).digest(), "little", signed=True)
                here = np.unique(_signed(h[near])).tolist()
                e = canonical(kind, t[ca:cz])
                entity += [e] * (len(here) + 1)
                term += [None, *here]  # a row without a term counts the mention
                around += [ctx] * (len(here) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(entity, pa.string()), pa.array(term, pa.int64()), pa.array(around, pa.int64())], names=["entity", "term", "around"])


def surroundings(docs: DataFrame, text: str) -> DataFrame:
    """A row for each entity and each term near it: entity, term, hash of the surroundings."""
    return docs.select(text).mapInArrow(lambda batches: near_entities(batches, text), "entity string, term long, around long")


def bloom(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``term``, of a bounded size."""
    n = terms.count()
    size = BLOOM_BITS
    while size < min(16 * n, BLOOM_MOST):
        size *= 2
    lane = lambda k: F.pmod(F.shiftrightunsigned("term", 32 * k), F.lit(size)).cast("long")
    bits = terms.select(F.explode(F.array(lane(0), lane(1))).alias("bit"))
    rows = bits.groupBy((F.col("bit") / 32).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("mask")).toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().astype(np.uint32)
    return out


def _may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for k in (0, 1):
        bit = ((h >> np.uint64(32 * k)) & np.uint64(32 * len(filter_) - 1)).astype(np.int64)
        ok &= (filter_[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1
    return ok


def disclosing_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term (its hash), the highest disclosure it makes of any entity, and that entity's kind."""
    spark = docs.sparkSession
    near = common.staged(surroundings(docs, text), "near")
    mentions = near.where("term IS NULL").groupBy("entity").agg(F.count("*").alias("n_e"))
    pairs = near.where("term IS NOT NULL").groupBy("entity", "term", "around").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("ways"))
    likely = common.staged(pairs.where(F.col("ways") >= SUPPORT), "likely-terms")
    filter_ = spark.sparkContext.broadcast(bloom(likely.select("term").distinct()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            h = common.find_words(b, is_space=_NOT_TERM).hash
            u, n = np.unique(h[_may_hold(filter_.value, h)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([None, *_signed(u).tolist()], pa.int64()), pa.array([len(h), *n.tolist()], pa.int64())], names=["term", "n"])

    counts = common.staged(docs.select(key, text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    # one row: the number of words
    total = float((counts.where("term IS NULL").agg(F.max("n")).first() or [0])[0] or 1)
    whole = likely.join(mentions, "entity").join(counts.where("term IS NOT NULL").withColumnRenamed("n", "n_t"), "term")
    p_given = F.least(F.col("n_et") / F.greatest("n_t", "n_et"), F.lit(1.0))
    info = F.log2(F.lit(total) / F.col("n_e"))
    most = whole.where(info > 0).select("term", F.struct((1 + F.log2(p_given) / info).alias("disclosure"), F.substring_index("entity", ":", 1).alias("kind")).alias("of"))
    return most.groupBy("term").agg(F.max("of").alias("of")).select("term", "of.disclosure", "of.kind").where(F.col("disclosure") >= GENERALISE)


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))


def term_places(marked: DataFrame, terms: DataFrame) -> DataFrame:
    """id, mark (of the text) and the sorted places of disclosing terms in it."""
    filter_ = marked.sparkSession.sparkContext.broadcast(bloom(terms.select("term")))
    kind = _key_type(marked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            w = common.find_words(b, is_space=_NOT_TERM)
            hit = np.flatnonzero(_may_hold(filter_.value, w.hash))
            # code points before each byte: bytes that don't continue one
            chars = np.r_[0, np.cumsum((b.data & 0xC0) != 0x80, dtype=np.int32)]
            first = chars[b.offsets[w.doc[hit]]]
            rows = b.batch.select(["id", "mark"]).take(pa.array(w.doc[hit]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("mark"), pa.array(_signed(w.hash[hit])), pa.array((chars[w.start[hit]] - first).astype(np.int64)), pa.array((chars[w.end[hit]] - first).astype(np.int64))],
                names=["id", "mark", "term", "start", "end"],
            )

    places = marked.mapInArrow(run, f"id {kind}, mark long, term long, start long, end long")
    found = common.join_salted(places, terms, ["term"], ["id", "mark", "start"])
    return found.groupBy("id", "mark").agg(F.sort_array(F.collect_set(F.struct("start", "end", "disclosure", "kind"))).alias("places"))


def _with_terms(base: list[tuple[int, int, int]], places: list[dict] | None) -> list[tuple[int, int, int]]:
    """Base spans, and term spans that touch none of them."""
    out = list(base)
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((z for _, z, _ in base), max))
    for p in places or ():
        i = bisect.bisect_left(starts, p["end"])
        if not i or reach[i - 1] <= p["start"]:
            out.append((p["start"], p["end"], 4))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _joined(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` (id, mark, ...) with their places, null where they have none."""
    right = places.select(F.col("id").alias("id_"), F.col("mark").alias("mark_"), "places").hint("shuffle_hash")
    return rows.join(right, F.col("id").eqNullSafe(F.col("id_")) & (F.col("mark") == F.col("mark_")), "left").drop("id_", "mark_")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the numbers of base spans by kind, base spans and all spans as text."""
    kind = _key_type(docs, key)
    names = ["n_email", "n_ip", "n_card", "n_phone"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [base_spans(t.decode()) for t in common.texts(b)]
            counts = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), *counts, pa.array(map(spans_text, found), pa.string())], names=["id", "mark", *names, "base"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, places in zip(b.column("base").to_pylist(), b.column("places").to_pylist(), strict=True):
                if places:
                    cut = [s.split(":") for s in base.split(",") if s]
                    base = spans_text(_with_terms([(int(a), int(z), KINDS.index(k)) for k, a, z in cut], places))
                out.append(base)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", *names, "base")), pa.array(out, pa.string())], names=[key, *names, "base", "spans"])

    longs = ", ".join(f"{n} long" for n in names)
    terms = common.staged(disclosing_terms(docs, key, text), "terms")
    marked = _marked(docs, key, text)
    base = marked.mapInArrow(find, f"id {kind}, mark long, {longs}, base string")
    joined = _joined(base, term_places(marked, terms)).select("id", *names, "base", "places")
    return joined.mapInArrow(merge, f"{key} {kind}, {longs}, base string, spans string")


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with entities replaced by their kind, disclosing terms by the kind that
    they are tied to or, where they disclose nearly all, by nothing.  Null texts stay."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if t:
                    of = {(p["start"], p["end"]): "" if p["disclosure"] >= REMOVE else f"[{p['kind'].upper()} TERM]" for p in places or ()}
                    parts, done = [], 0
                    for a, z, k in _with_terms(base_spans(t), places):
                        if a >= done:
                            parts += [t[done:a], of[a, z] if k == 4 else f"[{KINDS[k].upper()}]"]
                        done = max(done, z)
                    t = "".join([*parts, t[done:]]) if parts else t
                out.append(t)
            cols = b.column("row").flatten()
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    terms = common.staged(disclosing_terms(docs, key, text), "terms")
    # the whole row as one column: no name of it can clash
    whole = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("body"), F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"))
    found = term_places(_marked(docs, key, text), terms)
    return _joined(whole, found).select("id", "mark", "body", "places", "row").mapInArrow(run, docs.schema)
