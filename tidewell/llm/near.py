"""Near duplicates: exact n-gram Jaccard join with signature trees.

A document's set is its distinct word shingles, as 64-bit hashes.  Two sets are
linked when ``PERCENT``% of their union is common.  Links are found exactly:

1. Sets with equal digests are one node.
2. Shingles get a global order, the rarest first, from exact counts.  Linked
   sets share one of their first ``n - ceil(0.75 n) + 1`` shingles, so shingles
   that occur once decide most documents, and the others name candidates.
   Counting moves packed 32-bit fingerprints to buckets and only the repeated
   ones back; two shingles with one fingerprint cost a candidate, never a link.
3. Candidates that hang together are a signature tree: its leaves hold some
   ``BLOCK`` sets of like size, neighbours by a hash of their shingles, and every
   node, within a leaf and above, the OR of the bitmaps below, the range of
   sizes, and the most shingles that a set has beyond its bits.
4. Leaves are compared with themselves and the next, and what is linked then is
   joined to components.  A dual traversal goes down from the roots, a level a
   step over all trees: pairs of nodes whose largest possible overlap is too
   small are pruned, and so are pairs that lie in one component as a whole.  The
   pairs of leaves that are left are compared exactly.
5. Links are joined to components.

Null and blank texts have an empty set and are linked with nothing.  Texts of
fewer words than a shingle have one, of all their words.  Rows with a null id
are linked like others, but never name a component; rows that repeat an id are
judged each by its own text.  Equal texts are copies and share a component.
Empty tables give empty results; other columns are not read.

Scale: a third of all rows may be copies of one text: they meet in one digest by
pre-aggregation, and joins on a digest or a root are salted.  Fingerprints go to
their buckets in as many shuffles as it takes to write at most ``WAYS`` rows for
each chunk of ``CHUNK``.  A group of near copies of m texts costs m/64 comparisons
of leaves where these link it, and only what stays apart is compared further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm import common
from tidewell.llm.components import connected

WORDS, PERCENT = 5, 75
#: shingles that one packed chunk holds, and that one bucket gets, at most about
CHUNK, BUCKET = 1 << 19, 1 << 20
#: rows that a chunk is cut into by one shuffle, at least (on few data) and at most
LEAST_WAYS, WAYS = 32, 256
GROUP = 512  # documents of a chunk that are decided together
#: sets of a leaf, about; children of a node above leaves; steps in the order of neighbours
BLOCK, FAN, STEPS = 64, 8, 1024
#: nodes of a level that are sent to all executors, at most: 700 bytes each
FEW_NODES = 1 << 14
BITS = 4096
LEAF = 8


def shingles(b: common.Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a block, in this order."""
    w = common.find_words(b)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    per = np.diff(w.first)
    h = w.hash.copy()
    last = np.arange(n)
    stop = w.first[w.doc + 1] - 1
    for j in range(1, words):  # the sequence of the next words, as far as the document goes
        more = last + 1 <= stop
        last = last + more
        h = np.where(more, common.mix(h * np.uint64(3) + w.hash[last]), h)
    k = np.arange(n) - w.first[w.doc]
    real = np.where(per[w.doc] >= words, k <= per[w.doc] - words, k == 0)
    doc, h = w.doc[real], common.mix(h[real] + np.minimum(per[w.doc[real]], words).astype(np.uint64))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    return doc[new], h[new]


def _per_doc(b: common.Block) -> Iterator[tuple[int, np.ndarray]]:
    doc, h = shingles(b)
    first = np.searchsorted(doc, np.arange(len(b) + 1))
    for i in range(len(b)):
        yield i, h[first[i] : first[i + 1]]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def needed(n: int) -> int:
    """Shingles that a set of n has in common with any that it is linked to, at least."""
    return -(-PERCENT * n // 100)


def overlap_needed(n: int, m: int) -> int:
    """Smallest intersection of linked sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def sets_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_shingles and digest of the set of every row, and a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "_text"):
            got = [(len(s), _digest(s) if len(s) else None) for _, s in _per_doc(b)]
            yield pa.RecordBatch.from_arrays([b.batch.column(key), b.batch.column("_print"), pa.array([n for n, _ in got], pa.int64()), pa.array([d for _, d in got], pa.binary())], names=[key, "print", "n_shingles", "digest"])

    rows = docs.select(key, F.col(text).alias("_text"), F.xxhash64(text).alias("_print"))
    return rows.mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, print long, n_shingles long, digest binary")


_PACKED = "bucket long, chunk long, chunks binary, body binary, docs binary, sizes binary"


def _ways(total: int) -> tuple[int, int]:
    """Shuffles that it takes to deal so many shingles to buckets, and ways of each."""
    buckets, levels = max(LEAST_WAYS, -(-total // BUCKET)), 1
    while buckets > WAYS**levels:
        levels += 1
    ways = 1
    while ways**levels < buckets:
        ways += 1
    return levels, ways


def _cut(value: np.ndarray, who: np.ndarray, ways: int, last: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """Values by their lowest digit in their upper half, which is taken off: digit,
    sorted values by byte plane (differences compress well), and whose they are.
    In the last level only fingerprints are left."""
    upper = value >> np.uint64(32)
    digit = upper % np.uint64(ways)
    value = (upper // np.uint64(ways)) << np.uint64(32) | value & np.uint64(0xFFFFFFFF)
    order = np.lexsort((who, value, digit))
    value, who, digit = value[order], who[order].astype("<u4"), digit[order]
    edge = np.flatnonzero(np.r_[True, digit[1:] != digit[:-1]]) if len(digit) else np.zeros(0, np.int64)
    for a, z in zip(edge.tolist(), [*edge[1:].tolist(), len(digit)], strict=False):
        kind = "<u4" if last else "<u8"
        some = value[a:z].astype(kind)
        planes = np.diff(some, prepend=some.dtype.type(0)).astype(kind).view(np.uint8).reshape(z - a, -1).T
        yield int(digit[a]), planes.tobytes(), who[a:z].tobytes()


def _values(body: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(body, np.uint8).reshape(-1, n)
    kind = np.uint32 if len(planes) == 4 else np.uint64
    return np.cumsum(planes.T.copy().view(kind).ravel(), dtype=kind)


def _packed(docs: DataFrame, key: str, text: str, levels: int, ways: int) -> DataFrame:
    """Fingerprints by chunk and bucket; rows with a negative bucket describe the
    documents of a chunk: digests, set sizes and numbers of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        marks: list[bytes] = []
        sizes: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal part
            of = np.repeat(np.arange(len(held), dtype=np.uint32), [len(s) for s in held])
            h = np.concatenate(held)
            # distinct fingerprints of each document, with the bucket above them
            h = (h >> np.uint64(32)) % np.uint64(ways**levels) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
            h, of = h[new], of[new]
            kinds = np.bincount(of, minlength=len(held))
            own = np.array([part], "<i8").tobytes()
            rows = [(-1 - part, part, own, b"", b"".join(marks), np.stack([np.array(sizes), kinds], 1).astype("<i8").tobytes())]
            rows += [(k, part, own, body, who, b"") for k, body, who in _cut(h, of, ways, levels == 1)]
            part += 1
            seen.clear()
            held.clear()
            marks.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=["bucket", "chunk", "chunks", "body", "docs", "sizes"])

        total = 0
        for b in common.blocks(batches, text):
            for _, s in _per_doc(b):
                if len(s):
                    mark = _digest(s)
                    if mark not in seen:  # copies within a chunk are one
                        seen.add(mark)
                        held.append(s)
                        marks.append(mark)
                        sizes.append(len(s))
                        total += len(s)
                        if total >= CHUNK or len(held) >= 65_535:
                            yield flush()
                            total = 0
        if held:
            yield flush()

    return docs.select(key, text).mapInArrow(run, _PACKED)


def _loaded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of some rows, the number of each one's chunk, and its document there."""
    value, chunk, doc = [], [], []
    for r in rows.sort_values("chunk").itertuples():
        who = np.frombuffer(r.docs, "<u4")
        value.append(_values(r.body, len(who)))
        chunk.append(np.frombuffer(r.chunks, "<i8")[who >> 16])
        doc.append(who & 0xFFFF)
    return np.concatenate(value), np.concatenate(chunk), np.concatenate(doc)


def _dealt_on(ways: int, last: bool):
    """Chunks of a bucket are put together and cut into buckets of the next level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["bucket"].iloc[0] < 0:
            return rows[[c.split()[0] for c in _PACKED.split(", ")]]
        bucket, group = int(rows["bucket"].iloc[0]), int(rows["_group"].iloc[0])
        value, chunk, doc = _loaded(rows)
        chunks, at = np.unique(chunk, return_inverse=True)
        who = at.astype(np.uint32) << np.uint32(16) | doc
        own = chunks.astype("<i8").tobytes()
        out = [(bucket * ways + k, group, own, body, docs, b"") for k, body, docs in _cut(value, who, ways, last)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """For a bucket, the fingerprints that more than one set holds, by chunk and group of documents."""
    if rows["bucket"].iloc[0] < 0:
        out = []
        for r in rows.itertuples():
            n = len(r.docs) // 16
            for g in range(0, n, GROUP):
                out.append((r.chunk * 128 + g // GROUP, -1, r.docs[16 * g : 16 * (g + GROUP)], r.sizes[16 * g : 16 * (g + GROUP)]))
        return pd.DataFrame(out, columns=["part", "bucket", "body", "sizes"])
    fp, chunk, docs = _loaded(rows)
    order = np.argsort(fp, kind="stable")
    s = fp[order]
    new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    runs = np.diff(np.r_[new, len(s)])
    count = np.repeat(runs, runs)
    twice = count > 1
    if not twice.any():
        return pd.DataFrame({"part": pd.Series([], dtype="int64"), "bucket": pd.Series([], dtype="int64"), "body": pd.Series([], dtype=object), "sizes": pd.Series([], dtype=object)})
    order, count = order[twice], np.minimum(count[twice], 65_535)
    part = chunk[order] * 128 + docs[order] // GROUP
    by = np.argsort(part, kind="stable")
    part, order, count = part[by], order[by], count[by]
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    bucket = int(rows["bucket"].iloc[0])
    out = []
    for a, z in zip(edge, [*edge[1:], len(part)], strict=True):
        body = np.stack([(docs[order[a:z]] % GROUP).astype(np.uint64), fp[order[a:z]].astype(np.uint64), count[a:z].astype(np.uint64)], 1)
        out.append((int(part[a]), bucket, (body[:, 0] << np.uint64(48) | body[:, 2] << np.uint64(32) | body[:, 1]).astype("<u8").tobytes(), b""))
    return pd.DataFrame(out, columns=["part", "bucket", "body", "sizes"])


def _prefixes(rows: pd.DataFrame) -> pd.DataFrame:
    """For a group of documents, the repeated shingles among the first of each, rarest first."""
    head = rows[rows["bucket"] < 0]
    body = rows[rows["bucket"] >= 0]
    empty = pd.DataFrame({"shingle": pd.Series([], dtype="int64"), "digest": pd.Series([], dtype=object)})
    if not len(head) or not len(body):
        return empty
    marks, sizes = head["body"].iloc[0], np.frombuffer(head["sizes"].iloc[0], "<i8").reshape(-1, 2)
    packed = [np.frombuffer(x, "<u8") for x in body["body"]]
    e = np.concatenate(packed)
    key = np.repeat(body["bucket"].to_numpy(), [len(x) for x in packed]) << 32 | (e & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc, count = (e >> np.uint64(48)).astype(np.int64), ((e >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
    order = np.lexsort((key, count, doc))
    doc, key = doc[order], key[order]
    held = np.bincount(doc, minlength=len(sizes))
    n, kinds = sizes[:, 0], sizes[:, 1]
    prefix = n - (-(-PERCENT * n // 100)) + 1
    left = prefix - (kinds - held)  # after the shingles that occur once
    rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(len(sizes)))[doc]
    take = rank < left[doc]
    return pd.DataFrame({"shingle": key[take], "digest": [marks[16 * d : 16 * d + 16] for d in doc[take].tolist()]}) if take.any() else empty


def candidates(docs: DataFrame, shingle_total: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """shingle, digest: shared shingles among the first of each set."""
    levels, ways = _ways(shingle_total)
    packed, chunks = _packed(docs, key, text, levels, ways), max(1, shingle_total // CHUNK)
    for level in range(1, levels):
        chunks = max(1, chunks // ways)
        group = F.when(F.col("bucket") < 0, 0).otherwise(F.pmod(F.xxhash64("chunk"), F.lit(chunks)))
        packed = packed.withColumn("_group", group).groupBy("bucket", "_group").applyInPandas(_dealt_on(ways, level == levels - 1), _PACKED)
    repeated = packed.groupBy("bucket").applyInPandas(_repeated, "part long, bucket long, body binary, sizes binary")
    return repeated.groupBy("part").applyInPandas(_prefixes, "shingle long, digest binary")


# ------------------------------------------------------------- signature trees


def _bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS // 64, np.uint64)
    bit = (s >> np.uint64(52)).astype(np.int64)
    np.bitwise_or.at(out, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """Sets by size; level 0 holds the sets, each level above groups of ``LEAF``."""

    def __init__(self, marks: list[bytes], sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), marks[i]))
        self.marks, self.sets = [marks[i] for i in order], [sets[i] for i in order]
        size = np.array([len(s) for s in self.sets])
        bits = np.stack([_bitmap(s) for s in self.sets])
        level = (bits, size, size, size - _ones(bits))
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), LEAF)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)

    def root(self) -> tuple[bytes, int, int, int]:
        bits, lo, hi, spare = self.levels[-1]
        return bits[0].tobytes(), int(lo[0]), int(hi[0]), int(spare[0])


def may_link(bits_a, lo_a, hi_a, spare_a, bits_b, lo_b, hi_b, spare_b):
    """Whether sets below two nodes can overlap enough: each holds at most the common
    bits and what its own sets have beyond their bits."""
    most = _ones(bits_a & bits_b) + np.minimum(spare_a, spare_b)
    least = -(-PERCENT * (lo_a + lo_b) // (100 + PERCENT))
    fits = (100 * hi_a >= PERCENT * lo_b) & (100 * hi_b >= PERCENT * lo_a)
    return fits & (np.minimum(np.minimum(most, hi_a), hi_b) >= least)


def tree_links(a: Tree, b: Tree | None = None) -> list[tuple[bytes, bytes]]:
    """Links between the sets of two trees (of one, without ``b``) that span their
    components, given the links within each tree: between two trees of near copies
    one link is enough."""
    own = b is None
    b = a if own else b
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    if not own:
        for x, y in tree_links(a) + tree_links(b):
            parent[find(x)] = find(y)
    out = []
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, i, lb, j = todo.pop()
        if la == 0 and lb == 0:
            if own and i >= j:
                continue
            x, y = find(a.marks[i]), find(b.marks[j])
            if x != y:
                s, t = a.sets[i], b.sets[j]
                if len(s) > len(t):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                if int((t[at] == s).sum()) >= overlap_needed(len(s), len(t)):
                    parent[x] = y
                    out.append((a.marks[i], b.marks[j]))
            continue
        # go down in the taller tree, in both if they are equally tall
        ka = np.arange(i * LEAF, min((i + 1) * LEAF, len(a.levels[la - 1][0]))) if la >= lb and la else np.array([i])
        kb = np.arange(j * LEAF, min((j + 1) * LEAF, len(b.levels[lb - 1][0]))) if lb >= la and lb else np.array([j])
        na, nb = la - (la >= lb and la > 0), lb - (lb >= la and lb > 0)
        pa_, pb_ = (x.ravel() for x in np.meshgrid(ka, kb, indexing="ij"))
        if own and na == nb:
            keep = pa_ <= pb_
            pa_, pb_ = pa_[keep], pb_[keep]
        ok = may_link(*(x[pa_] for x in a.levels[na]), *(x[pb_] for x in b.levels[nb]))
        todo += [(na, x, nb, y) for x, y in zip(pa_[ok].tolist(), pb_[ok].tolist(), strict=True)]
    return out


def _pack_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("digest").sort_values("digest")
    tree = Tree(list(rows["digest"]), [np.frombuffer(x, "<u8") for x in rows["body"]])
    first = rows.iloc[0]
    return pd.DataFrame([(first["group"], first["shelf"], first["idx"], *tree.root(), b"".join(tree.marks), [len(s) for s in tree.sets], np.concatenate(tree.sets).astype("<u8").tobytes())], columns=[*_NODE, "marks", "sizes", "body"])


_NODE = ["group", "shelf", "idx", "bits", "lo", "hi", "spare"]
_NODE_TYPES = "group binary, shelf int, idx long, bits binary, lo long, hi long, spare long"


def _above(rows: pd.DataFrame) -> pd.DataFrame:
    """The node above some nodes: OR of bitmaps, range of sizes, their component if it is one."""
    bits = np.bitwise_or.reduce(np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(len(rows), -1))
    label = set(rows["label"])
    first = rows.iloc[0]
    return pd.DataFrame([(first["group"], first["shelf"], first["idx"] // FAN, bits.tobytes(), rows["lo"].min(), rows["hi"].max(), rows["spare"].max(), label.pop() if len(label) == 1 else None)], columns=[*_NODE, "label"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes whose sets may overlap enough."""
    for b in batches:
        side = []
        for x in "ab":
            bits = np.frombuffer(b"".join(b.column(f"bits_{x}").to_pylist()), np.uint64).reshape(b.num_rows, -1)
            side += [bits, *(b.column(f"{c}_{x}").to_numpy() for c in ("lo", "hi", "spare"))]
        ok = may_link(*side) if b.num_rows else np.zeros(0, bool)
        yield b.select(_PAIR).filter(pa.array(ok))


_PAIR = ["group", "shelf_a", "idx_a", "shelf_b", "idx_b"]
_PAIR_TYPES = "group binary, shelf_a int, idx_a long, shelf_b int, idx_b long"


def _side(nodes: DataFrame, x: str, columns: list[str]) -> DataFrame:
    return nodes.select("group", *(F.col(c).alias(f"{c}_{x}") for c in ("shelf", "idx", *columns)))


def _with_sides(pairs: DataFrame, nodes: DataFrame, columns: list[str], few: int = 0) -> DataFrame:
    """Both nodes of each pair; at most ``few`` of them are broadcast."""
    small = few and nodes.count() <= few
    for x in "ab":
        side = _side(nodes, x, columns)
        pairs = pairs.join(F.broadcast(side) if small else side, ["group", f"shelf_{x}", f"idx_{x}"])
    return pairs


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the sets of pairs of leaves."""
    for b in batches:
        for i in range(b.num_rows):
            cell = lambda c, i=i, b=b: b.column(c)[i]
            one = _unpack_block(cell("marks_a").as_py(), cell("sizes_a").values.to_numpy(), cell("body_a").as_py())
            if all(cell(f"{c}_a").as_py() == cell(f"{c}_b").as_py() for c in ("shelf", "idx")):
                out = tree_links(one)
            else:
                out = tree_links(one, _unpack_block(cell("marks_b").as_py(), cell("sizes_b").values.to_numpy(), cell("body_b").as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])


def _leaf_links(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    return _with_sides(pairs, blocks, ["marks", "sizes", "body"]).mapInArrow(_compare, "a binary, b binary")


def _placed(named: DataFrame, sets: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Leaf (group, shelf, idx) of each set with candidates, and a row to read it from.

    A small group is one leaf.  Others have a shelf for each class of sizes, so that
    links join neighbouring shelves at most.  On a shelf sets are ordered by the
    smallest hash of a shared shingle, in ``STEPS`` steps, and within one by a hash.
    """
    stand = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(key, "print")).alias("of"), F.max("n_shingles").alias("n"))
    stand = stand.select("digest", F.col("of")[key].alias("_key"), F.col("of.print").alias("_print"), "n")
    sign = named.groupBy("digest").agg(F.pmod(F.min(F.xxhash64("shingle")), F.lit(STEPS)).cast("int").alias("step"))
    member = stand.join(groups.select(F.col("node").alias("digest"), F.col("root").alias("group")), "digest").join(sign, "digest")
    member = common.staged(member, "members")
    size = F.floor(F.log("n") / float(np.log(100 / PERCENT))).cast("int")
    whole = common.staged(member.groupBy("group").agg(F.count("*").alias("m")), "groups")
    member = common.join_staged(member, whole, ["group"], ["digest"])
    member = member.withColumn("shelf", F.when(F.col("m") <= BLOCK, F.lit(-1)).otherwise(size))
    steps = member.groupBy("group", "shelf", "step").agg(F.count("*").alias("c"))
    before = Window.partitionBy("group", "shelf").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)  # STEPS rows
    steps = common.staged(steps.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))), "steps")
    idx = F.floor((F.col("before") + F.pmod(F.xxhash64("digest"), F.col("c"))) / BLOCK)
    return common.join_staged(member, steps, ["group", "shelf", "step"], ["digest"]).select("digest", "_key", "_print", "group", "shelf", idx.alias("idx"))


def _unpack_block(marks: bytes, sizes: np.ndarray, body: bytes) -> Tree:
    s = np.frombuffer(body, "<u8")
    edge = np.r_[0, np.cumsum(sizes)]
    return Tree([marks[16 * i : 16 * i + 16] for i in range(len(sizes))], [s[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)])


def _candidate_edges(named: DataFrame) -> DataFrame:
    """Edges that connect the sets of each shared shingle.

    Each set is hooked to the smallest set that it shares a shingle with; shingles
    then connect hooks, not sets, of which a group of near copies has few.  Below
    both joins are plain shuffles, so Spark splits the rows of a frequent shingle.
    """
    low = named.groupBy("shingle").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("shingle", "a")
    held = named.join(low, "shingle")
    hook = common.staged(held.groupBy("digest").agg(F.min("a").alias("r")), "hooks")
    spots = held.join(hook, "digest").select("shingle", "r").distinct()
    ends = spots.groupBy("shingle").agg(F.min("r").alias("a"), F.max("r").alias("z")).where("a <> z").select("shingle", "a")
    more = spots.join(ends, "shingle").select("a", F.col("r").alias("b"))
    return hook.select(F.col("digest").alias("a"), F.col("r").alias("b")).union(more).where("a <> b").distinct()


def links(docs: DataFrame, sets: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges between digests that span the components of the exact links."""
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    named = common.staged(candidates(docs, total, key, text).distinct(), "candidates")
    groups = connected(_candidate_edges(named))
    placed = common.staged(_placed(named, sets, groups, key), "placed")
    blocks = common.staged(_blocks(docs, placed, key, text), "blocks")
    here = blocks.select("group", F.col("shelf").alias("shelf_a"), F.col("idx").alias("idx_a"), F.col("shelf").alias("shelf_b"), F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx_b"))
    near = common.staged(_leaf_links(here, blocks), "links")
    most = blocks.where("shelf >= 0").agg(F.max("idx")).first()[0]
    if most is None:  # no group has more than a leaf
        return near
    roots = connected(near)
    held = placed.where("shelf >= 0").join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("label", F.coalesce("root", "digest"))
    label = held.groupBy("group", "shelf", "idx").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    label = label.select("group", "shelf", "idx", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"))
    levels = [common.staged(blocks.where("shelf >= 0").select(*_NODE).join(label, ["group", "shelf", "idx"]), "nodes")]
    while FAN ** (len(levels) - 1) <= most:
        above = levels[-1].groupBy("group", "shelf", F.floor(F.col("idx") / FAN)).applyInPandas(_above, f"{_NODE_TYPES}, label binary")
        levels.append(common.staged(above, "nodes"))
    # roots of neighbouring shelves; then down, a level of all trees at a time
    pairs = levels[-1].select("group", F.col("shelf").alias("shelf_a"), F.col("idx").alias("idx_a"), F.explode(F.array(F.col("shelf"), F.col("shelf") + 1)).alias("shelf_b"), F.col("idx").alias("idx_b"))
    sizes_fit = (100 * F.col("hi_a") >= PERCENT * F.col("lo_b")) & (100 * F.col("hi_b") >= PERCENT * F.col("lo_a"))
    apart = ~F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False))
    for level, nodes in reversed(list(enumerate(levels))):
        pairs = _with_sides(pairs, nodes, ["bits", "lo", "hi", "spare", "label"], FEW_NODES).where(sizes_fit & apart)
        if not level:  # leaves that were compared before
            pairs = pairs.where((F.col("shelf_a") != F.col("shelf_b")) | (F.col("idx_b") > F.col("idx_a") + 1))
        pairs = common.staged(pairs.mapInArrow(_prune, _PAIR_TYPES), "pairs")
        if level:
            child = lambda x: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda k: F.col(f"idx_{x}") * FAN + k))
            pairs = pairs.withColumn("idx_a", child("a")).withColumn("idx_b", child("b"))
            pairs = pairs.where((F.col("shelf_a") != F.col("shelf_b")) | (F.col("idx_a") <= F.col("idx_b")))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(_leaf_links(pairs, blocks))


def _blocks(docs: DataFrame, placed: DataFrame, key: str, text: str) -> DataFrame:
    """The leaves with their sets."""
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_own"))
    right = placed.select("_key", "_print", F.col("digest").alias("_want"), "group", "shelf", "idx").hint("shuffle_hash")
    wanted = rows.join(right, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_print"))).select("_text", "_want", "group", "shelf", "idx")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "_text"):
            same, body = [], []
            want = b.batch.column("_want").to_pylist()
            for i, s in _per_doc(b):
                if _digest(s) == want[i]:
                    same.append(i)
                    body.append(s.astype("<u8").tobytes())
            t = b.batch.select(["group", "shelf", "idx", "_want"]).take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(body, pa.binary())], names=["group", "shelf", "idx", "digest", "body"])

    whole = wanted.mapInArrow(with_sets, "group binary, shelf int, idx long, digest binary, body binary")
    return whole.groupBy("group", "shelf", "idx").applyInPandas(_pack_block, f"{_NODE_TYPES}, marks binary, sizes array<int>, body binary")


def _rooted(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The set of every row; and of every digest the smallest key, which key and digest
    come first in its component, and the smallest key there.

    First is the smallest key, and under it the smallest digest; digests none of
    whose rows has a key come last.
    """
    sets = common.staged(sets_of(docs, key, text), "sets")
    roots = connected(links(docs, sets, key, text)).withColumnRenamed("node", "digest")
    smallest = common.staged(sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min(key).alias("low")), "digests")
    linked = common.staged(common.join_staged(smallest, roots, ["digest"], ["digest"]), "linked")
    first = F.min(F.struct(F.col("low").isNull(), "low", "digest")).alias("first")
    best = common.staged(linked.groupBy("root").agg(first).select("root", F.col("first.low").alias("id"), F.col("first.digest").alias("stays")), "best")
    of_linked = common.staged(common.join_staged(linked, best, ["root"], ["digest"]).select("digest", "id", "stays"), "best")
    of_set = common.join_staged(smallest, of_linked, ["digest"], ["digest"], "left")
    return sets, of_set.select("digest", F.when(F.col("stays").isNull(), F.col("low")).otherwise(F.col("id")).alias("id"), F.coalesce("stays", "digest").alias("stays"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id (the smallest key reachable by links) of every row."""
    sets, of_set = _rooted(docs, key, text)
    found = common.join_salted(sets, of_set.select("digest", "id"), ["digest"], [key, "print"], "left")
    return found.select(key, "n_shingles", F.when(F.col("digest").isNull(), F.col(key)).otherwise(F.col("id")).alias("component_id"))


def _with_digest(docs: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """``docs`` with the digest of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            found = pa.array([_digest(s) if len(s) else None for _, s in _per_doc(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.batch.columns, found], names=[*b.batch.schema.names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("binary")).schema)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates.

    Of each component the smallest key and, under it, the smallest digest stays,
    whatever other texts the key has; where no row has a key, one row of the
    smallest digest.  Rows with the same key and the same set are one document
    and stay or go together.  Rows with an empty set stay.
    """
    mark = "_set"
    while mark in docs.columns:
        mark += "_"
    sets, of_set = _rooted(docs, key, text)
    of_set = common.staged(of_set, "components")
    gone = common.join_salted(sets.where(F.col(key).isNotNull()), of_set, ["digest"], [key, "print"]).where((F.col(key) != F.col("id")) | (F.col("digest") != F.col("stays")))
    gone = gone.select(key, F.col("digest").alias(mark)).distinct()
    kept = _with_digest(docs.where(F.col(key).isNotNull()), mark, key, text).join(gone.hint("shuffle_hash"), [key, mark], "left_anti").select(*docs.columns)
    nameless = _with_digest(docs.where(F.col(key).isNull()), mark, key, text)
    alone = nameless.join(of_set.where("id IS NULL AND digest = stays").select(F.col("digest").alias(mark)), mark, "left_semi")
    one = alone.groupBy(mark).agg(F.min_by(F.struct(*docs.columns), F.col(text)).alias("row")).select("row.*")
    return kept.unionByName(one).unionByName(nameless.where(F.col(mark).isNull()).select(*docs.columns))
