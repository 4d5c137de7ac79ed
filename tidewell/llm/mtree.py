"""Exact top-k by inner product: M-trees searched best first.

Vectors are integers, ``floor(scale * x)``.  One more coordinate,
``sqrt(M^2 - |x|^2)`` with M the largest norm in the tree, makes a query's
order by distance its order by inner product, so a metric tree serves.  Tree
nodes are pages: a pivot, a covering radius, the distance to the parent's
pivot, the smallest id below.  A search takes the page with the best possible
score first and stops when none can reach the k-th score; entries of a page
are passed over by the triangle inequality on stored distances before any is
computed.  Scores themselves are exact integers: products that doubles can't hold
are made of 64-bit integers, and a score that these can't hold raises.

Rows with a null id or vector, an empty vector, or null or non-finite
components take no part.  Of rows with one id, the smallest vector counts.
Vectors are compared with those of their own length only.  An empty table
gives an empty result.  Other columns are not read.

Scale: rows are dealt by a hash of their id to trees of a bounded size, queries
to blocks of a bounded size.  A tree is sent to Python once for as many as
``BLOCKS_A_TREE`` blocks, and a windowed top-k merges what the trees return.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREE_ROWS = 4096
BLOCK_QUERIES = 256
#: query blocks that one copy of a tree meets
BLOCKS_A_TREE = 64
PAGE = 256
FANOUT = 16


@dataclass
class Node:
    pivot: np.ndarray
    radius: float
    to_parent: float
    min_id: int
    vectors: np.ndarray | None = None  # of a leaf's entries, by distance to the pivot
    ids: np.ndarray | None = None
    dist: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    pivots: np.ndarray | None = None  # of the children


class MTree:
    """A bulk-loaded M-tree over integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.largest = int(np.abs(vectors).max(initial=0))
        norm = (self.vectors**2).sum(1)
        self.m2 = float(norm.max()) if len(norm) else 0.0
        self.points = np.c_[self.vectors, np.sqrt(np.maximum(self.m2 - norm, 0))]
        self.computed = 0
        self.root = self._build(np.arange(len(ids)), None) if len(ids) else None

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> Node:
        pts = self.points[rows]
        centre = pts.mean(0)
        pivot = pts[np.argmin(((pts - centre) ** 2).sum(1))]
        d = np.sqrt(((pts - pivot) ** 2).sum(1))
        up = float(np.sqrt(((pivot - parent) ** 2).sum())) if parent is not None else 0.0
        node = Node(pivot, float(d.max()), up, int(self.ids[rows].min()))
        if len(rows) <= PAGE or node.radius == 0.0:
            near = np.lexsort((rows, d))
            rows = rows[near]
            node.vectors, node.ids, node.dist = self.vectors[rows], self.ids[rows], d[near]
            return node
        parts = [rows]
        while len(parts) < FANOUT and max(map(len, parts)) > PAGE:
            parts.sort(key=len)
            parts += self._halves(parts.pop())
        node.children = [self._build(x, pivot) for x in parts]
        node.pivots = np.stack([c.pivot for c in node.children])
        return node

    def _halves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two pages of one size: by which of two far entries is the nearer."""
        pts = self.points[rows]
        one = pts[np.argmax(((pts - pts[0]) ** 2).sum(1))]
        d1 = ((pts - one) ** 2).sum(1)
        two = pts[np.argmax(d1)]
        order = np.argsort(d1 - ((pts - two) ** 2).sum(1), kind="stable")
        return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]

    def search(self, query: np.ndarray, k: int, not_id: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), best first; ties go to the smaller id."""
        if self.root is None or k < 1:
            return []
        most = self.largest * int(np.abs(query).max(initial=0)) * len(query)
        if most >= 1 << 63:
            raise ValueError("a score doesn't fit in 64 bits")
        whole = query.astype(np.int64) if most >= 1 << 53 else None  # beyond what doubles add exactly
        query = query.astype(np.float64)
        q = np.append(query, 0.0)
        base = float(q @ q) + self.m2
        # scores are whole numbers: a bound may be off by this much, not by one
        slack = 0.25 + 1e-9 * base

        def best_score(distance: float) -> float:
            return (base - max(distance, 0.0) ** 2) / 2 + slack

        found: list[tuple[int, int]] = []  # a heap, the worst first, as (score, -id)
        d0 = float(np.sqrt(((q - self.root.pivot) ** 2).sum()))
        queue = [(-best_score(d0 - self.root.radius), 0, self.root, d0)]
        pushed = 0
        while queue:
            bound, _, node, d = heapq.heappop(queue)
            if len(found) == k and not self._may(-bound, node.min_id, found[0]):
                if int(np.floor(-bound)) < found[0][0]:
                    break
                continue
            if node.ids is not None:
                vectors, ids = node.vectors, node.ids
                if len(found) == k:  # stored distances alone rule out entries
                    may = (base - (node.dist - d) ** 2) / 2 + slack >= found[0][0]
                    n = int(np.count_nonzero(may))
                    if n < len(ids):
                        vectors, ids = vectors[may], ids[may]
                if len(ids):
                    self.computed += len(ids)
                    score = vectors @ query if whole is None else vectors.astype(np.int64) @ whole
                    if len(found) == k:
                        near = score >= found[0][0]
                        score, ids = score[near], ids[near]
                    if len(ids) > k + 1:  # one of them may be the query's own row
                        near = np.lexsort((ids, -score))[: k + 1]
                        score, ids = score[near], ids[near]
                    for s, i in zip(score.tolist(), ids.tolist(), strict=True):
                        if i == not_id:
                            continue
                        item = (int(s), -i)
                        if len(found) < k:
                            heapq.heappush(found, item)
                        elif item > found[0]:
                            heapq.heapreplace(found, item)
                continue
            kids = node.children
            if len(found) == k:  # before a distance to a child's pivot is computed
                kids = [c for c in kids if self._may(best_score(abs(d - c.to_parent) - c.radius), c.min_id, found[0])]
                pivots = np.stack([c.pivot for c in kids]) if kids else node.pivots[:0]
            else:
                pivots = node.pivots
            self.computed += len(kids)
            for c, dc in zip(kids, np.sqrt(((pivots - q) ** 2).sum(1)).tolist(), strict=True):
                b = best_score(dc - c.radius)
                if len(found) < k or self._may(b, c.min_id, found[0]):
                    pushed += 1
                    heapq.heappush(queue, (-b, pushed, c, dc))
        return [(s, -i) for s, i in sorted(found, key=lambda x: (-x[0], -x[1]))]

    @staticmethod
    def _may(bound: float, min_id: int, worst: tuple[int, int]) -> bool:
        """Whether something below a page can beat the k-th best."""
        b = int(np.floor(bound))
        return b > worst[0] or b == worst[0] and -min_id > worst[1]


def quantised(rows: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """key, v (array<long>) and dim of the rows that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        rows.select(F.col(key).cast("long").alias("id"), x.alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & fine)
        .select("id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))
        .groupBy("id")
        .agg(F.min("v").alias("v"))
        .withColumn("dim", F.size("v"))
    )


def top_k(rows: DataFrame, k: int, query_where: F.Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``query_where``
    (a condition on the key) picks, the k other rows of the highest inner product."""
    from tidewell.llm import common

    data = common.staged(quantised(rows, key, vector, scale), "vectors")
    sizes = data.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(query_where, 1)).alias("nq"))
    sizes = sizes.select("dim", F.ceil(F.col("n") / TREE_ROWS).cast("long").alias("trees"), F.greatest(F.ceil(F.col("nq") / BLOCK_QUERIES), F.lit(1)).cast("long").alias("blocks"))
    sizes = sizes.withColumn("copies", F.ceil(F.col("blocks") / BLOCKS_A_TREE).cast("long"))
    sized = data.join(sizes, "dim")
    trees = sized.groupBy("dim", "copies", F.pmod(F.xxhash64("id"), F.col("trees")).alias("tree")).agg(F.collect_list(F.struct("id", "v")).alias("members"))
    trees = trees.select("dim", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "members")
    ask = sized.where(query_where).groupBy("dim", "trees", "copies", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    # a stated query set against all rows, in blocks: a block goes to each tree once
    spread = ask.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("tree"), F.pmod("block", "copies").alias("copy"), "queries")
    names = ["query_id", "score", "vec_id"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            tree = MTree(*_unpack(left.column("members")[0]))
            for cell in right.column("queries"):
                ids, vectors = _unpack(cell)
                out += [(q, s, v) for q, x in zip(ids.tolist(), vectors, strict=True) for s, v in tree.search(x, k, q)]
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=names)

    where = ["dim", "tree", "copy"]
    asked = spread.select(*(F.col(c).alias(f"to_{c}") for c in where), "queries")
    found = trees.groupBy(*where).cogroup(asked.groupBy(*(f"to_{c}" for c in where))).applyInArrow(run, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    members = cell.values
    ids = members.field("id").to_numpy()
    v = members.field("v")
    return ids, v.flatten().to_numpy().reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
