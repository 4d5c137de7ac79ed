"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for columns ``a``, ``b``.

    Labels start as the smallest neighbour; a round takes the smallest label
    around each node, then the label of that label, so paths halve.  Every round
    is written to the shared folder, which cuts the lineage.  The centre of a star
    is the neighbour, and the label, of many: labels are broadcast if they are few,
    else joined salted.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = common.staged(both, "edges")
    labels = common.staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    few = common.FEW if labels.count() <= common.FEW else -1
    look = lambda rows, right, key, spread: rows.join(F.broadcast(right), key) if few > 0 else common.join_salted(rows, right, [key], [spread])
    while True:
        around = look(both, labels.select(F.col("node").alias("b"), "root"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        better = look(around, labels, "node", "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("mid"))
        # a label is a node, and has a label too
        jumped = look(better, labels.select(F.col("node").alias("mid"), F.col("root").alias("far")), "mid", "node")
        now = common.staged(jumped.select("node", "old", F.least("mid", "far").alias("root")), "labels")
        changed = now.where("root <> old").limit(1).count()
        labels = now.select("node", "root")
        if not changed:
            return labels
