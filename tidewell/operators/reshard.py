"""Online resharding: plan, double writes, copy, verify, cut over, clean up.

Each step can be repeated; its state is the placement file and the data, so a
run that stops anywhere is taken up by running again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.cluster import Cluster
from tidewell.operators.topology import Directory, save, split_moves
from tidewell.sources.tables import fingerprint

CHECKED = ["id", "tenant_id", "total_cents", "logical_shard"]


class VerificationError(RuntimeError):
    """The copies of a logical shard differ."""


class StoppedError(RuntimeError):
    """A test's abort point was reached."""


@dataclass
class Reshard:
    cluster: Cluster
    placement_path: str

    @property
    def directory(self) -> Directory:
        if not isinstance(self.cluster.topology, Directory):
            raise TypeError("only a directory can be resharded online")
        return self.cluster.topology

    def _set(self, directory: Directory) -> None:
        self.cluster.set_topology(directory)
        save(self.cluster.spark, directory, self.placement_path)

    def plan(self, old: int) -> list[tuple[int, int]]:
        return list(split_moves(self.directory, old))

    def open(self, moves: list[tuple[int, int]]) -> None:
        """From now on the moving shards' rows are written to both places."""
        d = self.directory
        for logical, target in moves:
            if d.placement[logical] != target and d.moving.get(logical) != target:
                d = d.begin_move(logical, target)
        self._set(d)

    def backfill(self, moves: list[tuple[int, int]]) -> None:
        """Copy what was there before, a target at a time; rows that are there stay."""
        for source, target, logicals in self._grouped(moves):
            rows = self.cluster.stores[source].scan("orders").where(F.col("logical_shard").isin(logicals))
            self.cluster.stores[target].begin().insert_new("orders", rows, ["id"]).commit()

    def verify(self, moves: list[tuple[int, int]]) -> DataFrame:
        """Rows and checksum of each move on both sides."""
        out = []
        for source, target, logicals in self._grouped(moves):
            a, b = (fingerprint(self.cluster.stores[s].scan("orders").where(F.col("logical_shard").isin(logicals)), CHECKED).first() for s in (source, target))
            out.append((source, target, len(logicals), a["rows"], b["rows"], a["checksum"], b["checksum"], a == b))
        return self.cluster.spark.createDataFrame(out, "source int, target int, logical_shards int, source_rows long, target_rows long, source_checksum long, target_checksum long, same boolean")

    def cut_over(self, moves: list[tuple[int, int]], fail_after: int | None = None) -> None:
        """Reads go to the target, one logical shard after the other."""
        bad = self.verify(moves).where("NOT same").collect()
        if bad:
            raise VerificationError(f"copies differ: {bad}")
        for k, (logical, _) in enumerate(moves):
            if fail_after is not None and k >= fail_after:
                raise StoppedError(f"stopped after {k} moves")
            if logical in self.directory.moving:
                self._set(self.directory.commit(logical))

    def clean(self) -> None:
        """Drop rows from shards that no longer own, or receive, them."""
        for shard, store in self.cluster.stores.items():
            tx = store.begin()
            o = self.directory.with_targets(tx.scan("orders"))
            tx.replace("orders", ["all"], o.where(F.array_contains("targets", shard)).drop("targets")).commit()

    def status(self) -> DataFrame:
        d = self.directory
        rows = [(i, p, d.moving.get(i)) for i, p in enumerate(d.placement)]
        return self.cluster.spark.createDataFrame(rows, "logical_shard int, shard int, moving_to int")

    def run(self, old: int, fail_after: int | None = None) -> None:
        moves = [m for m in self.plan(old)] if not self.directory.moving else sorted(self.directory.moving.items())
        self.open(moves)
        self.backfill(moves)
        self.cut_over(moves, fail_after)
        self.clean()

    def _grouped(self, moves: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
        by: dict[tuple[int, int], list[int]] = {}
        for logical, target in moves:
            source = self.directory.placement[logical]
            if source != target:
                by.setdefault((source, target), []).append(logical)
        return [(s, t, ls) for (s, t), ls in sorted(by.items())]
