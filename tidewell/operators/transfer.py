"""Money between shards: two-phase commit, and outbox with an idempotent relay."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.cluster import APPLIED, OUTBOX, Cluster, Together
from tidewell.operators.store import NotAffectedError, Tx


class InsufficientFundsError(NotAffectedError):
    """The paying account is missing or holds less."""


def _debit(tx: Tx, tenant: int, cents: int) -> None:
    try:
        tx.update("ledger", (F.col("tenant_id") == tenant) & (F.col("balance_cents") >= cents), {"balance_cents": F.col("balance_cents") - cents}, must=True)
    except NotAffectedError:
        raise InsufficientFundsError(f"tenant {tenant} can't pay {cents}") from None


def _credit(tx: Tx, tenant: int, cents: int) -> None:
    new = tx.spark.createDataFrame([(tenant, cents)], "tenant_id long, balance_cents long")
    tx.upsert("ledger", new, ["tenant_id"], add=["balance_cents"])


def _positive(cents: int) -> None:
    if cents <= 0:
        raise ValueError("a transfer moves a positive amount")


class TwoPhase:
    """All legs are prepared, then all committed.  A failure to prepare rolls back
    what was prepared; after the first commit there is no way back, and what could
    not be committed stays prepared for :meth:`resolve`."""

    def __init__(self, cluster: Cluster):
        self.cluster = cluster

    @staticmethod
    def _gid(gid: str, shard: int) -> str:
        return f"{gid}-{shard}"

    def prepare(self, gid: str, legs: dict[int, Callable[[Tx], None]]) -> None:
        done = []
        try:
            for shard in sorted(legs):
                tx = self.cluster.stores[shard].begin()
                legs[shard](tx)
                tx.prepare(self._gid(gid, shard))
                done.append(shard)
        except Exception:
            for shard in done:
                self.cluster.stores[shard].rollback_prepared(self._gid(gid, shard))
            raise

    def commit(self, gid: str, shards: list[int]) -> None:
        errors = []
        for shard in sorted(shards):
            try:
                self.cluster.stores[shard].commit_prepared(self._gid(gid, shard))
            except Exception as e:  # the others must still be committed
                errors.append(e)
        if errors:
            raise ExceptionGroup(f"{gid} is committed in part", errors)

    def do(self, gid: str, legs: dict[int, Callable[[Tx], None]]) -> None:
        self.prepare(gid, legs)
        self.commit(gid, list(legs))

    def transfer_legs(self, source: int, target: int, cents: int) -> dict[int, Callable[[Tx], None]]:
        """Debit and credit by shard; on one shard they are one leg."""
        _positive(cents)
        a, b = self.cluster.topology.read(source), self.cluster.topology.read(target)

        def both(tx: Tx) -> None:
            _debit(tx, source, cents)
            _credit(tx, target, cents)

        if a == b:
            return {a: both}
        return {a: lambda tx: _debit(tx, source, cents), b: lambda tx: _credit(tx, target, cents)}

    def transfer(self, gid: str, source: int, target: int, cents: int) -> None:
        self.do(gid, self.transfer_legs(source, target, cents))

    def transfer_all(self, gid: str, moves: DataFrame) -> None:
        """Many transfers (source, target, cents) as one: each shard's leg changes its
        tenants by all that they pay and get."""
        c = self.cluster
        signed = moves.select(F.col("source").alias("tenant_id"), (-F.col("cents")).alias("balance_cents")).unionByName(moves.select(F.col("target").alias("tenant_id"), F.col("cents").alias("balance_cents")))
        sums = c.topology.with_shard(signed.groupBy("tenant_id").agg(F.sum("balance_cents").alias("balance_cents"))).cache()

        def leg(shard: int) -> Callable[[Tx], None]:
            def run(tx: Tx) -> None:
                tx.upsert("ledger", sums.where(F.col("shard") == shard).drop("shard"), ["tenant_id"], add=["balance_cents"])
                if tx.scan("ledger").where("balance_cents < 0").limit(1).count():
                    raise InsufficientFundsError(f"tenants of shard {shard} can't pay what they owe")

            return run

        try:
            self.do(gid, {s: leg(s) for s in c.shards})
        finally:
            sums.unpersist()

    def orphans(self, older_than: float = 0.0) -> list[tuple[int, str, float]]:
        """(shard, name, age in seconds) of what is prepared and neither committed nor rolled back."""
        return [(s, gid, age) for s, store in self.cluster.stores.items() for gid, age in store.prepared() if age >= older_than]

    def resolve(self, older_than: float = 0.0) -> int:
        """Roll orphans back; how many."""
        found = self.orphans(older_than)
        for shard, gid, _ in found:
            self.cluster.stores[shard].rollback_prepared(gid)
        return len(found)


class Outbox:
    """The debit and a message in one local transaction; a relay delivers messages
    at least once, and the receiver applies each once.

    What is delivered and applied is joined by merging: it grows with the messages,
    and files that are small by their compressed size are large once collected to
    the driver and broadcast."""

    def __init__(self, cluster: Cluster):
        self.cluster = cluster

    def transfer(self, event_id: int, source: int, target: int, cents: int) -> None:
        _positive(cents)
        tx = self.cluster.store_of(source).begin()
        _debit(tx, source, cents)
        payload = json.dumps({"tenant_id": target, "cents": cents, "from": source})
        row = tx.spark.range(1).select(
            F.lit(event_id).alias("id"), F.lit(self.cluster.topology.read(target)).alias("target_shard"), F.lit("credit").alias("kind"), F.lit(payload).alias("payload"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("delivered_at")
        )
        tx.insert("outbox", row)
        tx.commit()

    def transfer_all(self, moves: DataFrame) -> None:
        """Many transfers (id, source, target, cents) at once: on each shard all its
        debits and messages in one transaction.  A shard whose tenants can't pay all
        that they owe changes nothing."""
        c = self.cluster
        if moves.where(~F.coalesce(F.col("cents") > 0, F.lit(False))).limit(1).count():
            raise ValueError("a transfer moves a positive amount")
        routed = c.topology.with_shard(c.topology.with_shard(moves, "source"), "target", "target_shard")
        payload = F.to_json(F.struct(F.col("target").alias("tenant_id"), "cents", F.col("source").alias("from")))
        rows = routed.select("shard", "source", "cents", "id", "target_shard", F.lit("credit").alias("kind"), payload.alias("payload"), F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("delivered_at")).cache()
        try:
            t = Together(c)
            debits = rows.groupBy("shard", F.col("source").alias("tenant_id")).agg(F.sum(-F.col("cents")).alias("balance_cents"))
            t.upsert("ledger", debits, ["tenant_id"], add=["balance_cents"])
            poor = {r["shard"] for r in t.scan("ledger").where("balance_cents < 0").select("shard").distinct().collect()}  # a row a shard
            t.insert("outbox", rows.where(~F.col("shard").isin(poor)) if poor else rows).commit(poor)
            if poor:
                raise InsufficientFundsError(f"tenants of shards {sorted(poor)} can't pay what they owe")
        finally:
            rows.unpersist()

    def pending(self) -> DataFrame:
        """Undelivered messages of each shard, zero included."""
        c = self.cluster
        known = c.spark.createDataFrame([(s,) for s in c.shards], "shard int")
        done = c.read("delivered").select("shard", F.col("event_id").alias("id"))
        found = c.read("outbox").where("delivered_at IS NULL").join(done.hint("merge"), ["shard", "id"], "left_anti").groupBy("shard").agg(F.count("*").alias("n"))
        return known.join(found, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("pending"))

    def relay_once(self, source_shard: int, batch: int | None = 100, crash_before_mark: bool = False) -> int:
        """Deliver the next messages of a shard in order of their ids, or with ``None``
        all that are due, whose order is of no account; how many.

        Messages go to the tenant's shard of now, not to the one of when they were
        written.  A message that was applied before counts as delivered.
        """
        c = self.cluster
        store = c.stores[source_shard]
        done = store.scan("delivered").select(F.col("event_id").alias("id")).hint("merge")
        due = store.scan("outbox").where("delivered_at IS NULL").join(done, "id", "left_anti")
        due = due if batch is None else due.orderBy("id").limit(batch)
        due = due.select("id", F.get_json_object("payload", "$.tenant_id").cast("long").alias("tenant_id"), F.get_json_object("payload", "$.cents").cast("long").alias("cents"))
        routed = c.topology.with_shard(due).cache()
        try:
            rows = routed.groupBy("shard").agg(F.count("*").alias("n")).collect()  # a row a shard
            if rows:
                apply_routed(c, routed, [r["shard"] for r in rows])
            if rows and not crash_before_mark:
                store.begin().insert("delivered", routed.select(F.col("id").alias("event_id"), F.current_timestamp().alias("delivered_at"))).commit()
            return sum(r["n"] for r in rows)
        finally:
            routed.unpersist()

    def replay(self, event_id: int) -> None:
        """Mark a message as undelivered again, to show that a second delivery changes nothing."""
        for store in self.cluster.stores.values():
            store.begin().delete("delivered", F.col("event_id") == event_id).commit()


def apply_credits(cluster: Cluster, shard: int, events: DataFrame) -> None:
    """Credit events (id, tenant_id, cents) that the shard hasn't applied; the record
    that they are applied is committed with the credits."""
    apply_routed(cluster, events.withColumn("shard", F.lit(shard)), [shard])


def apply_routed(cluster: Cluster, events: DataFrame, shards: list[int]) -> None:
    """:func:`apply_credits` for events with a ``shard``, all shards in the same jobs.
    A shard for which none is new is left as it is."""
    t = Together(cluster, shards)
    done = t.scan("applied").select("shard", F.col("event_id").alias("id")).hint("merge")
    fresh = events.select("shard", "id", "tenant_id", "cents").dropDuplicates(["shard", "id"]).join(done, ["shard", "id"], "left_anti").cache()
    try:
        homes = t.homes("ledger", fresh)
        if homes:
            t.upsert("ledger", fresh.select("shard", "tenant_id", F.col("cents").alias("balance_cents")), ["tenant_id"], ["balance_cents"], homes)
            t.insert("applied", fresh.select("shard", F.col("id").alias("event_id"), F.current_timestamp().alias("applied_at")))
            t.commit(set(shards) - set(homes))
    finally:
        fresh.unpersist()


def apply_events(ledger: DataFrame, applied: DataFrame, events: DataFrame) -> DataFrame:
    """Balances after events (id, tenant_id, cents), each once, none that is applied: a plain plan."""
    fresh = events.dropDuplicates(["id"]).join(applied.select(F.col("event_id").alias("id")), "id", "left_anti")
    delta = fresh.select("tenant_id", F.col("cents").alias("balance_cents"))
    return reduce(DataFrame.unionByName, [ledger.select("tenant_id", "balance_cents"), delta]).groupBy("tenant_id").agg(F.sum("balance_cents").alias("balance_cents"))


__all__ = ["APPLIED", "OUTBOX", "InsufficientFundsError", "Outbox", "TwoPhase", "apply_credits", "apply_events"]
