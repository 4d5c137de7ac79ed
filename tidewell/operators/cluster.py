"""A cluster of shards: one store each, one topology, fan-out with completeness.

Whole-cluster questions are one plan over all shards by default.  ``scatter``
runs a function a shard instead, each with a timeout, for when errors and times
by shard are wanted; its results always say how many shards they cover.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import partitions as P
from tidewell.operators.store import PART, Store, Tx, merged, write_parts
from tidewell.operators.topology import LOGICAL, Directory, IncompleteClusterError, Topology, check_fits

ORDERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("tenant_id", T.LongType(), False),
        T.StructField("logical_shard", T.IntegerType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
        T.StructField("total_cents", T.LongType(), False),
        T.StructField("state", T.StringType(), False),
    ]
)
LEDGER = T.StructType([T.StructField("tenant_id", T.LongType(), False), T.StructField("balance_cents", T.LongType(), False)])
OUTBOX = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("target_shard", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("payload", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("delivered_at", T.TimestampType(), True),
    ]
)
APPLIED = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("applied_at", T.TimestampType(), False)])
#: which messages of the outbox are delivered; the outbox itself is only added to
DELIVERED = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("delivered_at", T.TimestampType(), False)])
TABLES = {"orders": ORDERS, "ledger": LEDGER, "outbox": OUTBOX, "applied": APPLIED, "delivered": DELIVERED}
#: a credit rewrites one part of the ledger
SPECS = {"ledger": P.HashSpec(modulus=8)}


@dataclass
class ShardResult:
    shard: int
    value: Any
    error: Exception | None
    took: float


@dataclass
class Gathered:
    """Results by shard, in order, and whether they cover the topology."""

    results: list[ShardResult]
    expected: int

    @property
    def ok(self) -> int:
        return sum(r.error is None for r in self.results)

    @property
    def complete(self) -> bool:
        return self.ok == self.expected

    def slowest(self) -> tuple[int, float]:
        """Shard and seconds; (-1, 0) without results."""
        r = max(self.results, key=lambda r: r.took, default=None)
        return (r.shard, r.took) if r else (-1, 0.0)


class PartialResultError(RuntimeError):
    """Some shards failed, and partial results weren't asked for."""


class Cluster:
    def __init__(self, spark: SparkSession, root: str, topology: Topology, shards: list[int] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.shards = sorted(topology.shards() if shards is None else shards)
        self.stores = {s: Store(spark, f"{self.root}/shard={s}") for s in self.shards}
        self.set_topology(topology)

    def set_topology(self, topology: Topology) -> None:
        check_fits(topology, self.shards)  # a shard left out would be an undercount
        self.topology = topology

    def create(self) -> Cluster:
        for s in self.stores.values():
            if not s.version():
                tx = s.begin()
                for name, schema in TABLES.items():
                    tx.create(name, schema, SPECS.get(name))
                tx.commit()
        return self

    def ping(self) -> dict[int, bool]:
        """Whether each shard's store can be read and has its tables."""

        def there(s: Store) -> bool:
            try:
                return set(TABLES) <= set(s.manifest()["tables"])
            except Exception:  # any failure to read is the answer
                return False

        return {k: there(s) for k, s in self.stores.items()}

    def store_of(self, tenant: int) -> Store:
        return self.stores[self.topology.read(tenant)]

    def stores_to_write(self, tenant: int) -> list[Store]:
        return [self.stores[s] for s in self.topology.write(tenant)]

    def read(self, table: str) -> DataFrame:
        """All shards as one table with a ``shard`` column, one version of each."""
        parts = [s.scan(table).withColumn("shard", F.lit(k)) for k, s in self.stores.items()]
        return reduce(DataFrame.unionByName, parts)

    # ---- fan-out

    def scatter(self, fn: Callable[[int, Store], Any], timeout: float = 5.0, concurrency: int | None = None, allow_partial: bool = False) -> Gathered:
        """``fn(shard, store)`` for all shards; one that takes longer is cancelled."""
        sc = self.spark.sparkContext

        def one(shard: int) -> ShardResult:
            tag = f"scatter-{uuid.uuid4().hex}"
            began, box = time.monotonic(), {}

            def work() -> None:
                sc.addJobTag(tag)
                try:
                    box["value"] = fn(shard, self.stores[shard])
                except Exception as e:  # the caller gets it with its shard
                    box["error"] = e

            t = InheritableThread(target=work, daemon=True)
            t.start()
            t.join(timeout)
            if t.is_alive():
                sc.cancelJobsWithTag(tag)
                return ShardResult(shard, None, TimeoutError(f"shard {shard} took more than {timeout} s"), time.monotonic() - began)
            return ShardResult(shard, box.get("value"), box.get("error"), time.monotonic() - began)

        with ThreadPoolExecutor(concurrency or len(self.shards) or 1) as pool:
            got = Gathered(list(pool.map(one, self.shards)), len(self.topology.shards() | set(self.shards)))
        if not allow_partial and not got.complete:
            failed = {r.shard: str(r.error) for r in got.results if r.error}
            raise PartialResultError(f"{got.ok} of {got.expected} shards answered: {failed}")
        return got

    # ---- reports

    def state_counts(self) -> DataFrame:
        """Orders by state, with how many shards they come from."""
        by_shard = self.read("orders").groupBy("shard", "state").agg(F.count("*").alias("n"))
        return by_shard.groupBy("state").agg(F.sum("n").alias("n")).withColumns({"shards_ok": F.lit(len(self.shards)), "shards_expected": F.lit(len(self.topology.shards() | set(self.shards)))})

    def state_counts_scattered(self, timeout: float = 30.0, allow_partial: bool = False) -> tuple[dict[str, int], Gathered]:
        got = self.scatter(lambda _, s: {r["state"]: r["n"] for r in s.scan("orders").groupBy("state").agg(F.count("*").alias("n")).collect()}, timeout, allow_partial=allow_partial)
        total: dict[str, int] = {}
        for r in got.results:
            for state, n in (r.value or {}).items():
                total[state] = total.get(state, 0) + n
        return dict(sorted(total.items())), got

    def stats(self) -> DataFrame:
        """Rows, tenants and bytes of each shard, empty ones too, and the share of the largest."""
        found = self.read("orders").groupBy("shard").agg(F.count("*").alias("rows"), F.countDistinct("tenant_id").alias("tenants"))
        known = self.spark.createDataFrame([(k, s.files.size(f"{s.root}/data")) for k, s in self.stores.items()], "shard int, bytes long")
        whole = known.join(found, "shard", "left").select("shard", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("tenants", F.lit(0)).alias("tenants"), "bytes")
        top = whole.agg(F.max("rows").alias("hi"), F.min("rows").alias("lo"))
        return whole.join(F.broadcast(top)).select("shard", "rows", "tenants", "bytes", (F.col("hi") / F.greatest("lo", F.lit(1))).alias("imbalance"))

    def summarize_tenant(self, tenant: int) -> DataFrame:
        """Count and sum of one tenant, from its shard alone."""
        o = self.store_of(tenant).scan("orders").where(F.col("tenant_id") == tenant)
        return o.agg(F.count("*").alias("orders"), F.coalesce(F.sum("total_cents"), F.lit(0)).cast("long").alias("total_cents"))

    def misplaced(self) -> DataFrame:
        """Rows on another shard than the topology says, for each shard.  Tenants
        are routed once each, not once a row."""
        o = self.read("orders")
        tenants = o.groupBy("shard", "tenant_id").agg(F.count("*").alias("n"))
        wrong = self.topology.with_shard(tenants, out="home").where("home <> shard").groupBy("shard").agg(F.sum("n").alias("n"))
        known = self.spark.createDataFrame([(s,) for s in self.shards], "shard int")
        return known.join(wrong, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("misplaced"))

    # ---- writing

    def insert_orders(self, rows: DataFrame) -> None:
        """Route and add orders (id, tenant_id, created_at, total_cents, state), source
        shard before target; an id that is there already is left alone."""
        t = self.topology
        if isinstance(t, Directory):
            routed = t.with_logical(t.with_targets(rows))
        else:
            routed = Directory.even(LOGICAL, 1).with_logical(t.with_shard(rows, out="__s").withColumn("targets", F.array("__s")).drop("__s"))
        routed = routed.cache()
        try:
            for turn in (0, 1):
                now = routed.withColumn("shard", F.try_element_at("targets", F.lit(turn + 1))).where("shard IS NOT NULL").drop("targets")
                for s in [r["shard"] for r in now.select("shard").distinct().collect()]:  # one a shard
                    if s not in self.stores:
                        raise IncompleteClusterError(f"no shard {s}")
                    self.stores[s].begin().insert_new("orders", now.where(F.col("shard") == s).drop("shard"), ["id"]).commit()
        finally:
            routed.unpersist()

    def seed_ledger(self, opening_cents: int = 1_000_000) -> None:
        """Each tenant of a shard's orders gets the opening balance there."""
        for s in self.stores.values():
            tx = s.begin()
            new = tx.scan("orders").select("tenant_id").distinct().withColumn("balance_cents", F.lit(opening_cents).cast("long"))
            tx.upsert("ledger", new, ["tenant_id"], put=["balance_cents"]).commit()

    def balances(self) -> DataFrame:
        return self.read("ledger")


class Together:
    """A transaction on each of some shards, whose reads and writes are one job for all
    of them, not one a shard.  Rows have a ``shard`` column; those of other shards are
    left out.  Each shard commits by itself."""

    def __init__(self, cluster: Cluster, shards: list[int] | None = None):
        self.cluster = cluster
        self.txs: dict[int, Tx] = {s: cluster.stores[s].begin() for s in (cluster.shards if shards is None else shards)}

    def _union(self, parts: dict[int, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [df.withColumn("shard", F.lit(s)) for s, df in parts.items()])

    def scan(self, table: str) -> DataFrame:
        return self._union({s: tx.scan(table) for s, tx in self.txs.items()})

    def _alike(self, table: str) -> list[list[int]]:
        """Shards whose tables have one schema and the same partitions."""
        groups: dict[str, list[int]] = {}
        for s, tx in self.txs.items():
            t = tx._t(table)
            bounds = {n: {k: v for k, v in p.items() if k != "dirs"} for n, p in t["parts"].items()}
            groups.setdefault(json.dumps([t["schema"], t["spec"], bounds], sort_keys=True), []).append(s)
        return list(groups.values())

    def _write(self, table: str, df: DataFrame) -> dict[int, dict[str, str]]:
        """Rows are written beside the stores and their folders moved into them."""
        made: dict[int, dict[str, str]] = {s: {} for s in self.txs}
        for shards in self._alike(table):
            name, files = f"{table}-{uuid.uuid4().hex}", self.txs[shards[0]].store.files
            stage = f"{self.cluster.root}/staged/{name}"
            own = df.where(F.col("shard").isin(shards))
            write_parts(self.txs[shards[0]]._routed(table, own, ("shard",)), stage, table, ("shard",))
            there = set(files.list(stage))
            for s in shards:
                if f"shard={s}" in there:
                    to = f"{self.txs[s].store.root}/data/{name}"
                    if not files.rename(f"{stage}/shard={s}", to):
                        raise OSError(f"can't move {stage}/shard={s} to {to}")
                    made[s] = self.txs[s]._parts_in(f"data/{name}")
            files.delete(stage)
        return made

    def insert(self, table: str, df: DataFrame) -> Together:
        for s, made in self._write(table, df).items():
            self.txs[s]._put(table, [], made)
        return self

    def homes(self, table: str, df: DataFrame) -> dict[int, list[str | None]]:
        """Partitions that the rows of each shard belong to, None if there is none for
        a row; shards without rows are not in it."""
        out: dict[int, list[str | None]] = {}
        for shards in self._alike(table):
            tx = self.txs[shards[0]]
            spec = tx.spec(table)
            need = [c for c in (spec.range_column(), spec.tenant_column()) if c]
            own = df.where(F.col("shard").isin(shards)).select("shard", *need).distinct()
            for r in spec.route(own, tx._t(table)["parts"], PART).select("shard", PART).distinct().collect():  # a row a partition
                out.setdefault(r["shard"], []).append(r[PART])
        return out

    def upsert(self, table: str, df: DataFrame, key: list[str], add: list[str], homes: dict[int, list[str | None]] | None = None) -> Together:
        """As :meth:`Tx.upsert`, for a key that holds the partition column; ``homes`` if known."""
        homes = self.homes(table, df) if homes is None else homes
        hit = {s: [n for n in homes.get(s, []) if n in tx._t(table)["parts"]] for s, tx in self.txs.items()}
        old = self._union({s: tx._read(table, [d for n in hit[s] for d in tx._t(table)["parts"][n]["dirs"]]) for s, tx in self.txs.items()})
        for s, made in self._write(table, merged(old, df, ["shard", *key], add)).items():
            self.txs[s]._put(table, hit[s], made)
        return self

    def commit(self, but: set[int] | frozenset[int] = frozenset()) -> None:
        for s, tx in self.txs.items():
            if s not in but:
                tx.commit()
