"""A thin command line over the engine: ``python -m tidewell.cli VERB ...``."""

from __future__ import annotations

import argparse
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ids import IdGenerator, decode_id
from tidewell.operators import topology as T
from tidewell.operators.cluster import Cluster
from tidewell.operators.feed import decode_cursor, page_recent, read_amplification
from tidewell.operators.reshard import Reshard
from tidewell.operators.transfer import Outbox, TwoPhase
from tidewell.session import build_session
from tidewell.sources.tables import synthetic_orders


def open_cluster(spark: SparkSession, a: argparse.Namespace) -> Cluster:
    place = T.load_or_init(spark, f"{a.root}/placement.json", T.LOGICAL, a.shards)
    return Cluster(spark, a.root, place, shards=list(range(a.shards))).create()


def topology(spark: SparkSession, a: argparse.Namespace) -> None:
    n = a.shards
    even, ring = T.Directory.even(T.LOGICAL, n), T.Ring(tuple(range(n)))
    pairs = [(T.ModN(n), T.ModN(2 * n)), (T.ModN(n), T.ModN(n + 1)), (ring, ring.add(*range(n, 2 * n))), (even, T.split(even, n))]
    reduce(DataFrame.unionByName, [T.churn(spark, x, y, a.sample).withColumn("change", F.lit(f"{x.name} to {y.name}")) for x, y in pairs]).show(truncate=False)
    reduce(DataFrame.unionByName, [T.distribution(spark, t, a.sample).withColumn("topology", F.lit(t.name)) for t in (T.ModN(n), even, ring)]).orderBy("topology", "shard").show(100)


def seed(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_cluster(spark, a)
    base = IdGenerator(0).next()
    o = synthetic_orders(spark, a.tenants, a.per_tenant, seed=a.seed)
    rows = o.select((F.lit(base) + F.col("tenant_id") * 1_000_000 + F.col("k")).alias("id"), "tenant_id", F.col("placed_at").alias("created_at"), "total_cents", "state")
    c.insert_orders(rows)
    c.seed_ledger()
    c.stats().orderBy("shard").show()


def show_tenant(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_cluster(spark, a)
    T.explain_route(spark, c.topology, a.tenant).show(truncate=False)
    c.summarize_tenant(a.tenant).show()


def count(spark: SparkSession, a: argparse.Namespace) -> None:
    total, got = open_cluster(spark, a).state_counts_scattered(allow_partial=a.allow_partial)
    for state, n in total.items():
        print(f"{state:10} {n}")
    print(f"{got.ok} of {got.expected} shards; slowest: shard %d, %.3f s" % got.slowest())


def page(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_cluster(spark, a)
    rows, cursor = page_recent(c.read("orders"), decode_cursor(a.cursor), a.limit)
    for r in rows:
        print(r["created_at"], r["id"], r["tenant_id"], r["state"], f"shard {r['shard']}")
    print("next:", cursor.encode() if cursor else "", "read amplification:", read_amplification(a.limit, len(c.shards), len(rows)))


def ids(spark: SparkSession, a: argparse.Namespace) -> None:
    g = IdGenerator(a.shard)
    for _ in range(a.n):
        x = g.next()
        print(x, decode_id(x))


def transfer(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_cluster(spark, a)
    if a.mode == "2pc":
        TwoPhase(c).transfer(f"t{time.time_ns()}", a.source, a.target, a.cents)
    else:
        box = Outbox(c)
        box.transfer(time.time_ns(), a.source, a.target, a.cents)
        box.pending().show()
        box.relay_once(c.topology.read(a.source))
    c.balances().where(F.col("tenant_id").isin(a.source, a.target)).show()


def orphans(spark: SparkSession, a: argparse.Namespace) -> None:
    tp = TwoPhase(open_cluster(spark, a))
    for shard, gid, age in tp.orphans():
        print(shard, gid, f"{age:.1f} s")
    if a.resolve:
        print("rolled back:", tp.resolve())


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    c = open_cluster(spark, a)
    c.misplaced().orderBy("shard").show()
    Outbox(c).pending().orderBy("shard").show()


def reshard(spark: SparkSession, a: argparse.Namespace) -> None:
    place = T.load_or_init(spark, f"{a.root}/placement.json", T.LOGICAL, a.shards)
    c = Cluster(spark, a.root, place, shards=list(range(2 * a.shards))).create()
    job = Reshard(c, f"{a.root}/placement.json")
    if a.status:
        job.status().groupBy("shard").agg(F.count("*").alias("logical"), F.count("moving_to").alias("moving")).orderBy("shard").show()
    else:
        job.run(a.shards, a.fail_after)


def demo(spark: SparkSession, a: argparse.Namespace) -> None:
    a.sample, a.tenants, a.per_tenant, a.seed, a.allow_partial = 10_000, 50, 10, 42, False
    a.tenant, a.cursor, a.limit, a.mode, a.source, a.target, a.cents = 1, "", 5, "outbox", 1, 2, 500
    for step in (topology, seed, show_tenant, count, page, transfer, audit):
        print(f"--- {step.__name__}")
        step(spark, a)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--root", default="./cluster")
    p.add_argument("--shards", type=int, default=4)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, fn, *options: tuple[str, dict]) -> None:
        q = sub.add_parser(name)
        for flag, kw in options:
            q.add_argument(flag, **kw)
        q.set_defaults(fn=fn)

    number = lambda default: {"type": int, "default": default}
    verb("topology", topology, ("--sample", number(100_000)))
    verb("seed", seed, ("--tenants", number(500)), ("--per-tenant", number(40)), ("--seed", number(42)))
    verb("stats", lambda s, a: open_cluster(s, a).stats().orderBy("shard").show())
    verb("tenant", show_tenant, ("tenant", {"type": int}))
    verb("count", count, ("--allow-partial", {"action": "store_true"}))
    verb("page", page, ("--limit", number(5)), ("--cursor", {"default": ""}))
    verb("ids", ids, ("--shard", number(0)), ("-n", number(5)))
    verb("transfer", transfer, ("mode", {"choices": ["2pc", "outbox"]}), ("source", {"type": int}), ("target", {"type": int}), ("cents", {"type": int}))
    verb("orphans", orphans, ("--resolve", {"action": "store_true"}))
    verb("audit", audit)
    verb("reshard", reshard, ("--fail-after", number(None)), ("--status", {"action": "store_true"}))
    verb("demo", demo)
    a = p.parse_args(argv)
    spark = build_session("tidewell-cli")
    spark.sparkContext.setLogLevel("ERROR")
    a.fn(spark, a)


if __name__ == "__main__":
    main()
