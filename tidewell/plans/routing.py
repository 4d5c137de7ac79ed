"""Tenant keys, topologies, hash and list placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions.hashing import fenced, unsigned_text, with_key
from tidewell.operators import partitions as P
from tidewell.operators import topology as T
from tidewell.sources import tables as S

TWO64 = "18446744073709551616"


def key_sql(t: str) -> str:
    """The tenant key in SQL with wide integers."""
    return (
        f"list_reduce([14695981039346656037::HUGEINT] || list_transform(range(8), lambda j: ((({t})::BIGINT >> (56 - 8 * j)::INT) & 255)::HUGEINT),"
        f" lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % {TWO64}::HUGEINT)"
    )


def fmix_sql(x: str) -> str:
    step = lambda v, c: f"((xor({v}, {v} // 8589934592::UHUGEINT) * {c}::UHUGEINT) % {TWO64}::UHUGEINT)"
    return f"(SELECT xor(z, z // 8589934592::UHUGEINT) FROM (SELECT {step('y', '14181476777654086739')} AS z FROM (SELECT {step('x', '18397679294719823053')} AS y FROM (SELECT ({x})::UHUGEINT AS x))))"


EVEN4 = "CAST(({l}) // 256 AS INTEGER)"
TENANTS_SQL = f"t AS (SELECT c_custkey AS tenant_id, {key_sql('c_custkey')} AS k FROM customer)"


def tenants(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"))


@query("hash_golden", f"SELECT tenant_id, CAST({key_sql('tenant_id')} AS VARCHAR) AS key FROM (VALUES (1::BIGINT), (2), (42), (1000000), (9223372036854775807)) v(tenant_id)")
def hash_golden(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(1,), (2,), (42,), (1000000,), ((1 << 63) - 1,)], "tenant_id long")
    return with_key(t).select("tenant_id", unsigned_text(F.col("key")).alias("key"))


@query("route_modn", f"WITH {TENANTS_SQL} SELECT tenant_id, CAST(k % 8 AS INTEGER) AS shard8, CAST(k % 5 AS INTEGER) AS shard5 FROM t")
def route_modn(spark: SparkSession, d: str) -> DataFrame:
    return T.ModN(5).with_shard(T.ModN(8).with_shard(tenants(spark, d), out="shard8"), out="shard5")


@query(
    "route_directory",
    f"""WITH {TENANTS_SQL}, l AS (SELECT tenant_id, CAST(k % 1024 AS INTEGER) AS logical_shard FROM t)
  SELECT tenant_id, logical_shard, CASE tenant_id WHEN 42 THEN 7 WHEN 77 THEN 6 ELSE {EVEN4.format(l="logical_shard")} END AS shard FROM l""",
)
def route_directory(spark: SparkSession, d: str) -> DataFrame:
    directory = T.Directory.even(1024, 4).pin(42, 7).pin(77, 6)
    return directory.with_place(tenants(spark, d))


def ring_sql(shards: int, vnodes: int) -> str:
    return f"""p AS (SELECT {fmix_sql(key_sql("(s::BIGINT << 32) | i::BIGINT"))} AS spot, s::INTEGER AS shard FROM range({shards}) a(s), range({vnodes}) b(i))"""


@query(
    "route_ring",
    f"""WITH {TENANTS_SQL}, {ring_sql(4, 200)}, h AS (SELECT tenant_id, {fmix_sql("k")} AS h FROM t),
  j AS (SELECT tenant_id, shard FROM h ASOF LEFT JOIN p ON h.h <= p.spot)
  SELECT tenant_id, coalesce(shard, (SELECT arg_min(shard, spot) FROM p)) AS shard FROM j""",
)
def route_ring(spark: SparkSession, d: str) -> DataFrame:
    return T.Ring((0, 1, 2, 3)).with_shard(tenants(spark, d))


SAMPLE = 5000
_SAMPLE_SQL = f"t AS (SELECT i AS tenant_id, {key_sql('i')} AS k FROM range(1, {SAMPLE + 1}) r(i))"


def topologies() -> dict[str, tuple[T.Topology, T.Topology]]:
    four = T.Directory.even(1024, 4)
    return {"mod 4 to 8": (T.ModN(4), T.ModN(8)), "mod 4 to 5": (T.ModN(4), T.ModN(5)), "ring 4 to 8": (T.Ring((0, 1, 2, 3)), T.Ring(tuple(range(8)))), "directory split": (four, T.split(four, 4))}


_RING_BOTH = f"""q AS (SELECT {fmix_sql(key_sql("(s::BIGINT << 32) | i::BIGINT"))} AS spot, s::INTEGER AS shard FROM range(8) a(s), range(200) b(i)),
  h AS (SELECT tenant_id, {fmix_sql("k")} AS h FROM t),
  r8 AS (SELECT tenant_id, coalesce(shard, (SELECT arg_min(shard, spot) FROM q)) AS b FROM h ASOF LEFT JOIN q ON h.h <= q.spot),
  q4 AS (SELECT * FROM q WHERE shard < 4),
  r4 AS (SELECT tenant_id, coalesce(shard, (SELECT arg_min(shard, spot) FROM q4)) AS a FROM h ASOF LEFT JOIN q4 ON h.h <= q4.spot)"""


@query(
    "churn_report",
    f"""WITH {_SAMPLE_SQL}, {_RING_BOTH}, m AS (
    SELECT 'mod 4 to 8' AS change, k % 4 <> k % 8 AS moved FROM t
    UNION ALL SELECT 'mod 4 to 5', k % 4 <> k % 5 FROM t
    UNION ALL SELECT 'directory split', (k % 1024) % 256 >= 128 FROM t
    UNION ALL SELECT 'ring 4 to 8', a <> b FROM r4 JOIN r8 USING (tenant_id))
  SELECT change, count(*) AS tenants, CAST(count(*) FILTER (WHERE moved) AS BIGINT) AS moved, count(*) FILTER (WHERE moved) / count(*)::DOUBLE AS share FROM m GROUP BY 1""",
)
def churn_report(spark: SparkSession, d: str) -> DataFrame:
    parts = [T.churn(spark, a, b, SAMPLE).withColumn("change", F.lit(n)) for n, (a, b) in topologies().items()]
    return reduce(DataFrame.unionByName, parts).select("change", "tenants", "moved", "share")


@query(
    "balance_report",
    f"""WITH {_SAMPLE_SQL}, {_RING_BOTH} SELECT topology, shard, count(*) AS tenants FROM (
    SELECT 'mod-8' AS topology, CAST(k % 8 AS INTEGER) AS shard FROM t
    UNION ALL SELECT 'directory-4', CAST((k % 1024) // 256 AS INTEGER) FROM t
    UNION ALL SELECT 'ring-8', b FROM r8) GROUP BY 1, 2""",
)
def balance_report(spark: SparkSession, d: str) -> DataFrame:
    some = [T.ModN(8), T.Directory.even(1024, 4), T.Ring(tuple(range(8)))]
    return reduce(DataFrame.unionByName, [T.distribution(spark, t, SAMPLE).withColumn("topology", F.lit(t.name)) for t in some]).select("topology", "shard", "tenants")


@query("hash_partition_rows", f"SELECT 'h' || CAST({key_sql('o_custkey')} % 8 AS VARCHAR) AS partition, count(*) AS rows, count(DISTINCT o_custkey) AS distinct_tenants FROM orders GROUP BY 1")
def hash_partition_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tenants are counted before they are hashed: a key a tenant, not a row."""
    spec = P.HashSpec(modulus=8)
    by_tenant = S.orders(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"))
    return spec.route(by_tenant, spec.initial(), "partition").groupBy("partition").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_tenants"))


WHALES = P.ListSpec(values=(1, 2))


def _listed(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    """Rows by tenant and partition; tenants are counted before they are routed."""
    t = S.skewed_events(spark, d).where(where).groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("cents"))
    return fenced(WHALES.route(t, WHALES.initial(), "partition"))


_LISTED_SQL = f"s AS (SELECT *, CAST(1 + (((event_id * 7919) % 1000) * ((event_id * 7919) % 1000) * ((event_id * 7919) % 1000) * 500) // 1000000000 AS BIGINT) AS tenant_id FROM events), l AS (SELECT *, CASE WHEN tenant_id IN (1, 2) THEN 'v' || tenant_id ELSE 'r' || CAST({key_sql('tenant_id')} % 4 AS VARCHAR) END AS partition FROM s)"


@query("list_hash_tree_rows", f"WITH {_LISTED_SQL} SELECT partition, count(*) AS rows FROM l GROUP BY 1")
def list_hash_tree_rows(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).groupBy("partition").agg(F.sum("n").alias("rows"))


@query("list_split_imbalance", f"WITH {_LISTED_SQL}, p AS (SELECT partition, count(*) AS n FROM l GROUP BY 1) SELECT max(n) AS largest, min(n) AS smallest, round(max(n)::DOUBLE / greatest(min(n), 1)::DOUBLE, 2) AS imbalance FROM p")
def list_split_imbalance(spark: SparkSession, d: str) -> DataFrame:
    n = _listed(spark, d).groupBy("partition").agg(F.sum("n").alias("n"))
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("imbalance", F.round(F.col("largest").cast("double") / F.greatest("smallest", F.lit(1)).cast("double"), 2))


@query("whale_count", f"WITH {_LISTED_SQL} SELECT count(*) AS rows, CAST(sum(round(value * 100)) AS BIGINT) AS amount_cents FROM l WHERE tenant_id = 1 AND partition = 'v1'")
def whale_count(spark: SparkSession, d: str) -> DataFrame:
    """The tenant has a partition of its own, so nothing need be hashed to find its rows."""
    if WHALES.touched(WHALES.initial(), equals=1) != ["v1"]:
        raise P.PartitionError("tenant 1 should have a partition of its own")
    return S.skewed_events(spark, d).where("tenant_id = 1").agg(F.count("*").alias("rows"), F.sum("amount_cents").alias("amount_cents"))


@query("long_tail_count", f"WITH {_LISTED_SQL} SELECT partition, count(*) AS rows FROM l WHERE tenant_id = 400 GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM l WHERE tenant_id > 2")
def long_tail_count(spark: SparkSession, d: str) -> DataFrame:
    one = _listed(spark, d, "tenant_id = 400").select("partition", F.col("n").alias("rows"))
    tail = S.skewed_events(spark, d).where("tenant_id > 2").agg(F.count("*").alias("rows"))
    return one.unionByName(tail.withColumn("partition", F.lit("all")))


@query(
    "dual_write_targets",
    f"""WITH {TENANTS_SQL}, l AS (SELECT tenant_id, CAST(k % 1024 AS INTEGER) AS g FROM t)
  SELECT tenant_id, CASE WHEN tenant_id = 42 THEN [7] WHEN g % 256 >= 128 THEN [g // 256, g // 256 + 4] ELSE [g // 256] END::INTEGER[] AS targets FROM l""",
)
def dual_write_targets(spark: SparkSession, d: str) -> DataFrame:
    directory = T.Directory.even(1024, 4).pin(42, 7)
    for logical, target in T.split_moves(T.Directory.even(1024, 4), 4):
        directory = directory.begin_move(logical, target)
    return directory.with_targets(tenants(spark, d))


@query("route_explain", f"SELECT 1::BIGINT AS tenant_id, CAST({key_sql('1')} AS VARCHAR) AS hash, CAST({key_sql('1')} % 1024 AS INTEGER) AS logical_shard, CAST(({key_sql('1')} % 1024) // 256 AS INTEGER) AS shard, [CAST(({key_sql('1')} % 1024) // 256 AS INTEGER)] AS targets, false AS pinned")
def route_explain(spark: SparkSession, d: str) -> DataFrame:
    return T.explain_route(spark, T.Directory.even(1024, 4), 1)
