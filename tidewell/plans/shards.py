"""Orders on shards: fan-out aggregates, audits, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions.hashing import fenced
from tidewell.operators import topology as T
from tidewell.plans.events import since
from tidewell.plans.routing import key_sql
from tidewell.sources import tables as S

_O = f"o AS (SELECT o_orderkey AS id, o_custkey AS tenant_id, o_orderdate AS placed_at, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderstatus AS state, {key_sql('o_custkey')} AS k FROM orders)"
_P = f"{_O}, p AS (SELECT *, CAST(k % 1024 AS INTEGER) AS logical_shard, CAST((k % 1024) // 256 AS INTEGER) AS shard FROM o)"
FOUR = T.Directory.even(1024, 4)


def placed(spark: SparkSession, d: str, directory: T.Directory = FOUR) -> DataFrame:
    return directory.with_place(S.orders(spark, d))


def by_tenant(spark: SparkSession, d: str, *keys: str, **aggs: F.Column) -> DataFrame:
    """Orders summed by tenant, and then placed: a key a tenant, not a row."""
    some = S.orders(spark, d).groupBy("tenant_id", *keys).agg(*(c.alias(n) for n, c in aggs.items()))
    return fenced(FOUR.with_place(some))


@query("orders_state_recent", f"WITH {_O} SELECT state, count(*) AS orders FROM o WHERE placed_at >= TIMESTAMP '{S.ORDERS_AS_OF}' - INTERVAL 365 DAY GROUP BY 1")
def orders_state_recent(spark: SparkSession, d: str) -> DataFrame:
    return S.orders(spark, d).where(since(365, "placed_at", S.ORDERS_AS_OF)).groupBy("state").agg(F.count("*").alias("orders"))


@query("shard_stats", f"WITH {_P} SELECT shard, count(*) AS rows, count(DISTINCT tenant_id) AS tenants, min(id) AS first_id, max(id) AS last_id FROM p GROUP BY 1")
def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    t = by_tenant(spark, d, n=F.count("*"), a=F.min("id"), z=F.max("id"))
    return t.groupBy("shard").agg(F.sum("n").alias("rows"), F.count("*").alias("tenants"), F.min("a").alias("first_id"), F.max("z").alias("last_id"))


@query("state_counts_scatter", f"WITH {_P} SELECT state, CAST(sum(n) AS BIGINT) AS orders, count(*) AS shards FROM (SELECT shard, state, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1")
def state_counts_scatter(spark: SparkSession, d: str) -> DataFrame:
    """By shard, then over shards."""
    by_shard = by_tenant(spark, d, "state", n=F.count("*")).groupBy("shard", "state").agg(F.sum("n").alias("n"))
    return by_shard.groupBy("state").agg(F.sum("n").alias("orders"), F.count("*").alias("shards"))


@query("tenant_summary", f"WITH {_P} SELECT count(*) AS orders, CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS total_cents FROM p WHERE tenant_id = 17")
def tenant_summary(spark: SparkSession, d: str) -> DataFrame:
    """The shard follows from the tenant, so the predicate on it is added."""
    one = placed(spark, d).where((F.col("tenant_id") == 17) & (F.col("shard") == FOUR.read(17)))
    return one.agg(F.count("*").alias("orders"), F.coalesce(F.sum("total_cents"), F.lit(0)).alias("total_cents"))


def misplaced(rows: DataFrame, directory: T.Directory) -> DataFrame:
    """Rows (shard, tenant_id, n) by shard that belong elsewhere."""
    wrong = F.when(F.col("home") != F.col("shard"), F.col("n")).otherwise(0)
    return fenced(directory.with_shard(rows, out="home")).groupBy("shard").agg(F.sum(wrong).alias("misplaced"))


@query("misplaced_after_split", f"WITH {_P} SELECT shard, CAST(count(*) FILTER (WHERE logical_shard % 256 >= 128) AS BIGINT) AS misplaced FROM p GROUP BY 1")
def misplaced_after_split(spark: SparkSession, d: str) -> DataFrame:
    return misplaced(by_tenant(spark, d, n=F.count("*")), T.split(FOUR, 4))


@query("logical_range_migration", f"WITH {_P} SELECT logical_shard, count(*) AS rows FROM p WHERE logical_shard BETWEEN 128 AND 255 GROUP BY 1")
def logical_range_migration(spark: SparkSession, d: str) -> DataFrame:
    return by_tenant(spark, d, n=F.count("*")).where(F.col("logical_shard").between(128, 255)).groupBy("logical_shard").agg(F.sum("n").alias("rows"))


@query("reshard_plan", "SELECT CAST(i AS INTEGER) AS logical_shard, CAST(i // 256 AS INTEGER) AS source, CAST(i // 256 + 4 AS INTEGER) AS target FROM range(1024) r(i) WHERE i % 256 >= 128")
def reshard_plan(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, FOUR.placement[i], t) for i, t in T.split_moves(FOUR, 4)], "logical_shard int, source int, target int")


@query(
    "reshard_verify",
    f"""WITH {_P} SELECT shard AS source, shard + 4 AS target, count(*) AS rows, CAST(sum((id + 2 * tenant_id + 3 * total_cents) % 1000000007) AS BIGINT) AS checksum
  FROM p WHERE logical_shard % 256 >= 128 GROUP BY 1, 2""",
)
def reshard_verify(spark: SparkSession, d: str) -> DataFrame:
    """What both sides of each move have to agree on."""
    total = (F.col("id") + 2 * F.col("tenant_id") + 3 * F.col("total_cents")) % 1_000_000_007
    t = by_tenant(spark, d, n=F.count("*"), c=F.sum(total))
    moved = fenced(T.split(FOUR, 4).with_shard(t, out="target")).where("target <> shard")
    return moved.groupBy(F.col("shard").alias("source"), "target").agg(F.sum("n").alias("rows"), F.sum("c").alias("checksum"))


# ---- joins


@query("join_on_key", "SELECT o_orderstatus AS state, count(*) AS items, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_on_key(spark: SparkSession, d: str) -> DataFrame:
    """Items are summed by order before they are joined, so less is exchanged."""
    o = S.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"))
    items = S.table(spark, d, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    by = items.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("c").alias("c"))
    return o.join(by, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("state").agg(F.sum("n").alias("items"), F.sum("c").alias("cents"))


@query("join_reference", "SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_reference(spark: SparkSession, d: str) -> DataFrame:
    """Small reference tables: 25 nations and 5 regions at any scale, so they are broadcast."""
    n, r = S.table(spark, d, "nation"), S.table(spark, d, "region")
    c = S.table(spark, d, "customer").select("c_nationkey")
    return (
        c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("customers"))
    )


@query("join_repartition", "SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_repartition(spark: SparkSession, d: str) -> DataFrame:
    """Not on the distribution key: orders are summed by customer first, so less moves."""
    by = S.orders(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"), F.sum("total_cents").alias("c"))
    c = S.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return by.join(c, F.col("tenant_id") == F.col("c_custkey")).groupBy("segment").agg(F.sum("n").alias("orders"), F.sum("c").alias("cents"))


@query("join_events_customers", "SELECT c_mktsegment AS segment, count(*) AS events FROM events JOIN customer ON user_id = c_custkey GROUP BY 1")
def join_events_customers(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"))
    c = S.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return e.join(c, F.col("tenant_id") == F.col("c_custkey")).groupBy("segment").agg(F.sum("n").alias("events"))


@query("anti_join_tenants", "SELECT c_custkey AS tenant_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def anti_join_tenants(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return c.join(S.events(spark, d).select("tenant_id"), "tenant_id", "left_anti")
