"""Transfers as plans over plain tables: every order moves money to another tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.operators.transfer import apply_events
from tidewell.sources import tables as S

OPENING = 1_000_000
_M = "m AS (SELECT o_orderkey AS id, o_custkey AS source, (o_custkey * 7 + 3) % (SELECT count(*) FROM customer) AS target, CAST(1 + o_orderkey % 900 AS BIGINT) AS cents FROM orders)"
_L = f"l AS (SELECT DISTINCT o_custkey AS tenant_id, {OPENING}::BIGINT AS balance_cents FROM orders)"


def moves(spark: SparkSession, d: str) -> DataFrame:
    """id, source, target and cents of a transfer for each order."""
    n = S.table(spark, d, "customer").agg(F.count("*").alias("n"))
    o = S.orders(spark, d).join(F.broadcast(n))  # one row
    return o.select("id", F.col("tenant_id").alias("source"), ((F.col("tenant_id") * 7 + 3) % F.col("n")).alias("target"), (1 + F.col("id") % 900).alias("cents"))


@query("applied_once", f"WITH {_M}, {_L} SELECT tenant_id, CAST(sum(c) AS BIGINT) AS balance_cents FROM (SELECT tenant_id, balance_cents AS c FROM l UNION ALL SELECT target, cents FROM m WHERE id % 3 <> 0) GROUP BY 1")
def applied_once(spark: SparkSession, d: str) -> DataFrame:
    """Balances after credits that each come twice and of which a third was applied before."""
    m = moves(spark, d).select("id", F.col("target").alias("tenant_id"), "cents")
    done = m.where("id % 3 = 0").select(F.col("id").alias("event_id"))
    return apply_events(S.ledger(S.orders(spark, d), OPENING), done, m.unionByName(m))
