"""Keyset feeds and time-ordered ids."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions.ids import EPOCH_MS, decode_id_columns, encode_id_column
from tidewell.operators.feed import Cursor, newest_first, page
from tidewell.sources import tables as S

_PAGE = "SELECT o_orderkey AS id, o_custkey AS tenant_id, o_orderdate AS created_at FROM orders"
#: a position in the middle of many equal times
AT = Cursor(datetime(1998, 6, 1), 500)


def feed(spark: SparkSession, d: str) -> DataFrame:
    return S.orders(spark, d).select("id", "tenant_id", F.col("placed_at").alias("created_at"))


@query("feed_page1", f"{_PAGE} ORDER BY created_at DESC, id DESC LIMIT 20")
def feed_page1(spark: SparkSession, d: str) -> DataFrame:
    return page(feed(spark, d), None, 20)


@query("feed_page2", f"{_PAGE} WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 500) ORDER BY created_at DESC, id DESC LIMIT 20")
def feed_page2(spark: SparkSession, d: str) -> DataFrame:
    return page(feed(spark, d), AT, 20)


@query("feed_offset", f"{_PAGE} ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def feed_offset(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, d).orderBy(*newest_first()).offset(40).limit(20)


@query("feed_behind_cursor", "SELECT count(*) AS rows, max(o_orderdate) AS newest FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 500)")
def feed_behind_cursor(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.operators.feed import after

    return feed(spark, d).where(after(AT)).agg(F.count("*").alias("rows"), F.max("created_at").alias("newest"))


@query("feed_amplification", "SELECT least(count(*), 20) AS returned, 80 AS fetched, 80 / least(count(*), 20)::DOUBLE AS amplification FROM orders")
def feed_amplification(spark: SparkSession, d: str) -> DataFrame:
    """What a page of 20 fetches from four shards, for each row that it returns."""
    n = page(feed(spark, d), None, 20).agg(F.count("*").alias("returned"))
    return n.select("returned", F.lit(80).alias("fetched"), (F.lit(80) / F.col("returned")).alias("amplification"))


@query("snowflake_encode", f"SELECT event_id, (epoch_us(ts) // 1000 - {EPOCH_MS}) * 4194304 + (user_id % 1024) * 4096 + event_id % 4096 AS id FROM events")
def snowflake_encode(spark: SparkSession, d: str) -> DataFrame:
    e = S.table(spark, d, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - EPOCH_MS
    return e.select("event_id", encode_id_column(ms, F.col("user_id") % 1024, F.col("event_id") % 4096).alias("id"))


@query("snowflake_decode", "SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS id_ms, CAST(user_id % 1024 AS INTEGER) AS id_shard, CAST(event_id % 4096 AS INTEGER) AS id_seq FROM events")
def snowflake_decode(spark: SparkSession, d: str) -> DataFrame:
    made = snowflake_encode(spark, d)
    return made.select("event_id", *(c.alias(n) for n, c in decode_id_columns(F.col("id")).items()))
