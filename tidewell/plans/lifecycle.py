"""Partitions over time: routing, pruning, retention, attach checks, rewrites."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions.misc import month_name
from tidewell.operators import partitions as P
from tidewell.operators.store import Store
from tidewell.plans.events import EVENTS_SQL, since
from tidewell.sources import tables as S

NOW = datetime.fromisoformat(S.ORDERS_AS_OF)
_MONTH = "'p_' || strftime(o_orderdate, '%Y_%m')"


def _declared(first: datetime, last: datetime, unit: str = "month") -> dict[str, dict]:
    out, at = {}, P.floor_to(unit, first)
    while at < last:
        out[P.range_name(unit, at)] = {"lo": at.isoformat(" "), "hi": P.step(unit, at, 1).isoformat(" "), "dirs": []}
        at = P.step(unit, at, 1)
    return out


@query("range_partition_rows", f"SELECT {_MONTH} AS partition, count(*) AS rows FROM orders GROUP BY 1")
def range_partition_rows(spark: SparkSession, d: str) -> DataFrame:
    spec = P.RangeSpec("placed_at", "month")
    routed = spec.route(S.orders(spark, d), _declared(datetime(1995, 1, 1), NOW), "partition")
    return routed.groupBy("partition").agg(F.count("*").alias("rows"))


@query("default_partition_rows", f"SELECT CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN {_MONTH} ELSE '__default__' END AS partition, count(*) AS rows FROM orders GROUP BY 1")
def default_partition_rows(spark: SparkSession, d: str) -> DataFrame:
    """One declared year; all else goes to the default."""
    spec = P.RangeSpec("placed_at", "month")
    parts = _declared(datetime(1997, 1, 1), datetime(1998, 1, 1)) | {P.DEFAULT: {"dirs": []}}
    return spec.route(S.orders(spark, d), parts, "partition").groupBy("partition").agg(F.count("*").alias("rows"))


@query("range_pruned_window", "SELECT count(*) AS orders, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS total_cents FROM orders WHERE o_orderdate >= TIMESTAMP '1999-03-10' AND o_orderdate < TIMESTAMP '1999-05-02'")
def range_pruned_window(spark: SparkSession, d: str) -> DataFrame:
    """The window on a partitioned table names the partitions too."""
    spec = P.RangeSpec("placed_at", "month")
    parts = _declared(datetime(1995, 1, 1), NOW)
    lo, hi = datetime(1999, 3, 10), datetime(1999, 5, 2)
    c = F.col("placed_at")
    rows = S.orders(spark, d).where((c >= F.lit(str(lo)).cast("timestamp_ntz")) & (c < F.lit(str(hi)).cast("timestamp_ntz")))
    rows = spec.route(rows, parts, "partition").where(F.col("partition").isin(spec.touched(parts, lo, hi)))
    return rows.agg(F.count("*").alias("orders"), F.sum("total_cents").alias("total_cents"))


@query("retention_doomed_count", f"WITH {EVENTS_SQL} SELECT count(*) AS doomed FROM e WHERE occurred_at < TIMESTAMP '{S.EVENTS_AS_OF}' - INTERVAL 20 DAY")
def retention_doomed_count(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).where(~since(20)).agg(F.count("*").alias("doomed"))


@query("retention_survivors", f"WITH {EVENTS_SQL} SELECT id, tenant_id, occurred_at FROM e WHERE NOT (occurred_at < TIMESTAMP '{S.EVENTS_AS_OF}' - INTERVAL 20 DAY)")
def retention_survivors(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).where(since(20)).select("id", "tenant_id", "occurred_at")


@query("update_tenth", f"WITH {EVENTS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN 'reopened' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN amount_cents + 1 ELSE amount_cents END AS amount_cents FROM e")
def update_tenth(spark: SparkSession, d: str) -> DataFrame:
    """Through a store: partitions by day, one update, the rows after it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    s = Store(spark, f"{base.rstrip('/')}/update-tenth-{uuid.uuid4().hex}")
    tx = s.begin().create("events", S.EVENTS, P.RangeSpec("occurred_at", "day"), default=True)
    tx.ensure("events", datetime.fromisoformat(S.EVENTS_AS_OF), ahead=0, back=30)
    tx.insert("events", S.events(spark, d)).commit()
    s.begin().update("events", F.col("id") % 10 == 0, {"status": F.lit("reopened"), "amount_cents": F.col("amount_cents") + 1}).commit()
    return s.scan("events").select("id", "status", "amount_cents")


@query("cross_partition_update", "SELECT strftime(CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '2001-07-15' ELSE o_orderdate END, '%Y_%m') AS month, count(*) AS rows FROM orders GROUP BY 1")
def cross_partition_update(spark: SparkSession, d: str) -> DataFrame:
    moved = S.orders(spark, d).withColumn("placed_at", F.when(F.col("id") % 50 == 0, F.expr("timestamp_ntz'2001-07-15'")).otherwise(F.col("placed_at")))
    return moved.groupBy(month_name(F.col("placed_at")).alias("month")).agg(F.count("*").alias("rows"))


def _plan(spark: SparkSession, rows: list[tuple[str, datetime, datetime]]) -> DataFrame:
    return spark.createDataFrame(rows, "partition string, lo timestamp_ntz, hi timestamp_ntz")


_MONTHS = "SELECT 'p_' || strftime(m, '%Y_%m') AS partition, m::TIMESTAMP AS lo, (m + INTERVAL 1 MONTH)::TIMESTAMP AS hi FROM (SELECT TIMESTAMP '{a}' + to_months(CAST(i AS INTEGER)) AS m FROM range({n}) r(i))"


@query("ensure_partitions_plan", _MONTHS.format(a="2001-08-01", n=4))
def ensure_partitions_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, P.month_plan(NOW, 0, 3))


@query("initial_partitions", _MONTHS.format(a="2000-07-01", n=15))
def initial_partitions(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, P.month_plan(NOW, 13, 1))


@query("retire_partitions_plan", f"SELECT DISTINCT {_MONTH} AS partition FROM orders WHERE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH <= date_trunc('month', TIMESTAMP '{S.ORDERS_AS_OF}') - INTERVAL 12 MONTH")
def retire_partitions_plan(spark: SparkSession, d: str) -> DataFrame:
    """Months that hold rows and end a year or more before this one."""
    months = S.orders(spark, d).select(F.date_trunc("month", "placed_at").cast("timestamp_ntz").alias("lo")).distinct()
    cutoff = P.step("month", P.floor_to("month", NOW), -12)
    old = months.where(F.add_months(F.col("lo").cast("date"), 1) <= F.lit(cutoff.date()))
    return old.select(F.concat(F.lit("p_"), month_name(F.col("lo"))).alias("partition"))


@query("maintenance_plan", "SELECT 'p_' || strftime(m, '%Y_%m_%d') AS partition, m >= TIMESTAMP '2024-01-17' AS kept FROM (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS m FROM range(35) r(i))")
def maintenance_plan(spark: SparkSession, d: str) -> DataFrame:
    """Daily partitions of a month and four ahead, of which fourteen days are kept."""
    now = datetime.fromisoformat(S.EVENTS_AS_OF)
    cutoff = P.step("day", P.floor_to("day", now), -14)
    return spark.createDataFrame([(n, hi > cutoff) for n, _, hi in P.month_plan(now, 30, 4, "day")], "partition string, kept boolean")


@query("newest_upper_bound", "SELECT (date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH)::TIMESTAMP AS newest FROM orders")
def newest_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    m = S.orders(spark, d).agg(F.max("placed_at").alias("m"))
    return m.select((F.date_trunc("month", "m").cast("timestamp_ntz") + F.expr("INTERVAL 1 MONTH")).alias("newest"))


_OUT = "o_orderdate IS NULL OR o_orderdate < TIMESTAMP '{a}' OR o_orderdate >= TIMESTAMP '{b}'"


def _violations(spark: SparkSession, d: str, where: str, lo: datetime, hi: datetime) -> DataFrame:
    rows = S.orders(spark, d).where(where)
    return rows.agg(F.count("*").alias("rows"), F.count(F.when(P.outside(F.col("placed_at"), lo, hi), 1)).alias("violations"))


@query("attach_validate_ok", f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_OUT.format(a='1996-01-01', b='1997-01-01')}) AS violations FROM orders WHERE year(o_orderdate) = 1996")
def attach_validate_ok(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d, "year(placed_at) = 1996", datetime(1996, 1, 1), datetime(1997, 1, 1))


@query("attach_validate_bad", f"SELECT count(*) AS rows, count(*) FILTER (WHERE {_OUT.format(a='1996-01-01', b='1996-07-01')}) AS violations FROM orders WHERE year(o_orderdate) = 1996")
def attach_validate_bad(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d, "year(placed_at) = 1996", datetime(1996, 1, 1), datetime(1996, 7, 1))


@query("anti_join_detached", f"SELECT DISTINCT {_MONTH} AS partition FROM orders WHERE year(o_orderdate) NOT IN (1999, 2000)")
def anti_join_detached(spark: SparkSession, d: str) -> DataFrame:
    """Months that hold rows but aren't among the attached ones."""
    held = S.orders(spark, d).select(F.concat(F.lit("p_"), month_name(F.col("placed_at"))).alias("partition")).distinct()
    attached = spark.createDataFrame([(n,) for n in _declared(datetime(1999, 1, 1), datetime(2001, 1, 1))], "partition string")
    return held.join(F.broadcast(attached), "partition", "left_anti")
