"""Reports over events: windows, tenants, queues, skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.catalog import query
from tidewell.functions.misc import day_of, json_long
from tidewell.sources import tables as S

#: the same mapping in SQL, for the other engine
EVENTS_SQL = """e AS (SELECT event_id AS id, user_id AS tenant_id, ts AS occurred_at, event_type AS kind,
  CASE WHEN event_id % 25 < 2 THEN 'new' ELSE 'done' END AS status, CAST(round(value * 100) AS BIGINT) AS amount_cents, props AS payload FROM events)"""
SKEWED_SQL = """s AS (SELECT *, CAST(1 + (((event_id * 7919) % 1000) * ((event_id * 7919) % 1000) * ((event_id * 7919) % 1000) * 500) // 1000000000 AS BIGINT) AS tenant_id FROM events)"""
AS_OF = f"TIMESTAMP '{S.EVENTS_AS_OF}'"


def since(days: int, column: str = "occurred_at", as_of: str = S.EVENTS_AS_OF) -> F.Column:
    return F.col(column) >= F.expr(f"timestamp_ntz'{as_of}' - INTERVAL {days} DAYS")


def daily(events: DataFrame, days: int = 7) -> DataFrame:
    """Count and amount by day of the last days."""
    return events.where(since(days)).groupBy(day_of(F.col("occurred_at")).alias("day")).agg(F.count("*").alias("events"), F.sum("amount_cents").alias("amount_cents"))


@query("events_daily_recent", f"WITH {EVENTS_SQL} SELECT date_trunc('day', occurred_at)::TIMESTAMP AS day, count(*) AS events, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM e WHERE occurred_at >= {AS_OF} - INTERVAL 7 DAY GROUP BY 1 ORDER BY 1")
def events_daily_recent(spark: SparkSession, d: str) -> DataFrame:
    return daily(S.events(spark, d)).orderBy("day")


@query("tenant_recent_top50", f"WITH {EVENTS_SQL} SELECT id, occurred_at, kind, amount_cents FROM e WHERE tenant_id = 7 AND occurred_at >= {AS_OF} - INTERVAL 30 DAY ORDER BY occurred_at DESC, id DESC LIMIT 50")
def tenant_recent_top50(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d).where((F.col("tenant_id") == 7) & since(30))
    return e.select("id", "occurred_at", "kind", "amount_cents").orderBy(F.desc("occurred_at"), F.desc("id")).limit(50)


@query("events_count_all", "SELECT count(*) AS events FROM events")
def events_count_all(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).agg(F.count("*").alias("events"))


@query("events_window_totals", f"WITH {EVENTS_SQL} SELECT count(*) AS events, CAST(coalesce(sum(amount_cents), 0) AS BIGINT) AS amount_cents FROM e WHERE occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-17'")
def events_window_totals(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("occurred_at")
    e = S.events(spark, d).where((c >= F.expr("timestamp_ntz'2024-01-10'")) & (c < F.expr("timestamp_ntz'2024-01-17'")))
    return e.agg(F.count("*").alias("events"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("amount_cents"))


@query("events_by_tenant", f"WITH {EVENTS_SQL} SELECT tenant_id, count(*) AS events FROM e GROUP BY 1")
def events_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).groupBy("tenant_id").agg(F.count("*").alias("events"))


@query("events_by_kind_status", f"WITH {EVENTS_SQL} SELECT kind, status, count(*) AS events, CAST(sum(CASE WHEN status <> 'done' THEN amount_cents ELSE 0 END) AS BIGINT) AS open_cents FROM e GROUP BY 1, 2")
def events_by_kind_status(spark: SparkSession, d: str) -> DataFrame:
    open_ = F.when(F.col("status") != "done", F.col("amount_cents")).otherwise(0)
    return S.events(spark, d).groupBy("kind", "status").agg(F.count("*").alias("events"), F.sum(open_).alias("open_cents"))


@query("open_queue", f"WITH {EVENTS_SQL} SELECT id, tenant_id, occurred_at, kind FROM e WHERE status <> 'done' AND payload IS NOT NULL")
def open_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.open_rows(S.events(spark, d)).where(F.col("payload").isNotNull()).select("id", "tenant_id", "occurred_at", "kind")


@query("payload_json_rollup", f"WITH {EVENTS_SQL} SELECT kind, count(*) AS events, CAST(sum(CAST(payload->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(payload->>'$.k' AS BIGINT)) AS k_max FROM e GROUP BY 1")
def payload_json_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = json_long(F.col("payload"), "$.k")
    return S.events(spark, d).groupBy("kind").agg(F.count("*").alias("events"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("events_parameterised", f"WITH {EVENTS_SQL} SELECT kind, count(*) AS events FROM e WHERE tenant_id = 3 AND occurred_at >= TIMESTAMP '2024-01-05' GROUP BY 1")
def events_parameterised(spark: SparkSession, d: str) -> DataFrame:
    """Bound parameters; the plan is pruned as if they were written out."""
    return spark.sql(
        "SELECT kind, count(*) AS events FROM {e} WHERE tenant_id = :tenant AND occurred_at >= :since GROUP BY kind",
        args={"tenant": 3, "since": F.expr("timestamp_ntz'2024-01-05'")},
        e=S.events(spark, d),
    )


@query("tenant_in_list", f"WITH {EVENTS_SQL} SELECT tenant_id, count(*) AS events FROM e WHERE tenant_id IN (1, 5, 9) GROUP BY 1")
def tenant_in_list(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).where(F.col("tenant_id").isin(1, 5, 9)).groupBy("tenant_id").agg(F.count("*").alias("events"))


@query("tenant_between", f"WITH {EVENTS_SQL} SELECT count(*) AS events, count(DISTINCT tenant_id) AS tenants FROM e WHERE tenant_id BETWEEN 2 AND 11")
def tenant_between(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).where(F.col("tenant_id").between(2, 11)).agg(F.count("*").alias("events"), F.countDistinct("tenant_id").alias("tenants"))


@query("latest_event_per_tenant", f"WITH {EVENTS_SQL} SELECT tenant_id, id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY occurred_at DESC, id DESC) AS rn FROM e) WHERE rn = 1")
def latest_event_per_tenant(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("tenant_id").orderBy(F.desc("occurred_at"), F.desc("id"))
    return S.events(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("tenant_id", "id", "occurred_at")


@query("latest_event_per_kind", f"WITH {EVENTS_SQL} SELECT kind, id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY occurred_at DESC, id DESC) AS rn FROM e) WHERE rn = 1")
def latest_event_per_kind(spark: SparkSession, d: str) -> DataFrame:
    """The window on a column of few values: as an aggregate it needs no sort of a whole value's rows."""
    last = F.max(F.struct("occurred_at", "id")).alias("m")
    return S.events(spark, d).groupBy("kind").agg(last).select("kind", "m.id", "m.occurred_at")


def with_total(counts: DataFrame, n: str) -> DataFrame:
    """Beside each row the total over all: one row is broadcast, nothing is gathered."""
    return counts.join(F.broadcast(counts.agg(F.sum(n).alias("total"))))


@query("tenant_skew_top15", f"WITH {SKEWED_SQL} SELECT tenant_id, rows, round(100.0::DOUBLE * rows / sum(rows) OVER (), 2) AS pct_of_table FROM (SELECT tenant_id, count(*) AS rows FROM s GROUP BY 1) ORDER BY rows DESC, tenant_id LIMIT 15")
def tenant_skew_top15(spark: SparkSession, d: str) -> DataFrame:
    counts = S.skewed_events(spark, d).groupBy("tenant_id").agg(F.count("*").alias("rows"))
    share = F.round(F.lit(100.0) * F.col("rows") / F.col("total"), 2)
    return with_total(counts, "rows").select("tenant_id", "rows", share.alias("pct_of_table")).orderBy(F.desc("rows"), "tenant_id").limit(15)


@query(
    "skew_top_percent",
    f"""WITH {SKEWED_SQL}, t AS (SELECT tenant_id, count(*) AS n FROM s GROUP BY 1), r AS (SELECT n, ntile(100) OVER (ORDER BY n DESC, tenant_id) AS b FROM t)
  SELECT CAST(sum(n) FILTER (WHERE b = 1) AS BIGINT) AS top_1pct_rows, CAST(sum(n) AS BIGINT) AS all_rows,
    round(100.0::DOUBLE * (sum(n) FILTER (WHERE b = 1))::DOUBLE / sum(n)::DOUBLE, 2) AS top_1pct_share FROM r""",
)
def skew_top_percent(spark: SparkSession, d: str) -> DataFrame:
    """The first hundredth of the tenants by size: its length follows from their
    number, so a top-k serves and no window runs over all tenants at once."""
    t = S.skewed_events(spark, d).groupBy("tenant_id").agg(F.count("*").alias("n"))
    total = t.agg(F.count("*").alias("tenants"), F.sum("n").alias("all_rows"))
    head = ranked(t, "n", "tenant_id").join(F.broadcast(total)).where(F.col("place") <= F.ceil(F.col("tenants") / 100))
    return head.agg(F.sum("n").alias("top_1pct_rows"), F.max("all_rows").alias("all_rows")).select(
        "top_1pct_rows", "all_rows", F.round(F.lit(100.0) * F.col("top_1pct_rows").cast("double") / F.col("all_rows").cast("double"), 2).alias("top_1pct_share")
    )


def ranked(t: DataFrame, size: str, tie: str) -> DataFrame:
    """``place`` of each row by descending size.  Rows of one size are counted first,
    so the running sum is over distinct sizes, not rows.  Where sizes are counts, there
    are at most sqrt(2 n) different ones for n rows counted (1.4 million for 10**12),
    which bounds the broadcast and the window without a partition key."""
    sizes = t.groupBy(size).agg(F.count("*").alias("__k"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__k").over(Window.orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(size, "__before")
    inner = F.row_number().over(Window.partitionBy(size).orderBy(tie))
    return t.join(F.broadcast(before), size).withColumn("place", F.col("__before") + inner).drop("__before")


@query(
    "partition_imbalance",
    f"""WITH {SKEWED_SQL}, p AS (SELECT tenant_id % 8 AS part, count(*) AS n FROM s GROUP BY 1)
  SELECT min(n) AS smallest, max(n) AS largest, round(max(n)::DOUBLE / greatest(min(n), 1)::DOUBLE, 2) AS imbalance_ratio FROM p""",
)
def partition_imbalance(spark: SparkSession, d: str) -> DataFrame:
    p = S.skewed_events(spark, d).groupBy((F.col("tenant_id") % 8).alias("part")).agg(F.count("*").alias("n"))
    return p.agg(F.min("n").alias("smallest"), F.max("n").alias("largest")).withColumn("imbalance_ratio", F.round(F.col("largest").cast("double") / F.greatest("smallest", F.lit(1)).cast("double"), 2))


@query("distinct_key_vs_nonkey", "SELECT count(DISTINCT user_id) AS tenants, count(DISTINCT event_id) AS ids, count(DISTINCT event_type) AS kinds FROM events")
def distinct_key_vs_nonkey(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d)
    # one aggregate each, side by side: together they would expand each row threefold
    one = lambda c, n: e.agg(F.countDistinct(c).alias(n))
    return one("tenant_id", "tenants").join(one("id", "ids")).join(one("kind", "kinds"))


@query("distinct_tenants", "SELECT DISTINCT user_id AS tenant_id FROM events")
def distinct_tenants(spark: SparkSession, d: str) -> DataFrame:
    return S.events(spark, d).select("tenant_id").distinct()


@query("daily_summary_table", f"WITH {EVENTS_SQL} SELECT tenant_id, date_trunc('day', occurred_at)::TIMESTAMP AS day, count(*) AS events, CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM e GROUP BY 1, 2")
def daily_summary_table(spark: SparkSession, d: str) -> DataFrame:
    """What a refreshed summary table would hold."""
    return S.events(spark, d).groupBy("tenant_id", day_of(F.col("occurred_at")).alias("day")).agg(F.count("*").alias("events"), F.sum("amount_cents").alias("amount_cents"))


@query("publication_filter", f"WITH {EVENTS_SQL} SELECT id, tenant_id, amount_cents FROM e WHERE tenant_id % 4 = 1 AND kind = 'purchase'")
def publication_filter(spark: SparkSession, d: str) -> DataFrame:
    return S.publication(S.events(spark, d), ["id", "tenant_id", "amount_cents"], (F.col("tenant_id") % 4 == 1) & (F.col("kind") == "purchase"))


@query("publication_verify", f"WITH {EVENTS_SQL} SELECT count(*) AS rows, CAST(coalesce(sum((id + 2 * tenant_id + 3 * amount_cents) % 1000000007), 0) AS BIGINT) AS checksum FROM e")
def publication_verify(spark: SparkSession, d: str) -> DataFrame:
    return S.fingerprint(S.events(spark, d), ["id", "tenant_id", "amount_cents"])


@query("semi_join_ids", f"WITH {EVENTS_SQL} SELECT id, tenant_id FROM e WHERE id IN (SELECT id FROM e WHERE status = 'new' ORDER BY id LIMIT 100)")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    e = S.events(spark, d)
    first = e.where("status = 'new'").orderBy("id").limit(100).select("id")
    return e.join(F.broadcast(first), "id", "left_semi").select("id", "tenant_id")


@query("scalar_subquery_share", "SELECT c.c_custkey AS tenant_id, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders FROM customer c")
def scalar_subquery_share(spark: SparkSession, d: str) -> DataFrame:
    """A correlated count, decorrelated to one aggregate and an outer join."""
    n = S.orders(spark, d).groupBy("tenant_id").agg(F.count("*").alias("orders"))
    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return c.join(n, "tenant_id", "left").select("tenant_id", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("series_days", "SELECT CAST(i AS BIGINT) AS n, TIMESTAMP '2024-01-01' + to_days(CAST(i - 1 AS INTEGER)) AS day FROM generate_series(1, 31) AS g(i)")
def series_days(spark: SparkSession, d: str) -> DataFrame:
    return S.series(spark, 1, 31).select("n", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(n - 1 as int))").alias("day"))
