"""Queries that go through a store: partitions are written, pruned, changed, attached and retired.

Each builds what it needs in a folder of its own under the shared folder and
returns what the store then says.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.catalog import query
from tidewell.functions.hashing import with_key
from tidewell.functions.misc import human_bytes_column, like_literal
from tidewell.operators import joins as J
from tidewell.operators import partitions as P
from tidewell.operators.plans import Statements, touched_report
from tidewell.operators.store import NotAffectedError, Store
from tidewell.operators.summaries import create_daily, refresh_daily
from tidewell.plans.events import EVENTS_SQL
from tidewell.plans.lifecycle import NOW
from tidewell.plans.routing import key_sql
from tidewell.sources import tables as S

FIRST = datetime(1995, 1, 1)
EVENTS_NOW = datetime.fromisoformat(S.EVENTS_AS_OF)
_MONTHS = f"months AS (SELECT 'p_' || strftime(m, '%Y_%m') AS partition FROM (SELECT TIMESTAMP '1995-01-01' + to_months(CAST(i AS INTEGER)) AS m FROM range(80) r(i)) WHERE m <= TIMESTAMP '{S.ORDERS_AS_OF}')"
_O = "o AS (SELECT o_orderkey AS id, o_custkey AS tenant_id, o_orderdate AS placed_at, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderstatus AS state FROM orders)"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def monthly_orders(spark: SparkSession, d: str, rows: DataFrame | None = None) -> Store:
    """Orders by month, with a default."""
    s = Store(spark, folder(spark, "orders"))
    tx = s.begin().create("orders", S.ORDERS, P.RangeSpec("placed_at", "month"), unique=["id", "placed_at"], default=True)
    tx.ensure("orders", NOW, ahead=0, back=(NOW.year - FIRST.year) * 12 + NOW.month - FIRST.month)
    tx.insert("orders", S.orders(spark, d) if rows is None else rows, sort=["tenant_id", "placed_at"]).commit()
    return s


def daily_events(spark: SparkSession, d: str) -> Store:
    s = Store(spark, folder(spark, "events"))
    tx = s.begin().create("events", S.EVENTS, P.RangeSpec("occurred_at", "day"), default=True)
    tx.ensure("events", EVENTS_NOW, ahead=0, back=30)
    tx.insert("events", S.events(spark, d), sort=["tenant_id", "occurred_at"]).commit()
    return s


# ---- reading


@query(
    "stored_window",
    f"WITH {EVENTS_SQL} SELECT count(*) AS events, CAST(sum(amount_cents) AS BIGINT) AS amount_cents, 4 AS partitions_read, 32 AS partitions FROM e WHERE occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-12 12:00:00'",
)
def stored_window(spark: SparkSession, d: str) -> DataFrame:
    """A window on a table of daily partitions: three days and the default are read."""
    lo, hi = datetime(2024, 1, 10), datetime(2024, 1, 12, 12)
    tx = daily_events(spark, d).begin()
    rows = tx.scan("events", lo=lo, hi=hi).agg(F.count("*").alias("events"), F.sum("amount_cents").alias("amount_cents"))
    return rows.select("events", "amount_cents", F.lit(len(tx.touched("events", lo, hi))).alias("partitions_read"), F.lit(len(tx.touched("events"))).alias("partitions"))


@query("stored_tenants", f"WITH {_O} SELECT tenant_id, count(*) AS orders, CAST(sum(total_cents) AS BIGINT) AS total_cents FROM o WHERE tenant_id IN (1, 4, 7, 10) GROUP BY 1")
def stored_tenants(spark: SparkSession, d: str) -> DataFrame:
    """Some tenants of a table by hash, whose folders are sorted by tenant and time."""
    s = Store(spark, folder(spark, "hashed"))
    s.begin().create("orders", S.ORDERS, P.HashSpec(modulus=8)).insert("orders", S.orders(spark, d)).commit()
    s.begin().compact("orders", ["tenant_id", "placed_at"]).commit()
    return s.scan("orders", isin=[1, 4, 7, 10]).groupBy("tenant_id").agg(F.count("*").alias("orders"), F.sum("total_cents").alias("total_cents"))


@query("stored_partition_rows", f"WITH {_MONTHS}, n AS (SELECT 'p_' || strftime(o_orderdate, '%Y_%m') AS partition, count(*) AS n FROM orders GROUP BY 1) SELECT partition, coalesce(n, 0) AS rows FROM (SELECT * FROM months UNION ALL SELECT '{P.DEFAULT}') LEFT JOIN n USING (partition)")
def stored_partition_rows(spark: SparkSession, d: str) -> DataFrame:
    return monthly_orders(spark, d).partition_rows("orders")


@query("stored_tree", f"WITH {_MONTHS} SELECT 'orders' AS parent, partition, true AS attached, (SELECT count(*) > 0 FROM orders WHERE 'p_' || strftime(o_orderdate, '%Y_%m') = partition) AS has_bytes FROM (SELECT * FROM months UNION ALL SELECT '{P.DEFAULT}')")
def stored_tree(spark: SparkSession, d: str) -> DataFrame:
    return monthly_orders(spark, d).tree("orders").select("parent", "partition", "attached", (F.col("bytes") > 0).alias("has_bytes"))


@query("plan_partitions_touched", "SELECT 'window' AS question, 3 AS partitions_read, 80 AS partitions, 0 AS exchanges, true AS pushed UNION ALL SELECT 'all', 81, 81, 0, false")
def plan_partitions_touched(spark: SparkSession, d: str) -> DataFrame:
    """What the plans of two questions say: partitions, shuffles, and whether the bound reaches the scan."""
    tx = monthly_orders(spark, d).begin()
    lo, hi = datetime(1999, 3, 10), datetime(1999, 4, 2)
    one, all_ = (touched_report(spark, q, tx, "orders", lo=a, hi=b) for q, a, b in (("window", lo, hi), ("all", None, None)))
    return one.select("question", "partitions_read", (F.col("partitions") - 1).alias("partitions"), "exchanges", "pushed").unionByName(all_.select("question", "partitions_read", "partitions", "exchanges", "pushed"))


@query("statement_totals", "SELECT * FROM (VALUES ('orders by state', 2::BIGINT, (SELECT count(DISTINCT o_orderstatus) * 2 FROM orders)), ('all customers', 1::BIGINT, (SELECT count(*) FROM customer))) v(statement, calls, rows)")
def statement_totals(spark: SparkSession, d: str) -> DataFrame:
    """Statements with how often they ran and the rows they gave; times are left out here."""
    log = Statements(spark)
    for _ in range(2):
        log.run("orders by state", S.orders(spark, d).groupBy("state").count())
    log.run("all customers", S.table(spark, d, "customer"))
    return log.top(10).select("statement", "calls", "rows")


# ---- changing


@query("stored_move", f"WITH {_MONTHS}, n AS (SELECT 'p_' || strftime(CASE WHEN o_orderkey % 50 = 0 THEN TIMESTAMP '2001-07-15' ELSE o_orderdate END, '%Y_%m') AS partition, count(*) AS n FROM orders GROUP BY 1) SELECT partition, coalesce(n, 0) AS rows FROM (SELECT * FROM months UNION ALL SELECT '{P.DEFAULT}') LEFT JOIN n USING (partition)")
def stored_move(spark: SparkSession, d: str) -> DataFrame:
    """An update of the partition column: rows go where they now belong."""
    s = monthly_orders(spark, d)
    s.begin().update("orders", F.col("id") % 50 == 0, {"placed_at": F.expr("timestamp_ntz'2001-07-15'")}, must=True).commit()
    return s.partition_rows("orders")


@query("stored_delete", f"WITH {EVENTS_SQL} SELECT id, tenant_id, occurred_at FROM e WHERE NOT (occurred_at < TIMESTAMP '2024-01-11 06:00:00')")
def stored_delete(spark: SparkSession, d: str) -> DataFrame:
    s = daily_events(spark, d)
    s.begin().delete("events", F.col("occurred_at") < F.expr("timestamp_ntz'2024-01-11 06:00:00'")).commit()
    return s.scan("events").select("id", "tenant_id", "occurred_at")


@query("stored_insert_new", "SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders UNION ALL SELECT o_orderkey + 5, 7 FROM orders WHERE o_orderkey + 5 NOT IN (SELECT o_orderkey FROM orders)")
def stored_insert_new(spark: SparkSession, d: str) -> DataFrame:
    """All orders are there; they come again with other ids, of which some are taken."""
    s = Store(spark, folder(spark, "new"))
    o = S.orders(spark, d)
    s.begin().create("orders", S.ORDERS).insert("orders", o).commit()
    again = o.withColumns({"id": F.col("id") + 5, "total_cents": F.lit(7).cast("long")})
    s.begin().insert_new("orders", again.unionByName(again), ["id"]).commit()
    return s.scan("orders").select("id", "total_cents")


_LEDGER = T.StructType([T.StructField("tenant_id", T.LongType(), False), T.StructField("balance_cents", T.LongType(), False)])


def _ledger(spark: SparkSession, d: str) -> Store:
    """A thousand for each even customer."""
    s = Store(spark, folder(spark, "ledger"))
    some = S.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("tenant_id"), F.lit(100_000).cast("long").alias("balance_cents"))
    s.begin().create("ledger", _LEDGER, P.HashSpec(modulus=4), unique=["tenant_id"]).insert("ledger", some).commit()
    return s


@query("stored_upsert_add", f"WITH {_O} SELECT tenant_id, CAST(sum(c) AS BIGINT) AS balance_cents FROM (SELECT c_custkey AS tenant_id, 100000::BIGINT AS c FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT tenant_id, total_cents FROM o) GROUP BY 1")
def stored_upsert_add(spark: SparkSession, d: str) -> DataFrame:
    s = _ledger(spark, d)
    s.begin().upsert("ledger", S.orders(spark, d).select("tenant_id", F.col("total_cents").alias("balance_cents")), ["tenant_id"], add=["balance_cents"]).commit()
    return s.scan("ledger")


@query("stored_upsert_put", f"WITH {_O}, t AS (SELECT DISTINCT tenant_id FROM o WHERE tenant_id % 3 = 0) SELECT tenant_id, 5::BIGINT AS balance_cents FROM t UNION ALL SELECT c_custkey, 100000::BIGINT FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT tenant_id FROM t)")
def stored_upsert_put(spark: SparkSession, d: str) -> DataFrame:
    s = _ledger(spark, d)
    s.begin().upsert("ledger", S.orders(spark, d).where("tenant_id % 3 = 0").select("tenant_id", F.lit(5).cast("long").alias("balance_cents")), ["tenant_id"], put=["balance_cents"]).commit()
    return s.scan("ledger")


@query("stored_must_change", "SELECT CAST(count(*) AS BIGINT) AS tenants, CAST(sum(100000 - CASE WHEN c_custkey % 4 = 0 THEN 60000 ELSE 0 END) AS BIGINT) AS balance_cents, true AS refused FROM customer WHERE c_custkey % 2 = 0")
def stored_must_change(spark: SparkSession, d: str) -> DataFrame:
    """A guarded debit that finds rows, and one that finds none and must."""
    s = _ledger(spark, d)
    less = {"balance_cents": F.col("balance_cents") - 60_000}
    who = F.col("tenant_id") % 4 == 0
    s.begin().update("ledger", who & (F.col("balance_cents") >= 60_000), less, must=True).commit()
    refused = False
    try:
        s.begin().update("ledger", who & (F.col("balance_cents") >= 60_000), less, must=True)
    except NotAffectedError:
        refused = True
    return s.scan("ledger").agg(F.count("*").alias("tenants"), F.sum("balance_cents").alias("balance_cents")).withColumn("refused", F.lit(refused))


@query("stored_truncate", f"WITH {_O} SELECT state, count(*) AS orders FROM o WHERE state = 'F' GROUP BY 1")
def stored_truncate(spark: SparkSession, d: str) -> DataFrame:
    s = monthly_orders(spark, d)
    s.begin().truncate("orders").insert("orders", S.orders(spark, d).where("state = 'F'")).commit()
    return s.scan("orders").groupBy("state").agg(F.count("*").alias("orders"))


@query("stored_savepoint", "SELECT count(*) AS orders, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS tenth FROM orders")
def stored_savepoint(spark: SparkSession, d: str) -> DataFrame:
    """A delete, undone to a savepoint, in a transaction that then commits."""
    s = Store(spark, folder(spark, "points"))
    tx = s.begin().create("orders", S.ORDERS).insert("orders", S.orders(spark, d))
    point = tx.savepoint()
    tx.delete("orders", F.col("id") % 10 == 0)
    tx.rollback_to(point).commit()
    s.view("orders", "stored_orders")
    return spark.sql("SELECT count(*) AS orders, count(*) FILTER (WHERE id % 10 = 0) AS tenth FROM stored_orders")


@query("stored_versions", "SELECT 'orders' AS relation, count(*) AS rows, true AS dead_before, false AS dead_after, count(*) AS rows_before FROM orders")
def stored_versions(spark: SparkSession, d: str) -> DataFrame:
    """An update leaves superseded folders, which expiring deletes; the version before can be read until then."""
    s = Store(spark, folder(spark, "versions"))
    s.begin().create("orders", S.ORDERS).create("other", S.ORDERS).insert("orders", S.orders(spark, d)).insert("other", S.orders(spark, d)).commit()
    before = s.version()
    s.begin().update("orders", F.col("id") % 2 == 0, {"state": F.lit("X")}).commit()
    rows_before = s.scan("orders", before).where("state <> 'X'").count()
    dead = s.size_report("orders").select(F.col("table").alias("relation"), (F.col("dead_bytes") > 0).alias("dead_before"))
    dead = spark.createDataFrame(dead.collect(), dead.schema)  # as it is now; one row
    s.expire()
    after = s.size_report("orders").select((F.col("dead_bytes") > 0).alias("dead_after"))
    rows = s.scan("orders").agg(F.count("*").alias("rows"))
    return rows.join(dead).join(after).select("relation", "rows", "dead_before", "dead_after", F.lit(rows_before).cast("long").alias("rows_before"))


# ---- partition lifecycle


@query(
    "stored_retire",
    f"WITH {_MONTHS} SELECT partition, NOT (strptime(substr(partition, 3), '%Y_%m') + INTERVAL 1 MONTH <= date_trunc('month', TIMESTAMP '{S.ORDERS_AS_OF}') - INTERVAL 12 MONTH) AS attached FROM months UNION ALL SELECT '{P.DEFAULT}', true",
)
def stored_retire(spark: SparkSession, d: str) -> DataFrame:
    """What a year's retention detaches and keeps; a second run finds nothing more."""
    s = monthly_orders(spark, d)
    tx = s.begin()
    tx.retire("orders", NOW, keep=12, archive=True)
    if tx.retire("orders", NOW, keep=12, archive=True):
        raise P.PartitionError("a second run should find nothing")
    tx.commit()
    return s.tree("orders").select("partition", "attached")


@query("stored_maintain", "SELECT CASE WHEN m > TIMESTAMP '2024-01-31' THEN 'made' ELSE 'retired' END AS what, 'p_' || strftime(m, '%Y_%m_%d') AS partition FROM (SELECT TIMESTAMP '2024-01-01' + to_days(CAST(i AS INTEGER)) AS m FROM range(35) r(i)) WHERE m > TIMESTAMP '2024-01-31' OR m < TIMESTAMP '2024-01-17'")
def stored_maintain(spark: SparkSession, d: str) -> DataFrame:
    """Four days ahead are made, all but fourteen retired."""
    made, retired = daily_events(spark, d).begin().maintain("events", EVENTS_NOW, premake=4, keep=14)
    return spark.createDataFrame([("made", n) for n in made] + [("retired", n) for n in retired], "what string, partition string")


@query("stored_newest_bound", f"SELECT TIMESTAMP '2001-09-01' AS newest, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01' OR o_orderdate >= TIMESTAMP '2001-09-01') AS in_default, count(*) AS rows FROM orders")
def stored_newest_bound(spark: SparkSession, d: str) -> DataFrame:
    """Monitoring: how far the partitions reach, and what fell into the default."""
    s = monthly_orders(spark, d)
    rows = s.partition_rows("orders").agg(F.sum(F.when(F.col("partition") == P.DEFAULT, F.col("rows")).otherwise(0)).alias("in_default"), F.sum("rows").alias("rows"))
    return rows.withColumn("newest", F.lit(str(s.begin().newest_bound("orders"))).cast("timestamp_ntz"))


@query("stored_attach", "SELECT 'footers' AS proof, true AS refused, count(*) AS rows, count(*) FILTER (WHERE year(o_orderdate) = 1996) AS attached_rows FROM orders")
def stored_attach(spark: SparkSession, d: str) -> DataFrame:
    """A year written elsewhere is attached where it lies, its bounds proved by footers; with rows outside it is refused."""
    o = S.orders(spark, d)
    year, lo, hi = F.year("placed_at") == 1996, datetime(1996, 1, 1), datetime(1997, 1, 1)
    s = Store(spark, folder(spark, "attach"))
    tx = s.begin().create("orders", S.ORDERS, P.RangeSpec("placed_at", "year"), default=True)
    tx.insert("orders", o.where(~year)).commit()
    good, bad = folder(spark, "year"), folder(spark, "all")
    o.where(year).write.parquet(good)
    o.write.parquet(bad)
    refused = False
    try:
        s.begin().attach("orders", "p_1996", lo, hi, bad)
    except P.PartitionError:
        refused = True
    tx = s.begin()
    proof = tx.attach("orders", "p_1996", lo, hi, good)
    tx.commit()
    own = s.begin().part("orders", "p_1996").agg(F.count("*").alias("attached_rows"))
    return s.scan("orders").agg(F.count("*").alias("rows")).join(own).select(F.lit(proof).alias("proof"), F.lit(refused).alias("refused"), "rows", "attached_rows")


@query("stored_split_default", f"SELECT CASE WHEN year(o_orderdate) = 1997 THEN 'p_1997' ELSE '{P.DEFAULT}' END AS partition, count(*) AS rows, true AS refused FROM orders GROUP BY 1")
def stored_split_default(spark: SparkSession, d: str) -> DataFrame:
    """All rows lie in the default, so a plain new range is refused; splitting moves its rows."""
    s = Store(spark, folder(spark, "split"))
    s.begin().create("orders", S.ORDERS, P.RangeSpec("placed_at", "year"), default=True).insert("orders", S.orders(spark, d)).commit()
    lo, hi, refused = datetime(1997, 1, 1), datetime(1998, 1, 1), False
    try:
        s.begin().add_range("orders", "p_1997", lo, hi)
    except P.PartitionError:
        refused = True
    s.begin().split_default("orders", "p_1997", lo, hi).commit()
    return s.partition_rows("orders").withColumn("refused", F.lit(refused))


@query("stored_promote", f"SELECT CASE WHEN o_custkey IN (1, 7) THEN 'v' || o_custkey ELSE 'r' || CAST({key_sql('o_custkey')} % 4 AS VARCHAR) END AS partition, count(*) AS rows FROM orders GROUP BY 1")
def stored_promote(spark: SparkSession, d: str) -> DataFrame:
    """A tenant gets a partition of its own, and its rows go there."""
    s = Store(spark, folder(spark, "promote"))
    s.begin().create("orders", S.ORDERS, P.ListSpec(values=(1,))).insert("orders", S.orders(spark, d)).commit()
    s.begin().promote("orders", 7).commit()
    return s.partition_rows("orders").where("rows > 0")


@query("stored_detach_beside_default", f"WITH {EVENTS_SQL} SELECT count(*) AS events, true AS refused, 31 AS partitions, true AS default_attached FROM e WHERE occurred_at < TIMESTAMP '2024-01-05' OR occurred_at >= TIMESTAMP '2024-01-06'")
def stored_detach_beside_default(spark: SparkSession, d: str) -> DataFrame:
    """A concurrent detach is refused beside a default; the call for it goes around, twice alike."""
    s = daily_events(spark, d)
    refused = False
    try:
        s.begin().detach("events", "p_2024_01_05", concurrently=True)
    except P.PartitionError:
        refused = True
    for _ in range(2):
        s.begin().detach_beside_default("events", "p_2024_01_05", drop=True).commit()
    parts = s.manifest()["tables"]["events"]["parts"]
    return s.scan("events").agg(F.count("*").alias("events")).select("events", F.lit(refused).alias("refused"), F.lit(len(parts)).alias("partitions"), F.lit(P.DEFAULT in parts).alias("default_attached"))


@query("stored_teardown", "SELECT 'other' AS relation, count(*) AS rows, 0 AS detached_left FROM orders")
def stored_teardown(spark: SparkSession, d: str) -> DataFrame:
    """A table goes with what it had detached; the rest of the store stays."""
    s = monthly_orders(spark, d)
    s.begin().detach("orders", "p_1996_01").commit()
    s.begin().create("other", S.ORDERS).insert("other", S.orders(spark, d)).drop_table("orders").commit()
    tables = s.manifest()["tables"]
    (left,) = tables
    return s.scan(left).agg(F.count("*").alias("rows")).select(F.lit(left).alias("relation"), "rows", F.lit(sum(len(t["detached"]) for t in tables.values())).alias("detached_left"))


@query("refused_declarations", "SELECT * FROM (VALUES ('unique without the partition column', true), ('unique with it', false), ('moduli that do not divide', true), ('overlapping remainders', true), ('moduli that divide', false), ('overlapping ranges', true), ('no such table', true)) v(declaration, refused)")
def refused_declarations(spark: SparkSession, d: str) -> DataFrame:
    parts = {"p": {"lo": "2024-01-01 00:00:00", "hi": "2024-02-01 00:00:00"}}
    s = Store(spark, folder(spark, "none"))
    cases = {
        "unique without the partition column": lambda: P.check_unique(P.HashSpec(), ["id"]),
        "unique with it": lambda: P.check_unique(P.HashSpec(), ["id", "tenant_id"]),
        "moduli that do not divide": lambda: P.check_moduli([(4, 0), (6, 1)]),
        "overlapping remainders": lambda: P.check_moduli([(4, 1), (8, 5)]),
        "moduli that divide": lambda: P.check_moduli([(4, 0), (8, 1), (8, 5)]),
        "overlapping ranges": lambda: P.check_free(parts, datetime(2024, 1, 15), datetime(2024, 3, 1)),
        "no such table": lambda: None if s.has_table("orders") else P.check_free(parts, datetime(2024, 1, 1), datetime(2024, 1, 1)),
    }

    def refused(f) -> bool:
        try:
            f()
        except P.PartitionError:
            return True
        return False

    return spark.createDataFrame([(n, refused(f)) for n, f in cases.items()], "declaration string, refused boolean")


# ---- summaries, constraints, copies, joins


@query("stored_daily_summary", f"WITH {EVENTS_SQL} SELECT tenant_id, date_trunc('day', occurred_at)::TIMESTAMP AS day, count(*) AS events, CAST(sum(amount_cents + CASE WHEN occurred_at >= TIMESTAMP '2024-01-20' AND occurred_at < TIMESTAMP '2024-01-22' THEN 1 ELSE 0 END) AS BIGINT) AS amount_cents FROM e GROUP BY 1, 2")
def stored_daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """A summary table; two days change, and only they are refreshed."""
    s = daily_events(spark, d)
    lo, hi = datetime(2024, 1, 20), datetime(2024, 1, 22)
    refresh_daily(create_daily(s.begin()), "events", datetime(2023, 12, 1), datetime(2024, 3, 1)).commit()
    c = F.col("occurred_at")
    s.begin().update("events", (c >= F.lit(str(lo)).cast("timestamp_ntz")) & (c < F.lit(str(hi)).cast("timestamp_ntz")), {"amount_cents": F.col("amount_cents") + 1}).commit()
    refresh_daily(s.begin(), "events", lo, hi).commit()
    return s.scan("daily")


@query("constraint_violations", "SELECT 'positive' AS constraint, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS rows FROM orders UNION ALL SELECT 'unique', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus HAVING count(*) > 1) UNION ALL SELECT 'references tenant_id', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    some = S.table(spark, d, "customer").where("c_custkey % 10 <> 0")
    return S.violations(S.orders(spark, d), unique=["tenant_id", "state"], checks={"positive": "total_cents > 100000"}, references={"tenant_id": (some, "c_custkey")})


_SUM = "count(*) AS rows, CAST(coalesce(sum((id + 2 * tenant_id + 3 * total_cents) % 1000000007), 0) AS BIGINT) AS checksum"


@query("csv_round_trip", f"WITH {_O} SELECT {_SUM} FROM o")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark, "csv")
    S.write_csv(S.orders(spark, d), path)
    return S.fingerprint(S.read_csv(spark, path, S.ORDERS), ["id", "tenant_id", "total_cents"])


@query("copied_to_another_layout", f"WITH {_O} SELECT {_SUM} FROM o")
def copied_to_another_layout(spark: SparkSession, d: str) -> DataFrame:
    """From monthly partitions to hashed ones, and one row more that is taken out again."""
    s = monthly_orders(spark, d)
    tx = s.begin().create("hashed", S.ORDERS, P.HashSpec(modulus=4))
    tx.insert("hashed", tx.scan("orders")).insert("hashed", spark.createDataFrame([(-1, 1, datetime(1999, 1, 1), 5, "N")], S.ORDERS))
    tx.delete("hashed", F.col("id") == -1).commit()
    return S.fingerprint(s.scan("hashed"), ["id", "tenant_id", "total_cents"])


@query("synthetic_rows", "SELECT 4000::BIGINT AS events, true AS tenants_in_range, true AS skewed, true AS kinds_known, 1380::BIGINT AS orders, 600::BIGINT AS whale_orders")
def synthetic_rows(spark: SparkSession, d: str) -> DataFrame:
    """Seeded synthetic data: its shape, as its values are Spark's own."""
    e = S.synthetic_events(spark, 4000, tenants=50)
    o = S.synthetic_orders(spark, tenants=41, per_tenant=20, whales=2, factor=15)
    by = e.groupBy("tenant_id").agg(F.count("*").alias("n"), F.min(F.col("kind").isin("click", "view", "purchase", "signup", "email")).alias("known"))
    shape = by.agg(F.sum("n").alias("events"), ((F.min("tenant_id") >= 1) & (F.max("tenant_id") <= 50)).alias("tenants_in_range"), (F.max("n") > 4000 // 10).alias("skewed"), F.min("known").alias("kinds_known"))
    return shape.join(o.agg(F.count("*").alias("orders"), F.count(F.when(F.col("tenant_id") <= 2, 1)).alias("whale_orders")))


@query("join_colocated", "SELECT o_orderstatus AS state, count(*) AS items, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS cents, 0 AS exchanges FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_colocated(spark: SparkSession, d: str) -> DataFrame:
    """Both sides lie in buckets of the key, so the join itself exchanges nothing."""
    names = [f"tidewell_{x}_{uuid.uuid4().hex}" for x in ("orders", "items")]
    J.write_bucketed(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state")), names[0], "key", 8)
    J.write_bucketed(S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c")), names[1], "key", 8)
    for n in names:
        J.analyze(spark, n)
    both = J.colocated_join(spark.table(names[0]), spark.table(names[1]), "key")
    return both.groupBy("state").agg(F.count("*").alias("items"), F.sum("c").alias("cents")).withColumn("exchanges", F.lit(J.exchanges(both)))


# ---- scalar helpers over whole tables


@query("not_in_null_aware", "SELECT c_custkey + 5 AS tenant_id FROM customer WHERE c_custkey + 5 NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey + 5 FROM customer WHERE c_custkey + 5 NOT IN (SELECT CASE WHEN o_custkey > 1 THEN o_custkey END FROM orders)")
def not_in_null_aware(spark: SparkSession, d: str) -> DataFrame:
    """``NOT IN``: a null among the values lets nothing through."""
    c = S.table(spark, d, "customer").select((F.col("c_custkey") + 5).alias("tenant_id"))
    o = S.orders(spark, d)
    text = "SELECT tenant_id FROM {c} WHERE tenant_id NOT IN (SELECT v FROM {o})"
    one = spark.sql(text, c=c, o=o.select(F.col("tenant_id").alias("v")))
    return one.unionByName(spark.sql(text, c=c, o=o.select(F.when(F.col("tenant_id") > 1, F.col("tenant_id")).alias("v"))))


@query("like_escaped", r"SELECT partition FROM (SELECT DISTINCT 'p_' || strftime(o_orderdate, '%Y_%m') AS partition FROM orders UNION ALL SELECT DISTINCT 'px' || strftime(o_orderdate, '%Y_%m') FROM orders) WHERE partition LIKE 'p\_1996\_%' ESCAPE '\'")
def like_escaped(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin with a literal ``p_1996_``."""
    month = F.date_format("placed_at", "yyyy_MM")
    names = S.orders(spark, d).select(F.explode(F.array(F.concat(F.lit("p_"), month), F.concat(F.lit("px"), month))).alias("partition")).distinct()
    return names.where(like_literal(F.col("partition"), "p_1996_", "%"))


@query("name_parts", "SELECT DISTINCT CAST(regexp_extract('p_' || strftime(o_orderdate, '%Y_%m'), '^p_([0-9]{4})_([0-9]{2})$', 1) AS INTEGER) AS year, CAST(regexp_extract('p_' || strftime(o_orderdate, '%Y_%m'), '^p_([0-9]{4})_([0-9]{2})$', 2) AS INTEGER) AS month, lower('P_' || o_orderstatus) AS name FROM orders")
def name_parts(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("p_"), F.date_format("placed_at", "yyyy_MM"))
    part = lambda k: F.regexp_extract(name, "^p_([0-9]{4})_([0-9]{2})$", k).cast("int")
    return S.orders(spark, d).select(part(1).alias("year"), part(2).alias("month"), F.lower(F.concat(F.lit("P_"), "state")).alias("name")).distinct()


@query("json_built", "SELECT o_orderkey AS id, '{\"tenant_id\":' || o_custkey || ',\"state\":\"' || o_orderstatus || '\"}' AS payload, ['a', 'b', 'c'][1 + o_orderkey % 3] AS letter FROM orders")
def json_built(spark: SparkSession, d: str) -> DataFrame:
    letters = F.array(*map(F.lit, "abc"))
    return S.orders(spark, d).select("id", F.to_json(F.struct("tenant_id", "state")).alias("payload"), F.element_at(letters, (1 + F.col("id") % 3).cast("int")).alias("letter"))


_UNITS = " ".join(f"WHEN b >= {1024**k}::BIGINT THEN printf('%.1f', b / {1024**k}::DOUBLE) || ' {u}'" for k, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")))


@query("sizes_as_text", f"SELECT id, CASE {_UNITS} ELSE b || ' B' END AS size FROM (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) * (1 + o_orderkey % 1000) * (1 + o_orderkey % 7) AS b FROM orders)")
def sizes_as_text(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("total_cents") * (1 + F.col("id") % 1000) * (1 + F.col("id") % 7)
    return S.orders(spark, d).select("id", human_bytes_column(b).alias("size"))


@query("stored_hash_key", f"SELECT c_custkey AS tenant_id, CAST({key_sql('c_custkey')} % 97 AS INTEGER) AS bucket FROM customer")
def stored_hash_key(spark: SparkSession, d: str) -> DataFrame:
    from tidewell.functions.hashing import umod

    c = S.table(spark, d, "customer").select(F.col("c_custkey").alias("tenant_id"))
    return with_key(c).select("tenant_id", umod(F.col("key"), 97).cast("int").alias("bucket"))
