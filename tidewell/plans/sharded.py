"""Queries that run a cluster of stores: seeding, fan-out, audits, resharding, transfers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.catalog import query
from tidewell.functions.ids import EPOCH_MS, decode_id_columns, with_ids
from tidewell.operators import topology as T
from tidewell.operators.cluster import Cluster, Together
from tidewell.operators.feed import Cursor, decode_cursor, merge_desc, page
from tidewell.operators.reshard import CHECKED, Reshard
from tidewell.operators.transfer import InsufficientFundsError, Outbox, TwoPhase
from tidewell.plans.feeds import feed
from tidewell.plans.routing import key_sql
from tidewell.plans.shards import _P, FOUR
from tidewell.plans.stored import folder
from tidewell.plans.transfers import _L, _M, OPENING, moves
from tidewell.sources import tables as S


def cluster(spark: SparkSession, d: str, shards: int = 4, rows: bool = True) -> Cluster:
    """All orders on shards, each with its own store."""
    c = Cluster(spark, folder(spark, "cluster"), FOUR, shards=list(range(shards))).create()
    if rows:
        c.insert_orders(_orders(spark, d))
    return c


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return S.orders(spark, d).select("id", "tenant_id", F.col("placed_at").alias("created_at"), "total_cents", "state")


def bank(spark: SparkSession, d: str) -> Cluster:
    """Every tenant with an order has the opening balance on its shard."""
    c = cluster(spark, d, rows=False)
    Together(c).insert("ledger", c.topology.with_shard(S.ledger(S.orders(spark, d), OPENING))).commit()
    return c


# ---- fan-out


@query("cluster_stats", f"WITH {_P}, s AS (SELECT shard, count(*) AS rows, count(DISTINCT tenant_id) AS tenants FROM p GROUP BY 1) SELECT shard, rows, tenants, true AS has_bytes, (SELECT max(rows) FROM s)::DOUBLE / (SELECT min(rows) FROM s)::DOUBLE AS imbalance, true AS reachable FROM s")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    """Orders are routed and written to four stores, which then say what they hold."""
    c = cluster(spark, d)
    up = spark.createDataFrame(list(c.ping().items()), "shard int, reachable boolean")
    return c.stats().join(up, "shard").select("shard", "rows", "tenants", (F.col("bytes") > 0).alias("has_bytes"), "imbalance", "reachable")


@query("cluster_state_counts", f"WITH {_P} SELECT state, count(*) AS n, 4 AS shards_ok, 4 AS shards_expected FROM p GROUP BY 1")
def cluster_state_counts(spark: SparkSession, d: str) -> DataFrame:
    return cluster(spark, d).state_counts()


@query("cluster_scattered_counts", f"WITH {_P} SELECT state, count(*) AS n, 4 AS answered, true AS complete, true AS slowest_known, true AS lost_shard_is_said FROM p GROUP BY 1")
def cluster_scattered_counts(spark: SparkSession, d: str) -> DataFrame:
    """A function a shard, gathered; and once with a shard that fails."""
    c = cluster(spark, d)
    total, got = c.state_counts_scattered(timeout=120.0)

    def broken(shard, store):
        if shard == 2:
            raise OSError("unreadable")
        return store.version()

    part = c.scatter(broken, timeout=60.0, allow_partial=True)
    lost = part.ok == 3 and not part.complete and isinstance(part.results[2].error, OSError)
    rows = [(state, n, got.ok, got.complete, got.slowest()[0] in c.shards, lost) for state, n in total.items()]
    return spark.createDataFrame(rows, "state string, n long, answered int, complete boolean, slowest_known boolean, lost_shard_is_said boolean")


@query("cluster_tenant", f"WITH {_P} SELECT count(*) AS orders, CAST(coalesce(sum(total_cents), 0) AS BIGINT) AS total_cents FROM p WHERE tenant_id = 17")
def cluster_tenant(spark: SparkSession, d: str) -> DataFrame:
    """From the store of the tenant's shard alone."""
    return cluster(spark, d).summarize_tenant(17)


@query("cluster_insert_again", f"WITH {_P} SELECT shard, count(*) AS rows FROM p GROUP BY 1")
def cluster_insert_again(spark: SparkSession, d: str) -> DataFrame:
    """The same orders come twice: ids that are there are left alone."""
    c = cluster(spark, d)
    c.insert_orders(_orders(spark, d))
    return c.read("orders").groupBy("shard").agg(F.count("*").alias("rows"))


@query("cluster_double_writes", f"WITH {_P} SELECT shard, count(*) AS rows FROM (SELECT shard FROM p UNION ALL SELECT shard + 4 FROM p WHERE logical_shard % 256 >= 128) GROUP BY 1")
def cluster_double_writes(spark: SparkSession, d: str) -> DataFrame:
    """While logical shards move, their rows are written to both places."""
    c = cluster(spark, d, 8, rows=False)
    Reshard(c, f"{c.root}/placement.json").open(list(T.split_moves(FOUR, 4)))
    c.insert_orders(_orders(spark, d))
    return c.read("orders").groupBy("shard").agg(F.count("*").alias("rows"))


# ---- audits and resharding


@query("misplaced_rows", f"WITH {_P} SELECT CAST(s AS INTEGER) AS shard, (SELECT count(*) FROM p WHERE p.shard = s AND logical_shard % 256 >= 128) AS misplaced FROM range(8) r(s)")
def misplaced_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stores were filled by one placement and are audited by another."""
    c = cluster(spark, d, 8)
    c.set_topology(T.split(FOUR, 4))
    return c.misplaced()


_CHECK = "CAST(sum((id + 2 * tenant_id + 3 * total_cents + 4 * logical_shard) % 1000000007) AS BIGINT)"


@query("reshard_verified", f"WITH {_P} SELECT shard AS source, shard + 4 AS target, 128 AS logical_shards, count(*) AS source_rows, count(*) AS target_rows, {_CHECK} AS source_checksum, {_CHECK} AS target_checksum, true AS same FROM p WHERE logical_shard % 256 >= 128 GROUP BY 1")
def reshard_verified(spark: SparkSession, d: str) -> DataFrame:
    """Half of the logical shards are copied, and both sides are counted and summed."""
    c = cluster(spark, d, 8)
    job = Reshard(c, f"{c.root}/placement.json")
    plan = job.plan(4)
    job.open(plan)
    job.backfill(plan)
    return job.verify(plan)


@query("reshard_done", f"WITH {_P} SELECT CASE WHEN logical_shard % 256 >= 128 THEN shard + 4 ELSE shard END AS shard, count(*) AS rows, CAST(0 AS BIGINT) AS misplaced, 128 AS logical_shards FROM p GROUP BY 1")
def reshard_done(spark: SparkSession, d: str) -> DataFrame:
    """The whole run, stopped half-way and taken up again; its placement is read back from the file."""
    c = cluster(spark, d, 8)
    job = Reshard(c, f"{c.root}/placement.json")
    try:
        job.run(4, fail_after=100)
    except RuntimeError:
        job.run(4)
    place = T.load(spark, job.placement_path)
    each = spark.createDataFrame([(s, len(place.logicals_on(s))) for s in sorted(place.shards())], "shard int, logical_shards int")
    rows = c.read("orders").groupBy("shard").agg(F.count("*").alias("rows"))
    return rows.join(c.misplaced(), "shard").join(each, "shard").select("shard", "rows", "misplaced", "logical_shards")


@query("directory_edits", "SELECT CAST(s AS INTEGER) AS shard, CASE s WHEN 0 THEN 255 WHEN 3 THEN 257 ELSE 256 END AS logical_shards, s = 2 AS has_pin, true AS refused FROM range(4) r(s)")
def directory_edits(spark: SparkSession, d: str) -> DataFrame:
    """One logical shard moves, a tenant is pinned; a directory that names a shard too many is refused."""
    place = FOUR.begin_move(5, 3).commit(5).pin(42, 2)
    refused = False
    try:
        T.check_fits(place.pin(43, 9), range(4))
    except T.IncompleteClusterError:
        refused = True
    return spark.createDataFrame([(s, len(place.logicals_on(s)), place.read(42) == s, refused) for s in range(4)], "shard int, logical_shards int, has_pin boolean, refused boolean")


@query("placement_round_trip", "SELECT CAST(i AS INTEGER) AS logical_shard, CAST(i // 256 AS INTEGER) AS shard, CASE WHEN i = 7 THEN 3 END AS moving_to FROM range(1024) r(i)")
def placement_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A directory written, read and written again, as a table."""
    path = f"{folder(spark, 'placement')}/placement.json"
    T.save(spark, T.load_or_init(spark, path, 1024, 4).begin_move(7, 3), path)
    c = Cluster(spark, folder(spark, "empty"), T.load(spark, path))
    return Reshard(c, path).status()


@query("rebalance_plan")
def rebalance_plan(spark: SparkSession, d: str) -> DataFrame:
    """Moves from the fullest shard to the emptiest until no move shrinks the gap, from
    the orders of each logical shard."""
    c = cluster(spark, d)
    weight = {r["logical_shard"]: r["n"] for r in c.read("orders").groupBy("logical_shard").agg(F.count("*").alias("n")).collect()}  # a row a logical shard
    plan = T.rebalance_moves(FOUR, weight, range(4))
    return spark.createDataFrame([(i, FOUR.placement[i], t, weight[i]) for i, t in plan], "logical_shard int, source int, target int, rows long")


# ---- money


_BALANCES = "SELECT tenant_id, CAST(sum(c) AS BIGINT) AS balance_cents FROM ({parts}) GROUP BY 1"
_DEBITED = "SELECT tenant_id, balance_cents AS c FROM l UNION ALL SELECT source, -cents FROM m"


@query("outbox_transfer_balances", f"WITH {_M}, {_L} " + _BALANCES.format(parts=_DEBITED))
def outbox_transfer_balances(spark: SparkSession, d: str) -> DataFrame:
    """Debits and messages are in, no message is delivered yet."""
    c = bank(spark, d)
    Outbox(c).transfer_all(moves(spark, d))
    return c.balances().select("tenant_id", "balance_cents")


@query("pending_outbox", f"WITH {_M}, p AS (SELECT id, CAST(({key_sql('source')} % 1024) // 256 AS INTEGER) AS shard FROM m) SELECT CAST(s AS INTEGER) AS shard, CASE WHEN s = 1 THEN 0 ELSE (SELECT count(*) FROM p WHERE p.shard = s) END AS pending FROM range(4) r(s)")
def pending_outbox(spark: SparkSession, d: str) -> DataFrame:
    """Undelivered messages of each shard, after one shard's were relayed."""
    c = bank(spark, d)
    box = Outbox(c)
    box.transfer_all(moves(spark, d))
    box.relay_once(1, batch=None)
    return box.pending()


@query("relay_idempotent_balances", f"WITH {_M}, {_L} " + _BALANCES.format(parts=_DEBITED + " UNION ALL SELECT target, cents FROM m"))
def relay_idempotent_balances(spark: SparkSession, d: str) -> DataFrame:
    """All messages are delivered; on two shards twice, as the relay dies before it marks them."""
    c = bank(spark, d)
    box = Outbox(c)
    box.transfer_all(moves(spark, d))
    for shard in c.shards:
        if shard % 2:
            box.relay_once(shard, batch=None, crash_before_mark=True)
        box.relay_once(shard, batch=None)
    return c.balances().groupBy("tenant_id").agg(F.sum("balance_cents").alias("balance_cents"))


@query("replayed_message", f"WITH {_M}, {_L} SELECT CAST(sum(balance_cents) AS BIGINT) AS balance_cents, (SELECT count(*) FROM m) AS applied, CAST(0 AS BIGINT) AS pending FROM l")
def replayed_message(spark: SparkSession, d: str) -> DataFrame:
    """A delivered message is marked undelivered and sent again: no balance changes."""
    c = bank(spark, d)
    box = Outbox(c)
    box.transfer_all(moves(spark, d))
    for shard in c.shards:
        box.relay_once(shard, batch=None)
    first = moves(spark, d).agg(F.min("id")).first()[0]
    box.replay(first)
    for shard in c.shards:
        box.relay_once(shard, batch=100)
    sums = c.balances().agg(F.sum("balance_cents").alias("balance_cents"))
    return sums.join(c.read("applied").agg(F.count("*").alias("applied"))).join(box.pending().agg(F.sum("pending").alias("pending")))


@query("twopc_balances", f"WITH {_M}, {_L} " + _BALANCES.format(parts=_DEBITED + " UNION ALL SELECT target, cents FROM m"))
def twopc_balances(spark: SparkSession, d: str) -> DataFrame:
    """All transfers as one transaction over all shards."""
    c = bank(spark, d)
    TwoPhase(c).transfer_all("all", moves(spark, d))
    return c.balances().groupBy("tenant_id").agg(F.sum("balance_cents").alias("balance_cents"))


@query("twopc_conservation", f"WITH {_M}, {_L} SELECT CAST(sum(balance_cents) AS BIGINT) AS before, CAST((SELECT sum(c) FROM (SELECT balance_cents AS c FROM l UNION ALL SELECT -cents FROM m UNION ALL SELECT cents FROM m)) AS BIGINT) AS after, 4 AS orphans, 4 AS rolled_back, true AS refused FROM l")
def twopc_conservation(spark: SparkSession, d: str) -> DataFrame:
    """One coordinator dies after preparing, which is rolled back; one finds too little money; one goes through."""
    c = bank(spark, d)
    before = c.balances().agg(F.sum("balance_cents")).first()[0]
    tp, m = TwoPhase(c), moves(spark, d)
    tp.prepare("dead", {s: lambda tx: None for s in c.shards})
    orphans, gone, refused = len(tp.orphans()), tp.resolve(), False
    try:
        tp.transfer_all("poor", m.withColumn("cents", F.lit(10 * OPENING).cast("long")))
    except InsufficientFundsError:
        refused = not tp.orphans()
    tp.transfer_all("rich", m)
    after = c.balances().agg(F.sum("balance_cents").alias("after"))
    return after.select(F.lit(before).cast("long").alias("before"), "after", F.lit(orphans).alias("orphans"), F.lit(gone).alias("rolled_back"), F.lit(refused).alias("refused"))


@query("insufficient_funds", f"WITH {_L} SELECT tenant_id, CASE WHEN balance_cents >= 1 + tenant_id * 5000 THEN balance_cents - 1 - tenant_id * 5000 ELSE balance_cents END AS balance_cents FROM l")
def insufficient_funds(spark: SparkSession, d: str) -> DataFrame:
    """A guarded debit on every shard: who can't pay keeps the balance."""
    c = bank(spark, d)
    owed = 1 + F.col("tenant_id") * 5000
    for store in c.stores.values():
        store.begin().update("ledger", F.col("balance_cents") >= owed, {"balance_cents": F.col("balance_cents") - owed}).commit()
    return c.balances().select("tenant_id", "balance_cents")


# ---- feeds and ids


_PAGE = "SELECT o_orderkey AS id, o_custkey AS tenant_id, o_orderdate AS created_at FROM orders"


@query("feed_merged", f"{_PAGE} ORDER BY created_at DESC, id DESC LIMIT 25")
def feed_merged(spark: SparkSession, d: str) -> DataFrame:
    """The newest rows of each shard's store, merged; one input is absent."""
    c = cluster(spark, d)
    parts = [s.scan("orders").select("id", "tenant_id", "created_at") for s in c.stores.values()]
    return merge_desc([parts[0], None, *parts[1:]], 25)


@query("feed_full_walk", f"SELECT count(*) AS rows, count(DISTINCT id) AS ids, max(created_at) AS newest, min(created_at) AS oldest FROM ({_PAGE})")
def feed_full_walk(spark: SparkSession, d: str) -> DataFrame:
    """Page after page to the end, each from the cursor of the one before, which is sent as text."""
    rows = feed(spark, d)
    n = rows.count()
    size, cursor, pages = max(1, -(-n // 6)), "", []  # six pages, whatever the table
    while True:
        one = page(rows, decode_cursor(cursor), size)
        last = one.agg(F.min(F.struct("created_at", "id")).alias("m")).select("m.*").first()
        if last["id"] is None:
            break
        pages.append(one)
        cursor = Cursor(last["created_at"], last["id"]).encode()
    walked = reduce(DataFrame.unionByName, pages, rows.limit(0))
    return walked.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max("created_at").alias("newest"), F.min("created_at").alias("oldest"))


@query("ids_given", f"WITH {_P} SELECT shard, count(*) AS rows, count(*) AS ids, CAST(least(count(*), 4096) - 1 AS INTEGER) AS last_seq, {EPOCH_MS + 5000} + (count(*) - 1) // 4096 AS last_ms FROM p GROUP BY 1")
def ids_given(spark: SparkSession, d: str) -> DataFrame:
    """Time-ordered ids for all rows of all shards, 4096 a millisecond."""
    rows = FOUR.with_shard(S.orders(spark, d).select("tenant_id", "placed_at", F.col("id").alias("old")))
    given = with_ids(rows, "shard", EPOCH_MS + 5000, [F.col("placed_at"), F.col("old")])
    parts = decode_id_columns(F.col("id"))
    return given.groupBy(parts["id_shard"].alias("shard")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.max(parts["id_seq"]).alias("last_seq"), F.max(parts["id_ms"]).alias("last_ms"))
