import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators import feed
from tidewell.operators.cluster import OUTBOX, Cluster, PartialResultError, Together
from tidewell.operators.reshard import Reshard, StoppedError, VerificationError
from tidewell.operators.topology import Directory, IncompleteClusterError, split
from tidewell.operators.transfer import InsufficientFundsError, Outbox, TwoPhase
from tidewell.streaming.relay import start_relay


def rows(spark, tenants=12, each=4):
    n = spark.range(tenants * each)
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id / 3 as int))")
    return n.select("id", (F.col("id") % tenants + 1).alias("tenant_id"), at.alias("created_at"), (F.col("id") * 10).alias("total_cents"), F.when(F.col("id") % 3 == 0, "paid").otherwise("new").alias("state"))


@pytest.fixture
def cluster(spark, tmp_path):
    c = Cluster(spark, f"{tmp_path}/c", Directory.even(16, 2)).create()
    c.insert_orders(rows(spark))
    c.seed_ledger(1000)
    return c


def money(c):
    return {r.tenant_id: r.balance_cents for r in c.balances().collect()}


def pair(c, same):
    t = c.topology
    a = 1
    return a, next(x for x in range(2, 13) if (t.read(x) == t.read(a)) == same)


def test_reads(spark, cluster):
    assert all(cluster.ping().values())
    counts = {r.state: (r.n, r.shards_ok, r.shards_expected) for r in cluster.state_counts().collect()}
    assert counts == {"paid": (16, 2, 2), "new": (32, 2, 2)}
    total, got = cluster.state_counts_scattered()
    assert total == {"new": 32, "paid": 16} and got.complete and got.slowest()[0] in (0, 1)
    stats = cluster.stats().collect()
    assert sum(r.rows for r in stats) == 48 and sum(r.tenants for r in stats) == 12 and all(r.bytes > 0 for r in stats)
    s = cluster.summarize_tenant(3).first()
    assert (s.orders, s.total_cents) == (4, 10 * (2 + 14 + 26 + 38))
    assert cluster.summarize_tenant(999).first().total_cents == 0
    cluster.insert_orders(rows(spark))  # ids are there already
    assert cluster.read("orders").count() == 48


def test_partial_results_say_so(cluster):
    def broken(shard, store):
        if shard == 1:
            raise OSError("unreadable")
        return store.scan("orders").count()

    with pytest.raises(PartialResultError):
        cluster.scatter(broken, timeout=60)
    got = cluster.scatter(broken, timeout=60, allow_partial=True)
    assert (got.ok, got.expected, got.complete) == (1, 2, False) and got.results[1].error
    slow = cluster.scatter(lambda s, _: time.sleep(3 * s), timeout=1, allow_partial=True)
    assert isinstance(slow.results[1].error, TimeoutError) and slow.ok == 1


def test_a_missing_shard_is_refused(spark, tmp_path):
    with pytest.raises(IncompleteClusterError):
        Cluster(spark, f"{tmp_path}/x", Directory.even(16, 4), shards=[0, 1])


def test_misplaced(spark, tmp_path):
    c = Cluster(spark, f"{tmp_path}/m", Directory.even(16, 2), shards=[0, 1, 2, 3]).create()
    c.insert_orders(rows(spark))
    assert sum(r.misplaced for r in c.misplaced().collect()) == 0
    c.set_topology(split(c.topology, 2))
    found = {r.shard: r.misplaced for r in c.misplaced().collect()}
    assert len(found) == 4 and sum(found.values()) > 0 and found[2] == found[3] == 0


def test_reshard(spark, tmp_path):
    c = Cluster(spark, f"{tmp_path}/r", Directory.even(16, 2), shards=[0, 1, 2, 3]).create()
    c.insert_orders(rows(spark))
    job = Reshard(c, f"{tmp_path}/placement.json")
    moves = job.plan(2)
    assert len(moves) == 8
    job.open(moves)
    late = rows(spark).withColumns({"id": F.col("id") + 1000})
    with pytest.raises(VerificationError):
        job.cut_over(moves)  # nothing is copied yet
    c.insert_orders(late)  # while both places are written
    job.backfill(moves)
    assert job.verify(moves).where("NOT same").count() == 0
    with pytest.raises(StoppedError):
        job.cut_over(moves, fail_after=3)
    assert job.status().where("moving_to IS NOT NULL").count() == 5
    job.run(2)
    assert not job.directory.moving
    assert c.read("orders").count() == 96 and sum(r.misplaced for r in c.misplaced().collect()) == 0


@pytest.mark.parametrize("same", [False, True])
def test_two_phase(cluster, same):
    a, b = pair(cluster, same)
    tp = TwoPhase(cluster)
    tp.transfer("t1", a, b, 300)
    m = money(cluster)
    assert (m[a], m[b], sum(m.values())) == (700, 1300, 12_000)
    with pytest.raises(InsufficientFundsError):
        tp.transfer("t2", a, b, 701)
    assert money(cluster) == m and tp.orphans() == []


def test_orphans(cluster):
    a, b = pair(cluster, False)
    tp = TwoPhase(cluster)
    legs = tp.transfer_legs(a, b, 10)
    tp.prepare("crash", legs)
    assert len(tp.orphans()) == 2 and tp.orphans(older_than=3600) == []
    assert sum(money(cluster).values()) == 12_000
    with pytest.raises(Exception, match="prepared|held"):
        tp.transfer("other", a, b, 1)
    assert tp.resolve() == 2 and tp.orphans() == []
    tp.prepare("half", tp.transfer_legs(a, b, 10))
    tp.commit("half", [cluster.topology.read(a), cluster.topology.read(b)])
    assert money(cluster)[b] == 1010


def test_outbox(cluster):
    a, b = pair(cluster, False)
    box = Outbox(cluster)
    src = cluster.topology.read(a)
    box.transfer(1, a, b, 250)
    assert money(cluster)[a] == 750 and money(cluster)[b] == 1000
    assert {r.shard: r.pending for r in box.pending().collect()}[src] == 1
    assert box.relay_once(src, crash_before_mark=True) == 1
    assert box.relay_once(src) == 1  # a duplicate counts as delivered, and changes nothing
    assert money(cluster)[b] == 1250 and box.relay_once(src) == 0
    box.replay(1)
    assert box.relay_once(src) == 1 and money(cluster)[b] == 1250
    with pytest.raises(InsufficientFundsError):
        box.transfer(2, a, b, 10_000)
    assert sum(money(cluster).values()) == 12_000 and sum(r.pending for r in box.pending().collect()) == 0


def test_streaming_relay(spark, cluster, tmp_path):
    def put(name, ids):
        r = [(i, 0, "credit", '{"tenant_id": 3, "cents": 5, "from": 1}', datetime(2024, 1, 1), None) for i in ids]
        spark.createDataFrame(r, OUTBOX).write.parquet(f"{tmp_path}/inbox/{name}")

    put("a", [1, 2, 2])
    for extra in (None, "b"):
        if extra:
            put(extra, [2, 3])  # 2 comes again in a later batch
        q = start_relay(cluster, f"{tmp_path}/inbox/*", f"{tmp_path}/cp")
        q.awaitTermination(60)
    assert money(cluster)[3] == 1015


def test_cursors():
    for c in (feed.Cursor(datetime(1, 1, 1), 0), feed.Cursor(datetime(2024, 1, 1, 0, 0, 0, 1), 5), feed.Cursor(datetime(1970, 1, 1), -7), feed.Cursor(datetime(1969, 12, 31, 23, 59, 59, 999999), (1 << 63) - 1)):
        assert feed.decode_cursor(c.encode()) == c
    assert feed.decode_cursor("") is None
    import base64

    enc = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    for bad in ("!!!", "MTox==", enc("12"), enc("x:1"), enc("1:x"), enc(f"{1 << 63}:1"), enc(":")):
        with pytest.raises(ValueError):
            feed.decode_cursor(bad)


@pytest.mark.parametrize("limit", [3, 7, 100])
def test_pages_visit_each_row_once(spark, limit):
    base = datetime(2024, 1, 1)
    data = [(i, base + timedelta(seconds=i // 3)) for i in range(20)] + [(100 + i, base + timedelta(seconds=3)) for i in range(4)]
    df = spark.createDataFrame(data, "id long, created_at timestamp_ntz").repartition(4).cache()
    want = [i for i, _ in sorted(data, key=lambda r: (r[1], r[0]), reverse=True)]
    seen, cursor = [], None
    while True:
        got, cursor = feed.page_recent(df, cursor, limit)
        if not got:
            break
        seen += [r.id for r in got]
        cursor = feed.decode_cursor(cursor.encode())
    assert seen == want
    assert [r.id for r in feed.merge_desc([df.where("id % 2 = 0"), None, df.where("id % 2 = 1"), df.limit(0)], 9).collect()] == want[:9]
    assert feed.merge_desc([None], 5) is None and feed.read_amplification(5, 4, 5) == 4


def test_page_plan_pushes_the_bound(spark, tmp_path):
    spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, created_at timestamp_ntz").write.parquet(f"{tmp_path}/f")
    plan = feed.page(spark.read.parquet(f"{tmp_path}/f"), feed.Cursor(datetime(2024, 1, 2), 5), 5)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(created_at" in plan and "TakeOrderedAndProject" in plan


def bulk(spark, root, shards):
    """Balances of 40 tenants, a transfer of each in the outbox."""
    c = Cluster(spark, root, Directory.even(64, shards)).create()
    t = spark.range(40).select(F.col("id").alias("tenant_id"))
    Together(c).insert("ledger", c.topology.with_shard(t.withColumn("balance_cents", F.lit(100).cast("long")))).commit()
    box = Outbox(c)
    box.transfer_all(t.select((F.col("tenant_id") + 1000).alias("id"), F.col("tenant_id").alias("source"), ((F.col("tenant_id") * 7 + 3) % 40).alias("target"), F.lit(5).cast("long").alias("cents")))
    return c, box


def test_relay_takes_as_many_jobs_whatever_the_shards(spark, tmp_path):
    sc, jobs = spark.sparkContext, {}
    for n in (2, 8):
        c, box = bulk(spark, f"{tmp_path}/c{n}", n)
        sc.setJobGroup(f"relay-{n}", "")
        assert box.relay_once(0, batch=None, crash_before_mark=True)
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"relay-{n}"))
        sc._jsc.clearJobGroup()
        versions = {s: store.version() for s, store in c.stores.items()}
        assert box.relay_once(0, batch=None)
        now = {s: store.version() for s, store in c.stores.items()}
        assert now == versions | {0: versions[0] + 1}  # marked, and nothing else is written
        if n == 2:
            box.relay_once(1, batch=None)
            want = {k: 95 for k in range(40)}
            for k in range(40):
                want[(k * 7 + 3) % 40] += 5
            assert money(c) == want and c.read("applied").count() == c.read("applied").select("event_id").distinct().count() == 40
    assert jobs[8] <= 1.5 * jobs[2]


def test_shards_that_cant_pay_change_nothing_beside_others(spark, tmp_path):
    c, box = bulk(spark, f"{tmp_path}/c", 4)
    before, poor = money(c), c.topology.read(7)
    moves = spark.createDataFrame([(1, 7, 8, 1000), *((k + 2, k, 7, 1) for k in range(40) if k != 7)], "id long, source long, target long, cents long")
    with pytest.raises(InsufficientFundsError):
        box.transfer_all(moves)
    after = money(c)
    for k in range(40):
        assert after[k] == before[k] - (c.topology.read(k) != poor)


def test_messages_are_never_broadcast(spark, cluster, monkeypatch):
    a, b = pair(cluster, False)
    box, plans = Outbox(cluster), []
    box.transfer(1, a, b, 5)
    seen = Directory.with_shard
    monkeypatch.setattr(Directory, "with_shard", lambda self, df, *x, **k: plans.append(df) or seen(self, df, *x, **k))
    assert box.relay_once(cluster.topology.read(a)) == 1
    box.replay(1)
    assert box.relay_once(cluster.topology.read(a)) == 1 and box.relay_once(cluster.topology.read(a)) == 0
    joins = [line for df in (*plans, box.pending()) for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftAnti" in line]
    assert joins and not [x for x in joins if "Broadcast" in x]
