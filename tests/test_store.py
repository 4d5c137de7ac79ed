from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.operators import partitions as P
from tidewell.operators.store import ConflictError, NotAffectedError, Store, footer_bounds
from tidewell.sources.tables import EVENTS, ORDERS


def events(spark, days, start="2024-01-01", tenant=1, n=3):
    rows = spark.range(days * n).withColumn("d", (F.col("id") / n).cast("int"))
    at = F.expr(f"timestamp_ntz'{start}' + make_dt_interval(d, cast(id % {n} as int))")
    return rows.select("id", (F.col("id") % 5 + tenant).alias("tenant_id"), at.alias("occurred_at"), F.lit("view").alias("kind"), F.lit("done").alias("status"), (F.col("id") * 10).alias("amount_cents"), F.lit("{}").alias("payload"))


@pytest.fixture
def monthly(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/store")
    tx = s.begin().create("events", EVENTS, P.RangeSpec("occurred_at", "month"), unique=["id", "occurred_at"], default=True)
    assert len(tx.ensure("events", datetime(2024, 3, 15), ahead=1, back=13)) == 15
    tx.insert("events", events(spark, 90)).commit()
    return s


def test_ranges_route_and_prune(spark, monthly):
    rows = {r.partition: r.rows for r in monthly.partition_rows("events").collect()}
    assert rows["p_2024_01"] == 93 and rows["p_2024_02"] == 87 and rows[P.DEFAULT] == 0 and len(rows) == 16
    tx = monthly.begin()
    assert set(tx.touched("events", datetime(2024, 2, 1), datetime(2024, 3, 1))) == {"p_2024_02", P.DEFAULT}
    got = monthly.scan("events", lo=datetime(2024, 1, 31), hi=datetime(2024, 2, 2))
    assert got.count() == 6 and len(got.inputFiles()) < len(monthly.scan("events", prune=False).inputFiles())
    assert monthly.scan("events", lo=datetime(2024, 1, 31), hi=datetime(2024, 2, 2), prune=False).count() == 6


def test_stray_rows(spark, monthly, tmp_path):
    stray = events(spark, 1, "1999-01-01", n=1)
    monthly.begin().insert("events", stray).commit()
    assert {r.partition: r.rows for r in monthly.partition_rows("events").collect()}[P.DEFAULT] == 1
    tx = monthly.begin()
    with pytest.raises(P.PartitionError, match="default"):
        tx.add_range("events", "p_1999_01", datetime(1999, 1, 1), datetime(1999, 2, 1))
    tx.split_default("events", "p_1999_01", datetime(1999, 1, 1), datetime(1999, 2, 1)).commit()
    rows = {r.partition: r.rows for r in monthly.partition_rows("events").collect()}
    assert rows[P.DEFAULT] == 0 and rows["p_1999_01"] == 1
    bare = Store(spark, f"{tmp_path}/bare")
    bare.begin().create("events", EVENTS, P.RangeSpec("occurred_at", "month")).commit()
    with pytest.raises(P.NoPartitionError):
        bare.begin().insert("events", stray)


def test_update_delete_move(spark, monthly):
    before = monthly.version()
    tx = monthly.begin()
    tx.update("events", F.col("id") % 10 == 0, {"status": F.lit("reopened")}).commit()
    assert monthly.scan("events").where("status = 'reopened'").count() == 27
    tx = monthly.begin().update("events", F.col("id") == 0, {"occurred_at": F.expr("timestamp_ntz'2024-02-10'")})
    assert tx.part("events", "p_2024_02").where("id = 0").count() == 1
    tx.commit()
    tx = monthly.begin().delete("events", F.col("occurred_at") < F.lit("2024-02-01").cast("timestamp_ntz"))
    tx.commit()
    assert monthly.scan("events").count() == 270 - 92
    assert monthly.scan("events", version=before).count() == 270
    with pytest.raises(NotAffectedError):
        monthly.begin().update("events", F.col("id") == -5, {"status": F.lit("x")}, must=True)
    assert monthly.size_report("events").first().dead_bytes > 0
    assert monthly.expire() > 0
    assert monthly.size_report("events").first().dead_bytes == 0
    assert monthly.scan("events").count() == 178


def test_only_one_writer_wins(spark, monthly):
    a, b = monthly.begin(), monthly.begin()
    a.truncate("events").commit()
    with pytest.raises(ConflictError):
        b.truncate("events").commit()
    assert monthly.scan("events").count() == 0


def test_detach_retire_maintain(spark, monthly):
    tx = monthly.begin()
    with pytest.raises(P.PartitionError):
        tx.detach("events", "p_2024_01", concurrently=True)
    tx.detach("events", "p_2024_01").detach("events", "p_2024_01").commit()
    assert monthly.scan("events").count() == 270 - 93
    monthly.begin().attach_back("events", "p_2024_01").commit()
    assert monthly.scan("events").count() == 270
    tx = monthly.begin()
    gone = tx.retire("events", datetime(2024, 3, 15), keep=1, archive=True)
    assert gone[0] == "p_2023_02" and gone[-1] == "p_2024_01" and tx.retire("events", datetime(2024, 3, 15), 1) == []
    tx.commit()
    assert {r.partition for r in monthly.tree("events").where("NOT attached").collect()} == set(gone)
    assert monthly.begin().newest_bound("events") == datetime(2024, 5, 1)
    tx = monthly.begin()
    made, retired = tx.maintain("events", datetime(2024, 4, 2), premake=2, keep=1)
    assert made == ["p_2024_05", "p_2024_06"] and retired == ["p_2024_02"]
    assert tx.ensure("events", datetime(2024, 4, 2), 2) == []


def test_attach(spark, monthly, tmp_path):
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    events(spark, 20, "2020-02-01").write.parquet(good)
    events(spark, 40, "2020-03-01").write.parquet(bad)
    lo, hi, nulls = footer_bounds(spark, good, "occurred_at")
    assert nulls == 0 and lo == 1580515200000000 and hi < 1582243200000000
    tx = monthly.begin()
    assert tx.attach("events", "p_2020_02", datetime(2020, 2, 1), datetime(2020, 3, 1), good) == "footers"
    tx.commit()
    assert monthly.scan("events", lo=datetime(2020, 2, 1), hi=datetime(2020, 3, 1)).count() == 60
    with pytest.raises(P.PartitionError, match="outside"):
        monthly.begin().attach("events", "p_2020_03", datetime(2020, 3, 1), datetime(2020, 4, 1), bad)
    with pytest.raises(P.PartitionError, match="overlaps"):
        monthly.begin().attach("events", "again", datetime(2020, 2, 10), datetime(2020, 2, 11), good)


def orders(spark, n=400, tenants=40):
    return spark.range(n).select("id", (F.col("id") % tenants + 1).alias("tenant_id"), F.expr("timestamp_ntz'2024-01-01'").alias("placed_at"), F.col("id").alias("total_cents"), F.lit("new").alias("state"))


def test_hash_and_list(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/o")
    s.begin().create("h", ORDERS, P.HashSpec(modulus=8)).create("l", ORDERS, P.ListSpec(values=(1, 2))).insert("h", orders(spark)).insert("l", orders(spark)).commit()
    tx = s.begin()
    assert len(tx.touched("h", equals=7)) == 1 and len(tx.touched("h", isin=[1, 5, 9])) <= 3 and len(tx.touched("h")) == 8
    assert s.scan("h", equals=7).count() == 10 and s.scan("h", isin=[1, 5, 9]).count() == 30
    assert tx.touched("l", equals=1) == ["v1"] and s.scan("l", equals=1).count() == 10 and tx.touched("l", equals=7)[0].startswith("r")
    tx.promote("l", 7).commit()
    assert s.begin().touched("l", equals=7) == ["v7"] and s.scan("l", equals=7).count() == 10 and s.scan("l").count() == 400
    s.begin().compact("h", ["tenant_id"]).commit()
    assert s.scan("h").count() == 400
    with pytest.raises(P.PartitionError, match="unique"):
        s.begin().create("x", ORDERS, P.HashSpec(), unique=["id"])
    with pytest.raises(P.PartitionError):
        P.check_moduli([(4, 0), (6, 1)])
    with pytest.raises(P.PartitionError):
        P.check_moduli([(4, 0), (8, 4)])
    P.check_moduli([(4, 0), (8, 1), (8, 5)])


def test_upsert(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/u")
    s.begin().create("o", ORDERS).insert("o", orders(spark, 10)).commit()
    new = orders(spark, 12).withColumns({"total_cents": F.lit(100).cast("long"), "placed_at": F.expr("timestamp_ntz'2024-01-01'")})
    s.begin().insert_new("o", new, ["id"]).commit()
    assert {r.id: r.total_cents for r in s.scan("o").collect()} == {i: i if i < 10 else 100 for i in range(12)}


def test_attached_folders_stay_where_they_are(spark, monthly, tmp_path):
    good = f"{tmp_path}/kept"
    events(spark, 20, "2021-02-01").write.parquet(good)
    tx = monthly.begin()
    tx.attach("events", "p_2021_02", datetime(2021, 2, 1), datetime(2021, 3, 1), good)
    tx.commit()
    assert all("kept" in f for f in monthly.scan("events", lo=datetime(2021, 2, 1), hi=datetime(2021, 2, 10)).inputFiles() if "2021" in f or "kept" in f)
    monthly.begin().update("events", (F.col("occurred_at") < F.expr("timestamp_ntz'2022-01-01'")) & (F.col("id") == 1), {"status": F.lit("moved")}).commit()
    assert monthly.scan("events", lo=datetime(2021, 2, 1), hi=datetime(2021, 3, 1)).where("status = 'moved'").count() == 1
    monthly.expire()
    assert spark.read.parquet(good).where("status = 'moved'").count() == 0 and spark.read.parquet(good).count() == 60


def test_sizes_are_of_one_table(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/two")
    s.begin().create("a", ORDERS).create("ab", ORDERS).insert("a", orders(spark)).insert("ab", orders(spark)).commit()
    s.begin().truncate("a").commit()
    a, ab = (s.size_report(n).first() for n in ("a", "ab"))
    assert a.live_bytes == 0 and a.dead_bytes > 0 and ab.live_bytes > 0 and ab.dead_bytes == 0


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/up")
    s.begin().create("o", ORDERS, P.HashSpec(modulus=8), unique=["tenant_id"]).insert("o", orders(spark, 40)).commit()
    parts = lambda: {n: p["dirs"] for n, p in s.manifest()["tables"]["o"]["parts"].items()}
    before = parts()
    one = orders(spark, 7).where("id = 6").withColumn("total_cents", F.lit(5).cast("long"))
    s.begin().upsert("o", one.select("tenant_id", "total_cents"), ["tenant_id"], add=["total_cents"]).commit()
    after = parts()
    assert sum(before[n] != after[n] for n in before) == 1
    assert s.scan("o", equals=7).first().total_cents == 11
    again = orders(spark, 50).withColumn("total_cents", F.lit(9).cast("long"))
    s.begin().insert_new("o", again, ["tenant_id", "id"]).commit()
    assert s.scan("o").count() == 50


def test_savepoints_and_views(spark, monthly):
    tx = monthly.begin().delete("events", F.col("id") < 100)
    point = tx.savepoint()
    tx.truncate("events").detach("events", "p_2024_02")
    tx.rollback_to(point).commit()
    monthly.view("events", "events_now")
    assert spark.sql("SELECT count(*) AS n FROM events_now").first().n == 170


def test_detaching_beside_a_default(monthly):
    for _ in range(2):
        monthly.begin().detach_beside_default("events", "p_2024_01").commit()
    t = monthly.manifest()["tables"]["events"]
    assert P.DEFAULT in t["parts"] and set(t["detached"]) == {"p_2024_01"}


def test_plain_ranges_are_routed_by_their_names(spark):
    spec = P.RangeSpec("occurred_at", "month")
    parts = {n: {"lo": str(lo), "hi": str(hi)} for n, lo, hi in P.month_plan(datetime(2024, 3, 1), 2, 3)}
    del parts["p_2024_04"]
    parts["half"] = {"lo": "2024-04-01 00:00:00", "hi": "2024-04-16 00:00:00"}
    assert len(spec._runs(parts)) == 3
    got = {r.p: r.n for r in spec.route(events(spark, 160, n=1), parts, "p").groupBy("p").agg(F.count("*").alias("n")).collect()}
    assert got == {"p_2024_01": 31, "p_2024_02": 29, "p_2024_03": 31, "half": 15, None: 15, "p_2024_05": 31, "p_2024_06": 8}
