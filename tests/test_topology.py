import pytest

from tidewell.operators import topology as T


@pytest.fixture(scope="module")
def tenants(spark):
    return spark.range(1, 3001).withColumnRenamed("id", "tenant_id")


def rings():
    four = T.Ring((0, 1, 2, 3))
    return four, four.add(4, 5, 6, 7)


def edited():
    d = T.Directory.even(1024, 4)
    return d.begin_move(11, 5).begin_move(900, 0).pin(77, 6).pin(42, 7).pin((1 << 64) - 1, 2)


@pytest.mark.parametrize("t", [T.ModN(5), T.ModN(8), rings()[1], edited()], ids=lambda t: t.name)
def test_columns_agree_with_scalars(spark, tenants, t):
    rows = t.with_shard(tenants.union(spark.createDataFrame([(-1,)], "tenant_id long"))).collect()
    assert all(r.shard == t.read(r.tenant_id) for r in rows)


def test_write_targets(tenants):
    d = edited()
    rows = d.with_targets(tenants).collect()
    assert all(r.targets == d.write(r.tenant_id) for r in rows)
    assert {len(r.targets) for r in rows} == {1, 2}
    assert d.write(42) == [7]


def test_churn_and_balance(spark):
    four, eight = rings()
    d = T.Directory.even(1024, 4)
    share = lambda a, b, n=100_000: T.churn(spark, a, b, n).first()["share"]
    assert share(T.ModN(4), T.ModN(8)) == 0.5
    assert share(T.ModN(4), T.ModN(5)) == 0.80004
    assert share(four, eight) == 0.4941
    assert share(d, T.split(d, 4)) == 0.49998
    rows = lambda t: [r.tenants for r in T.distribution(spark, t, 100_000).orderBy("shard").collect()]
    assert rows(T.ModN(4)) == [25001, 24999, 25000, 25000]
    assert rows(d) == [24998, 25002, 24997, 25003]
    assert rows(four) == [25540, 24203, 24953, 25304]
    one, many = rows(T.Ring(tuple(range(8)), 1)), rows(T.Ring(tuple(range(8))))
    assert max(many) / min(many) <= 1.3 < 3 < max(one) / min(one)


def test_a_ring_moves_tenants_to_new_shards_only(tenants):
    four, eight = rings()
    both = eight.with_shard(four.with_shard(tenants, out="a"), out="b").where("a <> b")
    assert both.where("b < 4").count() == 0 and both.count() > 0


def test_directory_edits():
    d = T.Directory.even(1024, 4)
    assert [len(d.logicals_on(p)) for p in range(4)] == [256] * 4
    assert T.Directory.even(10, 3).placement == (0, 0, 0, 1, 1, 1, 2, 2, 2, 2)
    for bad in ((2, 3), (5, 0)):
        with pytest.raises(ValueError):
            T.Directory.even(*bad)
    m = d.begin_move(300, 3)
    moving = [t for t in range(1, 5000) if d.logical(t) == 300]
    assert all(m.read(t) == d.read(t) and m.write(t) == [d.read(t), 3] for t in moving)
    c = m.commit(300)
    assert [t for t in range(1, 5000) if c.read(t) != d.read(t)] == moving
    assert all(c.logical(t) == d.logical(t) for t in range(1, 500))
    for wrong in (lambda: d.commit(5), lambda: d.begin_move(5000, 1), lambda: d.begin_move(0, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_placement_survives_the_file(spark, tmp_path):
    d = edited()
    T.save(spark, d, f"{tmp_path}/place.json")
    assert T.load(spark, f"{tmp_path}/place.json") == d
    assert T.load_or_init(spark, f"{tmp_path}/place.json", 8, 2) == d
    assert T.load_or_init(spark, f"{tmp_path}/new.json", 8, 2) == T.Directory.even(8, 2)


def test_missing_shards_are_refused():
    T.check_fits(edited(), range(8))
    with pytest.raises(T.IncompleteClusterError):
        T.check_fits(edited(), range(7))  # the pin to 7 counts


def test_rebalance_narrows_the_gap():
    d = T.Directory.even(16, 4)
    weight = {i: 100 if i < 4 else 10 for i in range(16)}
    for logical, target in T.rebalance_moves(d, weight, range(4)):
        d = d.begin_move(logical, target).commit(logical)
    load = [sum(weight[i] for i in d.logicals_on(p)) for p in range(4)]
    assert max(load) - min(load) <= 100 < 400 - 40


def test_route_report(spark):
    r = T.explain_route(spark, T.Directory.even(1024, 4), 1).first()
    assert (r.logical_shard, r.hash, r.pinned) == (18, "12161961113530546194", False)
