import random
import threading
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hashing as H
from tidewell.functions import ids as I
from tidewell.functions.misc import human_bytes, human_bytes_column

GOLDEN = {1: 12161961113530546194, 2: 12161960014018917983, 42: 12161933625739840919, 1000000: 2740105236383194386}


def test_key_has_the_known_values():
    assert {t: H.key_of(t) for t in GOLDEN} == GOLDEN


def test_columns_agree_with_the_scalar(spark):
    ids = [*GOLDEN, 0, -1, (1 << 63) - 1, -(1 << 63), *random.Random(1).sample(range(1 << 62), 50)]
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "tenant_id long")
    got = H.with_key(df).withColumns({"one": H.key_column(F.col("tenant_id")), "text": H.unsigned_text(F.col("key")), "m7": H.umod(F.col("key"), 7), "m8": H.umod(F.col("key"), 8)}).collect()
    for r in got:
        if r.tenant_id is None:
            assert r.key is None and r.one is None
        else:
            k = H.key_of(r.tenant_id)
            assert (H.unsigned(r.key), r.one, r.text, r.m7, r.m8) == (k, r.key, str(k), k % 7, k % 8)


def test_sequential_tenants_spread():
    counts = [0] * 8
    for t in range(8000):
        counts[H.key_of(t) % 8] += 1
    assert max(counts) / min(counts) < 1.1
    assert max(H.key_of(t) for t in range(256)) - min(H.key_of(t) for t in range(256)) == 280375465193805


@pytest.mark.parametrize("shard", [-1, 1024, 2000, 1 << 20])
def test_shards_out_of_range(shard):
    with pytest.raises(ValueError):
        I.IdGenerator(shard)


@pytest.mark.parametrize("shard", [0, 1, 7, 512, 1023])
def test_ids_decode(shard):
    ms = I.EPOCH_MS + 123_456
    g = I.IdGenerator(shard, lambda: ms)
    p = I.decode_id(g.next())
    assert (p.shard, p.seq, p.at) == (shard, 0, datetime.fromtimestamp(ms / 1000, UTC))


def test_ids_grow_when_the_clock_stands_still_or_goes_back():
    now = [I.EPOCH_MS + 60_000]
    g = I.IdGenerator(3, lambda: now[0])
    seen = [g.next() for _ in range(9000)]
    now[0] -= 10_000
    seen += [g.next() for _ in range(9000)]
    now[0] += 60_000
    seen.append(g.next())
    assert all(a < b for a, b in zip(seen, seen[1:], strict=False))
    assert {I.decode_id(x).shard for x in seen} == {3}


def test_ids_are_unique_across_threads():
    g, out = I.IdGenerator(5), []

    def work():
        out.append([g.next() for _ in range(5000)])

    ts = [threading.Thread(target=work) for _ in range(8)]
    for t in ts:
        t.start()
    for t in ts:
        t.join()
    assert len({x for xs in out for x in xs}) == 40_000
    assert all(a < b for xs in out for a, b in zip(xs, xs[1:], strict=False))


def test_bulk_ids(spark):
    df = spark.range(15_000).select((F.col("id") % 3).cast("int").alias("shard"), F.col("id").alias("n"))
    got = I.with_ids(df, "shard", I.EPOCH_MS + 1000, [F.col("n")]).orderBy("shard", "n").collect()
    assert len({r.id for r in got}) == 15_000
    for s in range(3):
        own = [r.id for r in got if r.shard == s]
        assert own == sorted(own) and I.decode_id(own[4096]).seq == 0 and {I.decode_id(x).shard for x in own} == {s}


def test_human_bytes(spark):
    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KiB", 1536: "1.5 KiB", 1 << 20: "1.0 MiB", 5 << 30: "5.0 GiB"}
    assert {n: human_bytes(n) for n in want} == want
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", human_bytes_column(F.col("n")).alias("t")).collect()
    assert {r.n: r.t for r in got} == want


def test_sizes_round_halves_to_the_even_tenth(spark):
    rng = random.Random(7)
    halves = [s * rng.randrange(1024) * 1024**k + s * q * 1024**k // 4 for k in range(1, 6) for q in (5, 7) for s in (1, -1) for _ in range(20)]
    near = [round(x * 2**50) for x in (1.15, 2.35, 4.05, 4.15, 5.15, 7.95)]
    ns = [1280, 1792, -1280, *halves, *near, *(rng.randrange(1 << rng.randrange(1, 60)) for _ in range(500))]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", human_bytes_column(F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == [human_bytes(n) for n in ns]
    assert got[0].t == "1.2 KiB" and got[1].t == "1.8 KiB" and got[2].t == "-1.2 KiB"
