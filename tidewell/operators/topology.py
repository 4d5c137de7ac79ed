"""Where tenants live: three topologies, as Python objects and as columns.

Each topology answers for one tenant on the driver (``read``, ``write``) and
for a whole table (``with_shard``).  All are immutable; edits give new ones.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.hashing import fmix64, key_of, signed, umod, unsigned, with_key
from tidewell.sources.files import Files

LOGICAL = 1024


class Topology(Protocol):
    name: str

    def read(self, tenant: int) -> int: ...
    def write(self, tenant: int) -> list[int]: ...
    def shards(self) -> set[int]: ...
    def with_shard(self, df: DataFrame, tenant: str = "tenant_id", out: str = "shard") -> DataFrame: ...


class IncompleteClusterError(ValueError):
    """A placement names shards that the cluster doesn't have."""


@dataclass(frozen=True)
class ModN:
    """Key modulo the number of shards."""

    n: int

    def __post_init__(self) -> None:
        if self.n < 1:
            raise ValueError("a topology needs a shard")

    @property
    def name(self) -> str:
        return f"mod-{self.n}"

    def read(self, tenant: int) -> int:
        return key_of(tenant) % self.n

    def write(self, tenant: int) -> list[int]:
        return [self.read(tenant)]

    def shards(self) -> set[int]:
        return set(range(self.n))

    def with_shard(self, df: DataFrame, tenant: str = "tenant_id", out: str = "shard") -> DataFrame:
        return with_key(df, tenant, "__key").withColumn(out, umod(F.col("__key"), self.n).cast("int")).drop("__key")


@dataclass(frozen=True)
class Ring:
    """Consistent hashing: a tenant belongs to the next point on the circle."""

    members: tuple[int, ...]
    vnodes: int = 200
    points: tuple[tuple[int, int], ...] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        if not self.members or self.vnodes < 1:
            raise ValueError("a ring needs shards and points")
        spots = {}
        for s in self.members:
            for i in range(self.vnodes):
                spots.setdefault(fmix64(key_of(s << 32 | i)), s)
        object.__setattr__(self, "points", tuple(sorted(spots.items())))

    @property
    def name(self) -> str:
        return f"ring-{len(self.members)}"

    def add(self, *shards: int) -> Ring:
        return Ring((*self.members, *(s for s in shards if s not in self.members)), self.vnodes)

    def read(self, tenant: int) -> int:
        at = bisect.bisect_left(self.points, (fmix64(key_of(tenant)), -1))
        return self.points[at % len(self.points)][1]

    def write(self, tenant: int) -> list[int]:
        return [self.read(tenant)]

    def shards(self) -> set[int]:
        return set(self.members)

    def with_shard(self, df: DataFrame, tenant: str = "tenant_id", out: str = "shard") -> DataFrame:
        """A binary search of the sorted points, vectorised; the points are
        ``shards * vnodes`` numbers, a bound that no table changes."""
        spots = np.array([p for p, _ in self.points], np.uint64)
        owner = np.array([s for _, s in self.points], np.int32)

        @F.pandas_udf("int")
        def successor(key: pd.Series) -> pd.Series:
            from tidewell.functions.hashing import fmix64_array

            missing = key.isna()
            h = fmix64_array(key.fillna(0).to_numpy(np.int64).view(np.uint64))
            return pd.Series(owner[np.searchsorted(spots, h, "left") % len(spots)]).astype("Int32").mask(missing.to_numpy())

        return with_key(df, tenant, "__key").withColumn(out, successor("__key")).drop("__key")


@dataclass(frozen=True)
class Directory:
    """Logical shards placed on physical ones by an editable table.

    ``moving`` holds logical shards with a second write target, ``pins`` single
    tenants with a shard of their own; a pin wins over the placement.
    """

    placement: tuple[int, ...]
    moving: dict[int, int] = field(default_factory=dict)
    pins: dict[int, int] = field(default_factory=dict)  # by unsigned tenant id

    @classmethod
    def even(cls, logical: int, physical: int) -> Directory:
        """Contiguous ranges of logical shards; what is left over goes to the last."""
        if physical < 1 or logical < physical:
            raise ValueError("need at least as many logical shards as physical ones, and one of those")
        each = logical // physical
        return cls(tuple(min(i // each, physical - 1) for i in range(logical)))

    @property
    def name(self) -> str:
        return f"directory-{len(set(self.placement))}"

    @property
    def logical_count(self) -> int:
        return len(self.placement)

    def logical(self, tenant: int) -> int:
        return key_of(tenant) % self.logical_count

    def read(self, tenant: int) -> int:
        return self.pins.get(unsigned(tenant), self.placement[self.logical(tenant)])

    def write(self, tenant: int) -> list[int]:
        """Source first; while the logical shard moves, its target too.  Pinned tenants never write twice."""
        if unsigned(tenant) in self.pins:
            return [self.pins[unsigned(tenant)]]
        at = self.logical(tenant)
        return [self.placement[at]] + ([self.moving[at]] if at in self.moving else [])

    def shards(self) -> set[int]:
        return {*self.placement, *self.moving.values(), *self.pins.values()}

    def logicals_on(self, physical: int) -> list[int]:
        return [i for i, p in enumerate(self.placement) if p == physical]

    def _checked(self, logical: int) -> int:
        if not 0 <= logical < self.logical_count:
            raise ValueError(f"no logical shard {logical}")
        return logical

    def begin_move(self, logical: int, target: int) -> Directory:
        if self.placement[self._checked(logical)] == target:
            raise ValueError(f"logical shard {logical} is on {target} already")
        return replace(self, moving=self.moving | {logical: target})

    def commit(self, logical: int) -> Directory:
        if self._checked(logical) not in self.moving:
            raise ValueError(f"logical shard {logical} isn't moving")
        placed = list(self.placement)
        placed[logical] = self.moving[logical]
        return replace(self, placement=tuple(placed), moving={k: v for k, v in self.moving.items() if k != logical})

    def cancel(self, logical: int) -> Directory:
        return replace(self, moving={k: v for k, v in self.moving.items() if k != logical})

    def pin(self, tenant: int, physical: int) -> Directory:
        return replace(self, pins=self.pins | {unsigned(tenant): physical})

    def to_json(self) -> dict:
        return {"logical_count": self.logical_count, "placement": list(self.placement), "migrating": {str(k): v for k, v in self.moving.items()}, "pins": {str(k): v for k, v in self.pins.items()}}

    @classmethod
    def from_json(cls, doc: dict) -> Directory:
        if doc["logical_count"] != len(doc["placement"]) or not doc["placement"]:
            raise ValueError("placement and logical_count differ")
        ints = lambda m: {int(k): int(v) for k, v in (m or {}).items()}
        return cls(tuple(map(int, doc["placement"])), ints(doc.get("migrating")), ints(doc.get("pins")))

    def _placed(self) -> Column:
        """The placement as one array literal, parsed in one call."""
        return F.expr(f"array({','.join(map(str, self.placement))})")

    def with_logical(self, df: DataFrame, tenant: str = "tenant_id", out: str = "logical_shard") -> DataFrame:
        return with_key(df, tenant, "__key").withColumn(out, umod(F.col("__key"), self.logical_count).cast("int")).drop("__key")

    def _pinned(self, tenant: Column) -> Column:
        # one map literal: pins are an operator's edits, a handful
        if not self.pins:
            return F.lit(None).cast("int")
        pairs = F.create_map(*(F.lit(x) for k, v in self.pins.items() for x in (signed(k), v)))
        return F.try_element_at(pairs, tenant.cast("long"))

    def with_shard(self, df: DataFrame, tenant: str = "tenant_id", out: str = "shard") -> DataFrame:
        """An array literal of the placement, indexed by logical shard: no join, no shuffle."""
        return self.with_logical(df, tenant, "__logical").withColumn(out, F.coalesce(self._pinned(F.col(tenant)), F.element_at(self._placed(), F.col("__logical") + 1))).drop("__logical")

    def with_place(self, df: DataFrame, tenant: str = "tenant_id", logical: str = "logical_shard", out: str = "shard") -> DataFrame:
        """Logical shard and shard from one key."""
        placed = F.element_at(self._placed(), F.col(logical) + 1)
        return self.with_logical(df, tenant, logical).withColumn(out, F.coalesce(self._pinned(F.col(tenant)), placed))

    def with_targets(self, df: DataFrame, tenant: str = "tenant_id", out: str = "targets") -> DataFrame:
        """Write targets as an array, source first."""
        second = F.lit(None).cast("int")
        if self.moving:
            second = F.try_element_at(F.expr(f"map({','.join(f'{k},{v}' for k, v in self.moving.items())})"), F.col("__logical"))
        source = F.element_at(self._placed(), F.col("__logical") + 1)
        pinned = self._pinned(F.col(tenant))
        both = F.when(pinned.isNotNull(), F.array(pinned)).when(second.isNotNull(), F.array(source, second)).otherwise(F.array(source))
        return self.with_logical(df, tenant, "__logical").withColumn(out, both).drop("__logical")


def split_moves(directory: Directory, old: int) -> Iterator[tuple[int, int]]:
    """(logical shard, target) for doubling ``old`` shards: the second half of each one's
    logical shards goes to the shard ``old`` further on."""
    for p in range(old):
        own = directory.logicals_on(p)
        for logical in own[len(own) // 2 :]:
            yield logical, p + old


def split(directory: Directory, old: int) -> Directory:
    for logical, target in list(split_moves(directory, old)):
        directory = directory.begin_move(logical, target).commit(logical)
    return directory


def rebalance_moves(directory: Directory, weight: dict[int, int], shards: Iterable[int]) -> list[tuple[int, int]]:
    """Greedy plan: from the fullest shard to the emptiest, as long as the gap shrinks."""
    load = dict.fromkeys(shards, 0)
    placed = dict(enumerate(directory.placement))
    for logical, p in placed.items():
        load[p] = load.get(p, 0) + weight.get(logical, 0)
    plan = []
    while True:
        high, low = max(load, key=lambda s: (load[s], s)), min(load, key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        fits = [(weight.get(i, 0), -i) for i, p in placed.items() if p == high and 0 < weight.get(i, 0) < gap]
        if not fits:
            return plan
        w, i = max(x for x in fits if x[0] <= (gap + 1) // 2) if any(x[0] <= (gap + 1) // 2 for x in fits) else min(fits)
        placed[-i] = low
        load[high] -= w
        load[low] += w
        plan.append((-i, low))


def check_fits(topology: Topology, shards: Iterable[int]) -> None:
    """Raise unless the cluster has every shard that the topology names."""
    missing = topology.shards() - set(shards)
    if missing:
        raise IncompleteClusterError(f"{topology.name} needs shards {sorted(missing)}, which the cluster lacks")


def save(spark: SparkSession, directory: Directory, path: str) -> None:
    Files(spark).write_json(path, directory.to_json())


def load(spark: SparkSession, path: str) -> Directory:
    return Directory.from_json(Files(spark).read_json(path))


def load_or_init(spark: SparkSession, path: str, logical: int, physical: int) -> Directory:
    if Files(spark).exists(path):
        return load(spark, path)
    made = Directory.even(logical, physical)
    save(spark, made, path)
    return made


def churn(spark: SparkSession, before: Topology, after: Topology, sample: int) -> DataFrame:
    """Share of the tenants 1 to ``sample`` whose home differs."""
    t = spark.range(1, sample + 1).withColumnRenamed("id", "tenant_id")
    both = after.with_shard(before.with_shard(t, out="a"), out="b")
    return both.agg(F.count("*").alias("tenants"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("moved")).withColumn("share", F.col("moved") / F.col("tenants"))


def distribution(spark: SparkSession, topology: Topology, sample: int) -> DataFrame:
    """Tenants by shard, over the tenants 1 to ``sample``."""
    t = spark.range(1, sample + 1).withColumnRenamed("id", "tenant_id")
    return topology.with_shard(t).groupBy("shard").agg(F.count("*").alias("tenants"))


def explain_route(spark: SparkSession, directory: Directory, tenant: int) -> DataFrame:
    """How one tenant is routed."""
    return spark.createDataFrame(
        [(tenant, str(key_of(tenant)), directory.logical(tenant), directory.read(tenant), directory.write(tenant), unsigned(tenant) in directory.pins)],
        "tenant_id long, hash string, logical_shard int, shard int, targets array<int>, pinned boolean",
    )
