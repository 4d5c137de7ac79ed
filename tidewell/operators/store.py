"""Snapshot tables: immutable Parquet folders under a versioned manifest.

A store holds some tables of one place (a shard, say).  A transaction works on
a copy of the manifest; committing writes the next version, which must not be
there yet, so either all of its changes are seen or none, and of two writers
one fails.  A transaction can also be prepared under a name and committed or
rolled back later, by anyone.  Updates rewrite only the partitions that hold
matching rows; attaching, detaching and dropping are edits of the manifest.

Publishing needs a file system whose rename fails where the target exists (a
local disk, HDFS).  Object stores rename by copying, so they need a manifest
store of their own; data folders may lie anywhere.
"""

from __future__ import annotations

import copy
import json
import os
import time
import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators import partitions as P
from tidewell.sources.files import Files
from tidewell.sources.tables import conform

PART = "__part"


class ConflictError(RuntimeError):
    """Another writer committed first."""


class NotAffectedError(RuntimeError):
    """A statement that had to change rows changed none."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def version(self) -> int:
        names = [n for n in self.files.list(f"{self.root}/manifest") if n.endswith(".json")]
        return max((int(n.removesuffix(".json")) for n in names), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return self.files.read_json(f"{self.root}/manifest/{v:010d}.json") if v else {"tables": {}}

    def has_table(self, name: str) -> bool:
        return name in self.manifest()["tables"]

    def begin(self) -> Tx:
        v = self.version()
        return Tx(self, v, self.manifest(v))

    def scan(self, table: str, version: int | None = None, **where) -> DataFrame:
        v = self.version() if version is None else version
        return Tx(self, v, self.manifest(v)).scan(table, **where)

    def _publish(self, version: int, manifest: dict) -> None:
        if not self.files.create_text(f"{self.root}/manifest/{version:010d}.json", json.dumps(manifest, sort_keys=True)):
            raise ConflictError(f"version {version} of {self.root} is there already")

    # ---- prepared transactions

    def prepared(self) -> list[tuple[str, float]]:
        """Names of prepared transactions and their age in seconds."""
        out = []
        for n in self.files.list(f"{self.root}/prepared"):
            if n.endswith(".json"):
                out.append((n.removesuffix(".json"), time.time() - self.files.modified_ms(f"{self.root}/prepared/{n}") / 1000))
        return out

    def commit_prepared(self, gid: str) -> int:
        path = f"{self.root}/prepared/{gid}.json"
        doc = self.files.read_json(path)
        # what was prepared holds a lock on the version it started from
        self._publish(doc["base"] + 1, doc["manifest"])
        self.files.delete(path)
        return doc["base"] + 1

    def rollback_prepared(self, gid: str) -> None:
        self.files.delete(f"{self.root}/prepared/{gid}.json")

    # ---- maintenance

    def at(self, folder: str) -> str:
        """Path of a data folder: its own lie in the store, attached ones where they were."""
        return folder if folder.startswith("/") or "://" in folder or folder.startswith("file:") else f"{self.root}/{folder}"

    def _live(self, manifest: dict, table: str | None = None) -> set[str]:
        tables = [t for n, t in manifest["tables"].items() if table in (None, n)]
        return {d for t in tables for group in ("parts", "detached") for p in t[group].values() for d in p["dirs"]}

    def expire(self, keep: int = 1) -> int:
        """Delete folders that none of the last ``keep`` versions, nor a prepared one, refers to."""
        now = self.version()
        live: set[str] = set()
        for v in range(max(1, now - keep + 1), now + 1):
            live |= self._live(self.manifest(v))
        for gid, _ in self.prepared():
            live |= self._live(self.files.read_json(f"{self.root}/prepared/{gid}.json")["manifest"])
        gone = 0
        for name in self.files.list(f"{self.root}/data"):
            for part in self.files.list(f"{self.root}/data/{name}"):
                rel = f"data/{name}/{part}"
                if part.startswith(PART) and rel not in live:
                    gone += self.files.delete(f"{self.root}/{rel}")
        for v in range(1, now - keep + 1):
            self.files.delete(f"{self.root}/manifest/{v:010d}.json")
        return gone

    def size_report(self, table: str) -> DataFrame:
        """Bytes of a table's current snapshot and of its superseded ones that still lie there."""
        now = self._live(self.manifest(), table)
        live = sum(self.files.size(self.at(d)) for d in now)
        own = sum(self.files.size(f"{self.root}/data/{n}") for n in self.files.list(f"{self.root}/data") if n.rpartition("-")[0] == table)
        inside = sum(self.files.size(self.at(d)) for d in now if self.at(d) != d)
        return self.spark.createDataFrame([(table, live, max(0, own - inside))], "table string, live_bytes long, dead_bytes long")

    def view(self, table: str, name: str, version: int | None = None) -> None:
        """A temporary view of a snapshot, for SQL."""
        self.scan(table, version).createOrReplaceTempView(name)

    def tree(self, table: str) -> DataFrame:
        """Partitions with bounds, state and bytes."""
        t = self.manifest()["tables"][table]
        rows = []
        for group in ("parts", "detached"):
            for name, p in t[group].items():
                bound = next((f"[{p['lo']}, {p['hi']})" if k == "lo" else f"{k} {p[k]}" for k in ("lo", "value", "remainder") if k in p), "default")
                rows.append((table, name, bound, group == "parts", sum(self.files.size(self.at(d)) for d in p["dirs"])))
        return self.spark.createDataFrame(rows, "parent string, partition string, bounds string, attached boolean, bytes long")

    def partition_rows(self, table: str) -> DataFrame:
        """Rows of each attached partition, empty ones too; one scan, grouped by folder."""
        tx = self.begin()
        parts = tx.manifest["tables"][table]["parts"]
        known = self.spark.createDataFrame([(n, d) for n, p in parts.items() for d in p["dirs"] or [None]], "partition string, folder string")
        found = tx.with_folder(table, list(parts)).groupBy("folder").agg(F.count("*").alias("n"))
        counts = known.join(found, "folder", "left").groupBy("partition")
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


class Tx:
    """A transaction on a store."""

    def __init__(self, store: Store, base: int, manifest: dict):
        self.store, self.base, self.manifest = store, base, copy.deepcopy(manifest)
        self.spark = store.spark

    def commit(self) -> int:
        if any(True for _ in self.store.prepared()):
            raise ConflictError("a prepared transaction holds this store")
        self.store._publish(self.base + 1, self.manifest)
        return self.base + 1

    def prepare(self, gid: str) -> None:
        if self.store.prepared() or self.store.version() != self.base:
            raise ConflictError(f"{self.store.root} has moved on, or is held by another transaction")
        path = f"{self.store.root}/prepared/{gid}.json"
        if not self.store.files.create_text(path, json.dumps({"base": self.base, "manifest": self.manifest})):
            raise ConflictError(f"{gid} is prepared already")

    def savepoint(self) -> dict:
        """The state of the transaction, for :meth:`rollback_to`."""
        return copy.deepcopy(self.manifest)

    def rollback_to(self, point: dict) -> Tx:
        """Undo what was done since a savepoint."""
        self.manifest = copy.deepcopy(point)
        return self

    # ---- schema

    def create(self, name: str, schema: T.StructType, spec: P.Spec | None = None, unique: list[str] | None = None, default: bool = False) -> Tx:
        if name in self.manifest["tables"]:
            raise P.PartitionError(f"{name} exists")
        spec = spec or P.Whole()
        P.check_unique(spec, unique)
        parts = {n: p | {"dirs": []} for n, p in spec.initial().items()}
        if default:
            parts[P.DEFAULT] = {"dirs": []}
        self.manifest["tables"][name] = {"schema": schema.jsonValue(), "spec": P.spec_to_json(spec), "unique": unique, "parts": parts, "detached": {}}
        return self

    def _t(self, name: str) -> dict:
        return self.manifest["tables"][name]

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._t(name)["schema"])

    def spec(self, name: str) -> P.Spec:
        return P.spec_from_json(self._t(name)["spec"])

    # ---- reading

    def _read(self, name: str, dirs: list[str]) -> DataFrame:
        schema = self.schema(name)
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self.store.at(d) for d in dirs))

    def with_folder(self, name: str, partitions: list[str]) -> DataFrame:
        """Rows of some partitions with the data folder that each lies in."""
        dirs = [d for n in partitions for d in self._t(name)["parts"][n]["dirs"]]
        if not dirs:
            return self._read(name, dirs).withColumn("folder", F.lit(None).cast("string"))
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]*$", 1)
        # by their last two steps, which are unique: file systems spell the rest their own way
        tails = F.create_map(*(F.lit(x) for d in dirs for x in (_tail(self.store.at(d)), d)))
        return self._read(name, dirs).withColumn("folder", F.try_element_at(tails, F.substring_index(F.url_decode(folder), "/", -2)))

    def part(self, name: str, partition: str) -> DataFrame:
        return self._read(name, self._t(name)["parts"][partition]["dirs"])

    def touched(self, name: str, lo=None, hi=None, equals=None, isin=None, prune: bool = True) -> list[str]:
        parts = self._t(name)["parts"]
        return self.spec(name).touched(parts, lo, hi, equals, isin) if prune else list(parts)

    def scan(self, name: str, lo=None, hi=None, equals=None, isin=None, prune: bool = True) -> DataFrame:
        """Rows of the table in [lo, hi) of its range column, of one tenant or of some.

        Only folders of partitions that can hold such rows are listed and read;
        the predicate itself stays, and reaches the Parquet scan.
        """
        spec = self.spec(name)
        names = self.touched(name, lo, hi, equals, isin, prune)
        df = self._read(name, [d for n in names for d in self._t(name)["parts"][n]["dirs"]])
        if spec.range_column():
            c = F.col(spec.range_column())
            df = df.where(c >= F.lit(str(lo)).cast("timestamp_ntz")) if lo is not None else df
            df = df.where(c < F.lit(str(hi)).cast("timestamp_ntz")) if hi is not None else df
        if spec.tenant_column() and (equals is not None or isin is not None):
            df = df.where(F.col(spec.tenant_column()).isin([equals] if equals is not None else list(isin)))
        return df

    # ---- writing

    def _routed(self, name: str, df: DataFrame, beside: tuple[str, ...] = ()) -> DataFrame:
        """Rows in the table's schema with the partition of each; columns ``beside`` stay."""
        t = self._t(name)
        schema = T.StructType([*(df.schema[c] for c in beside), *self.schema(name).fields])
        routed = self.spec(name).route(conform(df, schema), t["parts"], PART)
        known = F.col(PART).isNotNull() & F.col(PART).isin(list(t["parts"]))
        routed = routed.withColumn(PART, F.when(known, F.col(PART)).otherwise(F.raise_error(F.lit(f"no partition of {name} for a row"))))
        if beside or len(t["parts"]) > 1:
            # a partition's rows meet in few tasks, a large one's in several: few files, none huge
            routed = routed.hint("rebalance", *(F.col(c) for c in (*beside, PART)))
        return routed

    def _write(self, name: str, df: DataFrame, sort: list[str] | None = None) -> dict[str, str]:
        """Route and write rows; folder by partition.  Nothing is referred to yet."""
        routed = self._routed(name, df)
        if sort:
            routed = routed.sortWithinPartitions(PART, *sort)
        rel = f"data/{name}-{uuid.uuid4().hex}"
        write_parts(routed, f"{self.store.root}/{rel}", name)
        return self._parts_in(rel)

    def _parts_in(self, rel: str) -> dict[str, str]:
        return {n.removeprefix(f"{PART}="): f"{rel}/{n}" for n in self.store.files.list(f"{self.store.root}/{rel}") if n.startswith(f"{PART}=")}

    def insert(self, name: str, df: DataFrame, sort: list[str] | None = None) -> Tx:
        for n, d in self._write(name, df, sort).items():
            self._t(name)["parts"][n]["dirs"].append(d)
        return self

    def insert_new(self, name: str, df: DataFrame, key: list[str]) -> Tx:
        """Rows whose key isn't there yet; of new rows with one key, one.  Only partitions
        that new rows belong to are read, and in them only row groups that may hold a key."""
        new = df.dropDuplicates(key)
        old = self._read(name, [d for n in self._homes(name, df, key) for d in self._t(name)["parts"][n]["dirs"]])
        if isinstance(old.schema[key[0]].dataType, T.IntegralType):
            low, high = df.agg(F.min(key[0]), F.max(key[0])).first()
            old = old.where(F.col(key[0]).between(low, high)) if low is not None else old
        return self.insert(name, new.join(old.select(*key), key, "left_anti"))

    def _homes(self, name: str, df: DataFrame, key: list[str]) -> list[str]:
        """Partitions that rows with the keys of ``df`` can lie in: all, unless the key
        holds the partition column."""
        spec, parts = self.spec(name), self._t(name)["parts"]
        if (spec.range_column() or spec.tenant_column()) not in key:
            return list(parts)
        routed = spec.route(df.select(*key).distinct(), parts, PART).select(PART).distinct().collect()  # a row a partition
        return [r[PART] for r in routed if r[PART] in parts]

    def replace(self, name: str, partitions: Iterable[str], df: DataFrame) -> Tx:
        """The given partitions' rows become ``df``, which may also add to others."""
        return self._put(name, partitions, self._write(name, df))

    def _put(self, name: str, partitions: Iterable[str], made: dict[str, str]) -> Tx:
        for n in partitions:
            self._t(name)["parts"][n]["dirs"] = []
        for n, d in made.items():
            self._t(name)["parts"][n]["dirs"].append(d)
        return self

    def _holding(self, name: str, where: Column) -> list[str]:
        """Partitions with matching rows, found in one scan."""
        parts = self._t(name)["parts"]
        rows = self.with_folder(name, list(parts)).where(where).select("folder").distinct().collect()  # a row a folder
        hit = {r["folder"] for r in rows}
        return [n for n, p in parts.items() if hit & set(p["dirs"])]

    def update(self, name: str, where: Column, values: dict[str, Column], must: bool = False) -> Tx:
        """Rewrite the partitions that hold matching rows; rows move where they now belong."""
        hit = self._holding(name, where)
        if not hit:
            if must:
                raise NotAffectedError(f"no row of {name} matches")
            return self
        dirs = [d for n in hit for d in self._t(name)["parts"][n]["dirs"]]
        match = F.coalesce(where, F.lit(False))
        old = self._read(name, dirs).withColumn("__hit", match)
        new = old.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("__hit")
        return self.replace(name, hit, new)

    def delete(self, name: str, where: Column) -> Tx:
        hit = self._holding(name, where)
        if hit:
            dirs = [d for n in hit for d in self._t(name)["parts"][n]["dirs"]]
            self.replace(name, hit, self._read(name, dirs).where(~F.coalesce(where, F.lit(False))))
        return self

    def upsert(self, name: str, df: DataFrame, key: list[str], add: list[str] = (), put: list[str] = ()) -> Tx:
        """Insert rows by key; where the key is there, columns of ``add`` grow by the
        new value and columns of ``put`` become it.  Only partitions that the new rows'
        keys belong to are read and rewritten."""
        homes = self._homes(name, df, key)
        if not homes:
            return self.insert(name, df)
        old = self._read(name, [d for n in homes for d in self._t(name)["parts"][n]["dirs"]])
        return self.replace(name, homes, merged(old, df, key, add, put))

    def truncate(self, name: str) -> Tx:
        for p in self._t(name)["parts"].values():
            p["dirs"] = []
        return self

    def compact(self, name: str, sort: list[str] | None = None) -> Tx:
        """One folder a partition again, sorted so that row groups have narrow ranges."""
        df = self.scan(name)
        made = self._write(name, df, sort)
        for n, p in self._t(name)["parts"].items():
            p["dirs"] = [made[n]] if n in made else []
        return self

    # ---- partition lifecycle

    def add_range(self, name: str, partition: str, lo: datetime, hi: datetime) -> Tx:
        """A new empty range.  Rows of the default that belong to it forbid it."""
        t = self._t(name)
        if partition in t["parts"]:
            raise P.PartitionError(f"{partition} exists")
        P.check_free(t["parts"], lo, hi)
        self._check_default(name, lo, hi)
        t["parts"][partition] = {"lo": lo.isoformat(" "), "hi": hi.isoformat(" "), "dirs": []}
        return self

    def _check_default(self, name: str, lo: datetime, hi: datetime) -> None:
        t = self._t(name)
        if P.DEFAULT in t["parts"] and t["parts"][P.DEFAULT]["dirs"]:
            c = F.col(self.spec(name).range_column())
            if self.part(name, P.DEFAULT).where(~P.outside(c, lo, hi)).limit(1).count():
                raise P.PartitionError(f"the default of {name} has rows of the new partition")

    def ensure(self, name: str, as_of: datetime, ahead: int = 3, back: int = 0) -> list[str]:
        """Create the units around ``as_of`` that are missing; returns their names."""
        made = []
        for partition, lo, hi in P.month_plan(as_of, back, ahead, self.spec(name).unit):
            if partition not in self._t(name)["parts"]:
                self.add_range(name, partition, lo, hi)
                made.append(partition)
        return made

    def attach(self, name: str, partition: str, lo: datetime, hi: datetime, path: str, trust_footers: bool = True) -> str:
        """Take a Parquet folder in as a partition, where it lies: nothing is copied, and
        the folder is never deleted here.  Its bounds are proved from file footers if
        they say enough, else by a scan.  Returns which of the two."""
        t = self._t(name)
        P.check_free(t["parts"], lo, hi)
        control = self.spec(name).range_column()
        proof = footer_bounds(self.spark, path, control) if trust_footers else None
        utc = lambda x: round((x - datetime(1970, 1, 1)).total_seconds() * 1e6)
        how = "footers"
        if proof is None or proof[2] or proof[0] is not None and (proof[0] < utc(lo) or proof[1] >= utc(hi)):
            how = "scan"
            rows = self.spark.read.schema(self.schema(name)).parquet(path)
            if rows.where(P.outside(F.col(control), lo, hi)).limit(1).count():
                raise P.PartitionError(f"rows of {path} are outside the bounds of {partition}")
        self._check_default(name, lo, hi)
        t["parts"][partition] = {"lo": lo.isoformat(" "), "hi": hi.isoformat(" "), "dirs": [path if self.store.at(path) == path else f"file:{os.path.abspath(path)}"]}
        return how

    def split_default(self, name: str, partition: str, lo: datetime, hi: datetime) -> Tx:
        """Move the default's rows of [lo, hi) to a partition of their own, in one step."""
        t = self._t(name)
        P.check_free(t["parts"], lo, hi)
        rows = self.part(name, P.DEFAULT)
        t["parts"][partition] = {"lo": lo.isoformat(" "), "hi": hi.isoformat(" "), "dirs": []}
        return self.replace(name, [P.DEFAULT], rows)

    def promote(self, name: str, tenant: int) -> Tx:
        """Give a tenant of a list table a partition of its own."""
        t, spec = self._t(name), self.spec(name)
        if f"v{tenant}" in t["parts"]:
            raise P.PartitionError(f"tenant {tenant} has a partition")
        (home,) = spec.touched(t["parts"], equals=tenant)
        rows = self.part(name, home)
        t["parts"][f"v{tenant}"] = {"value": tenant, "dirs": []}
        return self.replace(name, [home], rows)

    def detach(self, name: str, partition: str, concurrently: bool = False) -> Tx:
        t = self._t(name)
        if concurrently and P.DEFAULT in t["parts"]:
            raise P.PartitionError("can't detach concurrently while there is a default partition")
        if partition in t["parts"]:  # else it is done already
            t["detached"][partition] = t["parts"].pop(partition)
        return self

    def detach_beside_default(self, name: str, partition: str, drop: bool = False) -> Tx:
        """What a concurrent detach takes where there is a default: the default is
        detached, then the partition, and the default is attached again.  In one
        transaction, and each step may have been done before."""
        had = P.DEFAULT in self._t(name)["parts"] or P.DEFAULT in self._t(name)["detached"]
        self.detach(name, P.DEFAULT).detach(name, partition, concurrently=True)
        if drop:
            self.drop_detached(name, partition)
        return self.attach_back(name, P.DEFAULT) if had else self

    def attach_back(self, name: str, partition: str) -> Tx:
        t = self._t(name)
        if partition in t["detached"]:
            p = t["detached"].pop(partition)
            if "lo" in p:
                P.check_free(t["parts"], P.parse(p["lo"]), P.parse(p["hi"]))
            t["parts"][partition] = p
        return self

    def drop_detached(self, name: str, partition: str) -> Tx:
        self._t(name)["detached"].pop(partition, None)
        return self

    def retire(self, name: str, as_of: datetime, keep: int, archive: bool = False) -> list[str]:
        """Detach what ends by ``keep`` units before ``as_of``'s, oldest first; drop it
        unless ``archive``.  A partition without bounds is never retired."""
        unit = self.spec(name).unit
        cutoff = P.step(unit, P.floor_to(unit, as_of), -keep)
        old = sorted((P.parse(p["hi"]), n) for n, p in self._t(name)["parts"].items() if "hi" in p and P.parse(p["hi"]) <= cutoff)
        for _, n in old:
            self.detach(name, n)
            if not archive:
                self.drop_detached(name, n)
        return [n for _, n in old]

    def maintain(self, name: str, as_of: datetime, premake: int = 4, keep: int | None = None, archive: bool = True) -> tuple[list[str], list[str]]:
        """What is made ahead, and what is retired."""
        made = self.ensure(name, as_of, premake)
        return made, self.retire(name, as_of, keep, archive) if keep is not None else []

    def newest_bound(self, name: str) -> datetime | None:
        return max((P.parse(p["hi"]) for p in self._t(name)["parts"].values() if "hi" in p), default=None)

    def drop_table(self, name: str) -> Tx:
        """With all that it detached."""
        self.manifest["tables"].pop(name, None)
        return self


def write_parts(routed: DataFrame, path: str, name: str, beside: tuple[str, ...] = ()) -> None:
    """A folder a partition, below one for each value of ``beside``."""
    try:
        routed.write.partitionBy(*beside, PART).parquet(path)
    except Exception as e:
        if "no partition of" in str(e):
            raise P.NoPartitionError(f"no partition of {name} for a row") from None
        raise


def merged(old: DataFrame, df: DataFrame, key: list[str], add: list[str] = (), put: list[str] = ()) -> DataFrame:
    """Rows of ``old`` with those of ``df`` added to or put over them by key; see :meth:`Tx.upsert`."""
    aggs = [F.sum(c).cast(old.schema[c].dataType).alias(c) for c in add] + [F.max(c).alias(c) for c in put]
    new = df.groupBy(*key).agg(*aggs).withColumn("__new", F.lit(True))
    both = old.alias("o").join(new.alias("n"), key, "full_outer")
    value = {}
    for c in old.columns:
        if c in key:
            value[c] = F.col(c)
        elif c in add:
            value[c] = F.coalesce(F.col(f"o.{c}"), F.lit(0)) + F.coalesce(F.col(f"n.{c}"), F.lit(0))
        elif c in put:
            value[c] = F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        else:
            value[c] = F.col(f"o.{c}")
    return both.select(*(v.alias(c) for c, v in value.items()))


def _tail(path: str) -> str:
    return "/".join(path.rstrip("/").rsplit("/", 2)[-2:])


def footer_bounds(spark: SparkSession, path: str, column: str) -> tuple[int | None, int | None, int] | None:
    """Smallest and largest microsecond and the number of nulls of a timestamp
    column, from Parquet footers alone; None if some footer doesn't say."""
    jvm, conf, files = spark._jvm, spark._jsc.hadoopConfiguration(), Files(spark)
    lo = hi = None
    nulls = 0
    for name in files.list(path):
        if name.startswith(("_", ".")):
            continue
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), conf)
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        try:
            for block in reader.getFooter().getBlocks():
                for c in block.getColumns():
                    if c.getPath().toDotString() == column:
                        s = c.getStatistics()
                        kind = str(c.getPrimitiveType().getLogicalTypeAnnotation())
                        if s is None or s.isEmpty() or not s.isNumNullsSet() or "MICROS" not in kind:
                            return None
                        nulls += s.getNumNulls()
                        if s.hasNonNullValue():
                            a, b = s.genericGetMin(), s.genericGetMax()
                            lo, hi = a if lo is None else min(lo, a), b if hi is None else max(hi, b)
        finally:
            reader.close()
    return lo, hi, nulls
