"""How a table is cut into partitions: ranges of time, hashes, lists.

A spec routes rows to partition names with one column expression, tells which
partitions a predicate can touch, and refuses what can't hold.  Partitions and
their bounds are metadata (plain dicts, kept in a manifest); nothing here reads
data.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.hashing import key_of, umod, with_key

DEFAULT = "__default__"


class PartitionError(ValueError):
    """A partition operation that the rules forbid."""


class NoPartitionError(PartitionError):
    """Rows that no partition takes, in a table without a default."""


def floor_to(unit: str, t: datetime) -> datetime:
    t = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "day":
        return t
    if unit == "month":
        return t.replace(day=1)
    if unit == "year":
        return t.replace(month=1, day=1)
    raise PartitionError(f"unknown unit {unit}")


def step(unit: str, t: datetime, n: int) -> datetime:
    """The start of the unit ``n`` after the one that starts at ``t``."""
    if unit == "day":
        return t + timedelta(days=n)
    months = t.year * 12 + t.month - 1 + (n if unit == "month" else 12 * n)
    return t.replace(year=months // 12, month=months % 12 + 1)


def range_name(unit: str, start: datetime) -> str:
    return "p_" + start.strftime({"day": "%Y_%m_%d", "month": "%Y_%m", "year": "%Y"}[unit])


def parse(t: str | datetime) -> datetime:
    return t if isinstance(t, datetime) else datetime.fromisoformat(t)


@dataclass(frozen=True)
class RangeSpec:
    """Half-open ranges of a timestamp column, one a unit unless attached otherwise."""

    column: str
    unit: str = "month"
    kind: str = "range"

    def _runs(self, parts: dict[str, dict]) -> list[tuple[datetime, datetime, str | None]]:
        """The ranges, those that are plain units and follow each other as one (without a name)."""
        out: list[tuple[datetime, datetime, str | None]] = []
        for lo, hi, name in sorted((parse(p["lo"]), parse(p["hi"]), n) for n, p in parts.items() if "lo" in p):
            plain = lo == floor_to(self.unit, lo) and hi == step(self.unit, lo, 1) and name == range_name(self.unit, lo)
            if plain and out and out[-1][1] == lo and out[-1][2] is None:
                out[-1] = (out[-1][0], hi, None)
            else:
                out.append((lo, hi, None if plain else name))
        return out

    def route(self, df: DataFrame, parts: dict[str, dict], out: str) -> DataFrame:
        """One comparison for all plain units in a row, whose name follows from the time."""
        c = F.col(self.column).cast("timestamp_ntz")
        by_time = F.concat(F.lit("p_"), F.date_format(c, {"day": "yyyy_MM_dd", "month": "yyyy_MM", "year": "yyyy"}[self.unit]))
        expr = F.lit(None).cast("string")
        for lo, hi, name in self._runs(parts):
            inside = (c >= F.lit(str(lo)).cast("timestamp_ntz")) & (c < F.lit(str(hi)).cast("timestamp_ntz"))
            expr = F.when(inside, by_time if name is None else F.lit(name)).otherwise(expr)
        return df.withColumn(out, F.coalesce(expr, F.lit(DEFAULT if DEFAULT in parts else None)))

    def touched(self, parts: dict[str, dict], lo=None, hi=None, equals=None, isin=None) -> list[str]:
        lo, hi = (parse(x) if x is not None else None for x in (lo, hi))

        def overlaps(p: dict) -> bool:
            if "lo" not in p:  # the default, or an unknown bound: always read
                return True
            return (hi is None or parse(p["lo"]) < hi) and (lo is None or parse(p["hi"]) > lo)

        return [n for n, p in parts.items() if overlaps(p)]

    def range_column(self) -> str | None:
        return self.column

    def tenant_column(self) -> str | None:
        return None

    def initial(self) -> dict[str, dict]:
        return {}


def check_moduli(parts: Iterable[tuple[int, int]]) -> None:
    """Hash partitions as (modulus, remainder): each modulus must divide the next
    larger one, and no two may share a row."""
    parts = list(parts)
    sizes = sorted({m for m, _ in parts})
    for a, b in zip(sizes, sizes[1:], strict=False):
        if b % a:
            raise PartitionError(f"modulus {a} is no factor of {b}")
    for i, (m, r) in enumerate(parts):
        if not 0 <= r < m:
            raise PartitionError(f"remainder {r} is outside modulus {m}")
        for m2, r2 in parts[:i]:
            if r % min(m, m2) == r2 % min(m, m2):
                raise PartitionError(f"({m}, {r}) overlaps ({m2}, {r2})")


@dataclass(frozen=True)
class HashSpec:
    """Remainder of the tenant key."""

    column: str = "tenant_id"
    modulus: int = 8
    kind: str = "hash"

    def initial(self) -> dict[str, dict]:
        check_moduli((self.modulus, r) for r in range(self.modulus))
        return {f"h{r}": {"remainder": r} for r in range(self.modulus)}

    def route(self, df: DataFrame, parts: dict[str, dict], out: str) -> DataFrame:
        keyed = with_key(df, self.column, "__key")
        return keyed.withColumn(out, F.concat(F.lit("h"), umod(F.col("__key"), self.modulus).cast("string"))).drop("__key")

    def name_of(self, tenant: int) -> str:
        return f"h{key_of(tenant) % self.modulus}"

    def touched(self, parts: dict[str, dict], lo=None, hi=None, equals=None, isin=None) -> list[str]:
        wanted = [equals] if equals is not None else isin
        if wanted is None:  # a range of ids says nothing about their hashes
            return list(parts)
        names = {self.name_of(t) for t in wanted}
        return [n for n in parts if n in names]

    def range_column(self) -> str | None:
        return None

    def tenant_column(self) -> str | None:
        return self.column


@dataclass(frozen=True)
class ListSpec:
    """Some tenants on partitions of their own, the rest by hash."""

    column: str = "tenant_id"
    values: tuple[int, ...] = ()
    modulus: int = 4
    kind: str = "list"

    def initial(self) -> dict[str, dict]:
        return {f"v{v}": {"value": v} for v in self.values} | {f"r{r}": {"remainder": r} for r in range(self.modulus)}

    def route(self, df: DataFrame, parts: dict[str, dict], out: str) -> DataFrame:
        own = [p["value"] for p in parts.values() if "value" in p]
        keyed = with_key(df, self.column, "__key")
        rest = F.concat(F.lit("r"), umod(F.col("__key"), self.modulus).cast("string"))
        named = F.when(F.col(self.column).isin(own), F.concat(F.lit("v"), F.col(self.column).cast("string"))).otherwise(rest) if own else rest
        return keyed.withColumn(out, named).drop("__key")

    def touched(self, parts: dict[str, dict], lo=None, hi=None, equals=None, isin=None) -> list[str]:
        wanted = [equals] if equals is not None else isin
        if wanted is None:
            return list(parts)
        names = {f"v{t}" if f"v{t}" in parts else f"r{key_of(t) % self.modulus}" for t in wanted}
        return [n for n in parts if n in names]

    def range_column(self) -> str | None:
        return None

    def tenant_column(self) -> str | None:
        return self.column


@dataclass(frozen=True)
class Whole:
    """No partitioning: one part."""

    kind: str = "whole"

    def initial(self) -> dict[str, dict]:
        return {"all": {}}

    def route(self, df: DataFrame, parts: dict[str, dict], out: str) -> DataFrame:
        return df.withColumn(out, F.lit("all"))

    def touched(self, parts: dict[str, dict], lo=None, hi=None, equals=None, isin=None) -> list[str]:
        return list(parts)

    def range_column(self) -> str | None:
        return None

    def tenant_column(self) -> str | None:
        return None


Spec = RangeSpec | HashSpec | ListSpec | Whole


def spec_to_json(spec: Spec) -> dict:
    return asdict(spec)


def spec_from_json(doc: dict) -> Spec:
    kinds = {"range": RangeSpec, "hash": HashSpec, "list": ListSpec, "whole": Whole}
    made = {k: tuple(v) if isinstance(v, list) else v for k, v in doc.items() if k != "kind"}
    return kinds[doc["kind"]](**made)


def check_unique(spec: Spec, unique: Iterable[str] | None) -> None:
    """A unique key can only be checked within partitions, so it has to hold their key."""
    control = spec.range_column() or spec.tenant_column()
    if unique is not None and control is not None and control not in set(unique):
        raise PartitionError(f"a unique key must include the partition column {control}")


def check_free(parts: dict[str, dict], lo: datetime, hi: datetime) -> None:
    if not lo < hi:
        raise PartitionError("a range must not be empty")
    for n, p in parts.items():
        if "lo" in p and parse(p["lo"]) < hi and lo < parse(p["hi"]):
            raise PartitionError(f"the range overlaps {n}")


def month_plan(as_of: datetime, back: int, ahead: int, unit: str = "month") -> list[tuple[str, datetime, datetime]]:
    """Names and bounds from ``back`` units before that of ``as_of`` to ``ahead`` after it."""
    now = floor_to(unit, as_of)
    starts = [step(unit, now, i) for i in range(-back, ahead + 1)]
    return [(range_name(unit, s), s, step(unit, s, 1)) for s in starts]


def outside(control: Column, lo: datetime, hi: datetime) -> Column:
    """Rows that a range partition must not hold, nulls among them."""
    c = control.cast("timestamp_ntz")
    return c.isNull() | (c < F.lit(lo.isoformat(" ")).cast("timestamp_ntz")) | (c >= F.lit(hi.isoformat(" ")).cast("timestamp_ntz"))
