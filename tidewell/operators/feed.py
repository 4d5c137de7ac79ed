"""Keyset pages over a feed ordered by time and id, newest first."""

from __future__ import annotations

import base64
import binascii
import re
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1)
_TEXT = re.compile(r"(-?[0-9]+):(-?[0-9]+)")


@dataclass(frozen=True)
class Cursor:
    """The position behind a row.  ``None`` stands for the first page."""

    at: datetime
    id: int

    def micros(self) -> int:
        # whole-number arithmetic: exact for any year, before 1970 too
        return (self.at - _EPOCH) // timedelta(microseconds=1)

    def encode(self) -> str:
        return base64.urlsafe_b64encode(f"{self.micros()}:{self.id}".encode()).decode().rstrip("=")


def decode_cursor(text: str) -> Cursor | None:
    """The cursor of a token; ``None`` for an empty one; ``ValueError`` for garbage."""
    if not text:
        return None
    if not re.fullmatch(r"[A-Za-z0-9_-]+", text) or len(text) % 4 == 1:
        raise ValueError("a cursor is base64url without padding")
    try:
        plain = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode("ascii")
    except (binascii.Error, UnicodeDecodeError) as e:
        raise ValueError("a cursor is base64url without padding") from e
    m = _TEXT.fullmatch(plain)
    if not m:
        raise ValueError("a cursor holds a time and an id")
    micros, id_ = int(m[1]), int(m[2])
    if not all(-(1 << 63) <= x < 1 << 63 for x in (micros, id_)):
        raise ValueError("a cursor's numbers have 64 bits")
    try:
        return Cursor(_EPOCH + timedelta(microseconds=micros), id_)
    except OverflowError as e:
        raise ValueError("a cursor's time is out of range") from e


def after(cursor: Cursor | None, ts: str = "created_at", id_: str = "id") -> Column:
    """Rows behind a cursor: ``(ts, id) < (t, i)``, spelt so that the bound on the
    time reaches the Parquet scan (a comparison of structs doesn't)."""
    if cursor is None:
        return F.lit(True)
    t = F.lit(cursor.at.isoformat(" ")).cast("timestamp_ntz")
    return (F.col(ts) <= t) & ((F.col(ts) < t) | (F.col(id_) < cursor.id))


def newest_first(ts: str = "created_at", id_: str = "id") -> list[Column]:
    return [F.desc(ts), F.desc(id_)]


def page(df: DataFrame, cursor: Cursor | None, limit: int, ts: str = "created_at", id_: str = "id") -> DataFrame:
    """One page as a plan: each partition keeps its first rows, then they are merged."""
    return df.where(after(cursor, ts, id_)).orderBy(*newest_first(ts, id_)).limit(max(0, limit))


def page_recent(df: DataFrame, cursor: Cursor | None, limit: int, ts: str = "created_at", id_: str = "id") -> tuple[list, Cursor | None]:
    """A page's rows and the next cursor; an empty page keeps the old one."""
    rows = page(df, cursor, limit, ts, id_).collect()  # at most ``limit`` rows
    return rows, Cursor(rows[-1][ts], rows[-1][id_]) if rows else cursor


def merge_desc(per_shard: list[DataFrame | None], limit: int, ts: str = "created_at", id_: str = "id") -> DataFrame | None:
    """The newest rows of several ordered inputs; absent ones don't matter."""
    some = [d for d in per_shard if d is not None]
    if not some:
        return None
    top = [d.orderBy(*newest_first(ts, id_)).limit(limit) for d in some]
    return reduce(DataFrame.unionByName, top).orderBy(*newest_first(ts, id_)).limit(limit)


def offset_page(df: DataFrame, skip: int, limit: int, ts: str = "created_at", id_: str = "id") -> DataFrame:
    """Paging by offset, for comparison: it sorts and drops all rows before."""
    return df.orderBy(*newest_first(ts, id_)).offset(skip).limit(limit)


def read_amplification(limit: int, shards: int, returned: int) -> float:
    """Rows fetched for each row returned."""
    return limit * shards / returned if returned else 0.0
