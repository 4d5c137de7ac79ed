"""Shared pieces: folders both sides can see, Arrow text blocks, word hashing.

Text columns reach Python as Arrow buffers, and most operators never build a
Python string: they look at one ``uint8`` array per block of documents.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: bytes that are hashed at once
SLICE = 1 << 20


#: bytes of an Arrow batch, at most, in either direction
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session has Spark's default (64 MB): ten
    thousand long texts would be held four times, on either side of the pipe."""
    if spark.conf.get(_BATCH_CONF).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset (a local session) a folder of the warehouse serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that were running,
    not the stages before.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_salted(rows: DataFrame, right: DataFrame, key: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``right``, which has one row for each ``key``.

    One key may hold a third of all rows: its rows are dealt to as many tasks as
    there are shuffle partitions by a hash of ``spread_by``.  What ``right`` says
    of a key goes to each of these first, through the distinct pairs.
    """
    salt = "_salt"
    while salt in rows.columns or salt in right.columns:
        salt += "_"
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*spread_by), F.lit(n)).cast("int"))
    met = left.select(*key, salt).distinct().join(right, key)
    return left.join(met, [*key, salt], how).drop(salt)


#: rows of a staged table that are sent to all executors, at most, where a row has some 100 bytes
FEW = 1 << 17


def join_staged(rows: DataFrame, right: DataFrame, key: list[str], spread_by: list[str], how: str = "inner", few: int = FEW) -> DataFrame:
    """:func:`join_salted` with a staged ``right``, which is counted first: one of at
    most ``few`` rows is broadcast instead, and nothing is shuffled."""
    if right.count() <= few:
        return rows.join(F.broadcast(right), key, how)
    return join_salted(rows, right, key, spread_by, how)


def fold(remainder_of: str, mod: int) -> F.Column:
    """crc32 of an id as text, modulo ``mod``."""
    return F.crc32(F.col(remainder_of).cast("string")) % mod


#: what this worker holds between tasks, by name: the stage that last used it, and the thing
_held: dict[str, tuple[int, Any]] = {}


def _stage() -> int:
    task = TaskContext.get()
    return task.stageId() if task else -1


def hold(name: str, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once for all tasks of a stage in this worker.

    Workers outlive stages: the first block of another stage lets it go.
    """
    _held[name] = (_stage(), _held[name][1] if name in _held else make())
    return _held[name][1]


def let_go() -> None:
    """Give the memory of what other stages held in this worker back to the system."""
    stage = _stage()
    others = [name for name, (of, _) in _held.items() if of != stage]
    if others:
        for name in others:
            del _held[name]
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)


@dataclass
class Block:
    """Some documents of a batch: bytes of all texts end to end, offsets, all columns."""

    data: np.ndarray
    offsets: np.ndarray  # one more than documents, into data
    batch: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of about ``size`` bytes; one longer text is one block,
    and takes up to some 40 bytes of memory a byte where words are sorted."""
    let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(text)
        col = col.cast(pa.large_string()) if col.type != pa.large_string() else col
        if col.null_count:
            col = col.fill_null("")
        raw = col.buffers()
        off = np.frombuffer(raw[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
        i, n = 0, len(col)
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            j = min(j, n)
            yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], batch.slice(i, j - i))
            i = j


def steady(items: Iterator) -> Iterator:
    """The items, with the search for reference cycles off while they are worked on:
    over memories of many small objects it takes a sixth of the time and finds none."""
    gc.disable()
    try:
        yield from items
    finally:
        gc.enable()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values in UTF-8; null is empty."""
    return batch.column(name).cast(pa.large_binary()).fill_null(b"").to_pylist()


# ---------------------------------------------------------------- word hashing

_MUL = 0x9E3779B97F4A7C15  # 2**64 / golden ratio, odd
_INV = pow(_MUL, -1, 1 << 64)
_LUT = np.random.Generator(np.random.PCG64(20240131)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_pow: dict[str, np.ndarray] = {}

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: white space as the contracts have it: blank and 0x09 to 0x0D
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(kind: str) -> np.ndarray:
    """Powers 0 to ``SLICE`` of the multiplier, or of its inverse."""
    if kind not in _pow:
        x = np.full(SLICE + 1, _MUL if kind == "up" else _INV, np.uint64)
        x[0] = 1
        _pow[kind] = np.multiply.accumulate(x)
    return _pow[kind]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, in slices of the text: memory for one slice is all it takes."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = start[i]
        j = int(np.searchsorted(end, a + SLICE, "right"))
        if j <= i:  # a word longer than a slice
            total, scale = 0, 1
            for at in range(a, end[i], SLICE):
                some = data[at : min(at + SLICE, end[i])]
                total += int((_LUT[some] * _powers("up")[: len(some)]).sum(dtype=np.uint64)) * scale
                scale = scale * int(_powers("up")[SLICE]) % (1 << 64)
            out[i] = total % (1 << 64)
            i += 1
            continue
        z = end[j - 1]
        total = np.zeros(z - a + 1, np.uint64)
        np.cumsum(_LUT[data[a:z]] * _powers("up")[: z - a], out=total[1:])
        out[i:j] = (total[end[i:j] - a] - total[start[i:j] - a]) * _powers("down")[start[i:j] - a]
        i = j
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that each bit depends on all."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class Words:
    """Words of a block in order: byte range, document index, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(block) + 1: where each document's words begin


def find_words(b: Block, lower: np.ndarray = ASCII_LOWER, is_space: np.ndarray = IS_SPACE, data: np.ndarray | None = None) -> Words:
    """Words are maximal runs of bytes that aren't white space; the hash is of
    the lower-cased bytes.  Documents never share a word."""
    data = b.data if data is None else data
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, np.uint64), np.zeros(len(b) + 1, np.int64))
    inside = ~is_space[data]
    begins = np.zeros(n + 1, bool)
    begins[b.offsets] = True
    s = inside.copy()
    s[1:] &= ~inside[:-1] | begins[1:n]
    e = inside
    e[:-1] &= s[1:] | is_space[data[1:]] | begins[1:n]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    h = _hashes(lower[data], start, end)
    first = np.searchsorted(start, b.offsets)
    doc = np.repeat(np.arange(len(b)), np.diff(first))
    return Words(start, end, doc, h, first)


def hash_word(word: bytes) -> int:
    """The same hash for one word, of bytes that are lower-cased already."""
    a = np.frombuffer(word, np.uint8)
    return int(_hashes(a, np.array([0]), np.array([len(a)]))[0])
