"""Time-ordered 64-bit ids: milliseconds, shard, sequence."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The layout of an id
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
EPOCH_MS = 1_704_067_200_000
SEQ_BITS, SHARD_BITS = 12, 10
MAX_SHARD, MAX_SEQ = (1 << SHARD_BITS) - 1, (1 << SEQ_BITS) - 1


@dataclass(frozen=True)
class IdParts:
    at: datetime
    shard: int
    seq: int


def encode_id(ms_since_epoch: int, shard: int, seq: int) -> int:
    return ms_since_epoch << (SHARD_BITS + SEQ_BITS) | shard << SEQ_BITS | seq


def decode_id(value: int) -> IdParts:
    return IdParts(EPOCH + timedelta(milliseconds=value >> (SHARD_BITS + SEQ_BITS)), value >> SEQ_BITS & MAX_SHARD, value & MAX_SEQ)


def encode_id_column(ms_since_epoch: Column, shard: Column, seq: Column) -> Column:
    return F.shiftleft(ms_since_epoch.cast("long"), SHARD_BITS + SEQ_BITS).bitwiseOR(F.shiftleft(shard.cast("long"), SEQ_BITS)).bitwiseOR(seq.cast("long"))


def decode_id_columns(value: Column) -> dict[str, Column]:
    """id_ms (since the Unix epoch), id_shard and id_seq."""
    return {
        "id_ms": F.shiftright(value, SHARD_BITS + SEQ_BITS) + F.lit(EPOCH_MS),
        "id_shard": F.shiftright(value, SEQ_BITS).bitwiseAND(F.lit(MAX_SHARD).cast("long")).cast("int"),
        "id_seq": value.bitwiseAND(F.lit(MAX_SEQ).cast("long")).cast("int"),
    }


class IdGenerator:
    """Strictly increasing ids of one shard, safe across threads.

    A clock that stands still or goes back never repeats or overflows: when a
    millisecond's sequence is used up, the generator moves to the next one.
    """

    def __init__(self, shard: int, now_ms: Callable[[], int] | None = None):
        if not 0 <= shard <= MAX_SHARD:
            raise ValueError(f"shard {shard} is outside 0..{MAX_SHARD}")
        self.shard = shard
        self._now = now_ms or (lambda: time.time_ns() // 1_000_000)
        self._ms, self._seq = -1, 0
        self._lock = threading.Lock()

    def next(self) -> int:
        with self._lock:
            now = self._now() - EPOCH_MS
            if now > self._ms:
                self._ms, self._seq = now, 0
            elif self._seq < MAX_SEQ:
                self._seq += 1
            else:
                self._ms, self._seq = self._ms + 1, 0
            return encode_id(self._ms, self.shard, self._seq)


def with_ids(df: DataFrame, shard: str, start_ms: int, order: list[Column], out: str = "id") -> DataFrame:
    """Ids for all rows of a table: by shard in the given order, 4096 a millisecond.

    Rows are numbered by partition first and partitions are offset afterwards,
    so no shard has to fit in one task.
    """
    spread = df.repartitionByRange(F.col(shard), *order).sortWithinPartitions(F.col(shard), *order).withColumn("__p", F.spark_partition_id()).persist()
    inner = spread.withColumn("__n", F.row_number().over(Window.partitionBy("__p", shard).orderBy(*order)) - 1)
    sizes = spread.groupBy(F.col("__p").alias("__q"), F.col(shard).alias("__s")).agg(F.count("*").alias("__c"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(Window.partitionBy("__s").orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.col("__n") + F.col("__before")
    joined = inner.join(before, (F.col("__p") == F.col("__q")) & (F.col(shard) == F.col("__s")))
    made = encode_id_column(F.lit(start_ms - EPOCH_MS) + F.shiftright(n, SEQ_BITS), F.col(shard), n.bitwiseAND(F.lit(MAX_SEQ).cast("long")))
    return joined.withColumn(out, made).select(*df.columns, out)
