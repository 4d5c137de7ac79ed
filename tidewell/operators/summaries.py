"""Materialised daily totals: a table of its own, refreshed by the days that changed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.misc import day_of
from tidewell.operators import partitions as P
from tidewell.operators.store import Tx

DAILY = T.StructType(
    [
        T.StructField("tenant_id", T.LongType(), False),
        T.StructField("day", T.TimestampNTZType(), False),
        T.StructField("events", T.LongType(), False),
        T.StructField("amount_cents", T.LongType(), False),
    ]
)


def create_daily(tx: Tx, name: str = "daily") -> Tx:
    return tx.create(name, DAILY, P.RangeSpec("day", "month"), default=True)


def refresh_daily(tx: Tx, source: str, lo: datetime, hi: datetime, name: str = "daily") -> Tx:
    """Recompute the days in [lo, hi); the rest of the summary stays as it is."""
    rows = tx.scan(source, lo=lo, hi=hi)
    new = rows.groupBy("tenant_id", day_of(F.col("occurred_at")).alias("day")).agg(F.count("*").alias("events"), F.sum("amount_cents").alias("amount_cents"))
    tx.delete(name, (F.col("day") >= F.lit(str(lo)).cast("timestamp_ntz")) & (F.col("day") < F.lit(str(hi)).cast("timestamp_ntz")))
    return tx.insert(name, new)
