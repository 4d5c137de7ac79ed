"""Joins by how their sides lie: on one distribution key, with a small reference
table, or with a shuffle that has to be allowed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_BYTES = 64 << 20


class RepartitionError(ValueError):
    """A join would move rows, and that wasn't allowed."""


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A saved table in buckets of its key, sorted within; equal bucketings join in place."""
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan that would run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan))


def colocated_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", allow_repartition: bool = False) -> DataFrame:
    """An equi-join that refuses to shuffle unless told that it may."""
    joined = left.hint("merge").join(right, key, how)
    if not allow_repartition and exchanges(joined):
        raise RepartitionError(f"joining on {key} moves rows: the sides aren't bucketed alike")
    return joined


def plan_bytes(df: DataFrame) -> int:
    """What the optimiser takes a plan's size to be."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def reference_join(facts: DataFrame, reference: DataFrame, on: str, how: str = "inner", most: int = REFERENCE_BYTES) -> DataFrame:
    """Broadcast the reference side if it is known to be small, else let Spark choose."""
    return facts.join(F.broadcast(reference) if plan_bytes(reference) <= most else reference, on, how)


def selected_buckets(df: DataFrame) -> tuple[int, int] | None:
    """(read, all) buckets of a scan, where the plan says."""
    m = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", df._jdf.queryExecution().executedPlan().toString())
    return (int(m[1]), int(m[2])) if m else None


def analyze(spark: SparkSession, table: str) -> None:
    """Collect statistics of a saved table and its columns."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
