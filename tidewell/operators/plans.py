"""What plans and statements cost: partitions touched, shuffles, pushed bounds, times."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.joins import exchanges
from tidewell.operators.store import Tx


def plan_text(df: DataFrame) -> str:
    """The physical plan with the details of each operator."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed_filters(df: DataFrame) -> list[str]:
    """The predicates that reach the scans."""
    out = []
    for line in plan_text(df).splitlines():
        name, _, rest = line.partition(": ")
        if name.strip() == "PushedFilters" and rest.strip("[] "):
            out += rest.strip("[] ").split(", ")
    return out


def touched_report(spark: SparkSession, question: str, tx: Tx, table: str, **where) -> DataFrame:
    """For a question to a stored table: partitions read, of how many; shuffles; whether
    a bound reaches the files."""
    df = tx.scan(table, **where)
    pushed = any(x.startswith(("GreaterThan", "LessThan", "EqualTo", "In(")) for x in pushed_filters(df))
    row = (question, len(tx.touched(table, **where)), len(tx.touched(table)), exchanges(df), pushed)
    return spark.createDataFrame([row], "question string, partitions_read int, partitions int, exchanges int, pushed boolean")


class Statements:
    """A log of statements: how often each ran, its rows and its seconds."""

    def __init__(self, spark: SparkSession):
        self.spark, self.log = spark, []

    def run(self, statement: str, df: DataFrame) -> int:
        """Run a statement in full; its number of rows."""
        began = time.perf_counter()
        rows = df.count()
        self.log.append((statement, rows, time.perf_counter() - began))
        return rows

    def top(self, n: int) -> DataFrame:
        """The statements that took the most time in sum."""
        log = self.spark.createDataFrame(self.log, "statement string, rows long, seconds double")
        sums = log.groupBy("statement").agg(F.count("*").alias("calls"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("mean_seconds"))
        return sums.orderBy(F.desc("seconds"), "statement").limit(n)
