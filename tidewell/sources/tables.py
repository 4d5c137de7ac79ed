"""The engine's tables over the star-schema inputs, and synthetic data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.misc import cents

#: the moments up to which the inputs run
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"

EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("tenant_id", T.LongType(), False),
        T.StructField("occurred_at", T.TimestampNTZType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("amount_cents", T.LongType(), False),
        T.StructField("payload", T.StringType(), False),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("tenant_id", T.LongType(), False),
        T.StructField("placed_at", T.TimestampNTZType(), False),
        T.StructField("total_cents", T.LongType(), False),
        T.StructField("state", T.StringType(), False),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide table of tenant events; 8 % of the rows are open."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("tenant_id"),
        F.col("ts").alias("occurred_at"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 25 < 2, "new").otherwise("done").alias("status"),
        cents(F.col("value")).alias("amount_cents"),
        F.col("props").alias("payload"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("tenant_id"),
        F.col("o_orderdate").alias("placed_at"),
        cents(F.col("o_totalprice")).alias("total_cents"),
        F.col("o_orderstatus").alias("state"),
    )


def skewed_events(spark: SparkSession, sf_dir: str, tenants: int = 500) -> DataFrame:
    """Events whose tenants follow a cubic skew in whole numbers, the same in every engine."""
    u = "((id * 7919) % 1000)"
    return events(spark, sf_dir).withColumn("tenant_id", F.expr(f"1 + ({u} * {u} * {u} * {tenants}) div 1000000000"))


def ledger(accounts: DataFrame, opening_cents: int = 1_000_000) -> DataFrame:
    """One balance a tenant."""
    return accounts.select("tenant_id").distinct().withColumn("balance_cents", F.lit(opening_cents).cast("long"))


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    """Whole numbers from first to last, both included."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def synthetic_events(spark: SparkSession, rows: int, tenants: int = 500, days: int = 365, as_of: str = EVENTS_AS_OF, seed: int = 42, power: int = 3) -> DataFrame:
    """Random events: power-skewed tenants, uniform times, 92 % done."""
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "email")))
    n = series(spark, 1, rows, "id")
    back = (F.rand(seed + 1) * days * 86_400).cast("long")
    return n.select(
        "id",
        (1 + F.floor(F.pow(F.rand(seed), power) * tenants)).cast("long").alias("tenant_id"),
        (F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), back.cast("decimal(18,6)"))).alias("occurred_at"),
        F.element_at(kinds, (1 + F.floor(F.rand(seed + 2) * 5)).cast("int")).alias("kind"),
        F.when(F.rand(seed + 3) < 0.92, "done").otherwise("new").alias("status"),
        F.floor(F.rand(seed + 4) * 50_001).cast("long").alias("amount_cents"),
        F.to_json(F.struct(F.lit("seed").alias("src"), F.col("id").alias("n"))).alias("payload"),
    )


def synthetic_orders(spark: SparkSession, tenants: int, per_tenant: int, whales: int = 2, factor: int = 20, days: int = 90, as_of: str = ORDERS_AS_OF, seed: int = 42) -> DataFrame:
    """Orders by tenant; the first tenants have ``factor`` times as many."""
    states = F.array(*map(F.lit, ("new", "paid", "shipped", "refunded")))
    t = series(spark, 1, tenants, "tenant_id")
    many = F.when(F.col("tenant_id") <= whales, per_tenant * factor).otherwise(per_tenant)
    one = t.select("tenant_id", F.explode(F.sequence(F.lit(1), many)).alias("k"))
    back = (F.rand(seed) * days * 86_400).cast("long")
    return one.select(
        "tenant_id",
        "k",
        (F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), back.cast("decimal(18,6)"))).alias("placed_at"),
        F.floor(F.rand(seed + 1) * 20_001).cast("long").alias("total_cents"),
        F.element_at(states, (1 + F.floor(F.rand(seed + 2) * 4)).cast("int")).alias("state"),
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in declared order and type; a null in a declared non-null column raises."""
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            c = F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null in {f.name}"))).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def open_rows(e: DataFrame) -> DataFrame:
    """The queue: rows that aren't done."""
    return e.where(F.col("status") != "done")


def publication(df: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """What a subscriber gets: some columns of some rows."""
    return df.where(where).select(*columns)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and an order-free checksum of whole-number columns, for comparing copies."""
    total = sum((F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(0)) * (k + 1) for k, c in enumerate(columns)), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(total % 1_000_000_007), F.lit(0)).cast("long").alias("checksum"))


def violations(df: DataFrame, unique: list[str] | None = None, checks: dict[str, str] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows that break declared constraints, counted by constraint: a unique key,
    SQL conditions (null passes), columns that must occur in another table."""
    spark = df.sparkSession
    out = [spark.createDataFrame([], "constraint string, rows long")]
    for name, condition in (checks or {}).items():
        out.append(df.where(~F.expr(condition)).agg(F.count("*").alias("rows")).select(F.lit(name).alias("constraint"), "rows"))
    if unique:
        twice = df.groupBy(*unique).agg(F.count("*").alias("n")).where("n > 1")
        out.append(twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit("unique").alias("constraint"), "rows"))
    for column, (other, key) in (references or {}).items():
        lost = df.where(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")
        out.append(lost.agg(F.count("*").alias("rows")).select(F.lit(f"references {column}").alias("constraint"), "rows"))
    return reduce(DataFrame.unionByName, out)
