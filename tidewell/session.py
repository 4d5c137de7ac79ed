"""Session defaults: one place that decides how Spark is configured."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # plain filters on a bucketed key keep their bucket pruning
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword settings (dots as ``__``) win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
