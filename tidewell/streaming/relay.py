"""The relay as a stream: messages arrive as files, credits are applied once.

A batch may be delivered twice, and a message may come again in a later batch;
``applied`` is committed with the credits, so neither changes a balance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.cluster import OUTBOX, Cluster
from tidewell.operators.transfer import apply_credits


def start_relay(cluster: Cluster, inbox: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Apply messages that are put as Parquet files of the outbox's schema in ``inbox``."""
    messages = cluster.spark.readStream.schema(OUTBOX).parquet(inbox)
    parsed = messages.select("id", F.get_json_object("payload", "$.tenant_id").cast("long").alias("tenant_id"), F.get_json_object("payload", "$.cents").cast("long").alias("cents"))

    def deliver(batch: DataFrame, _: int) -> None:
        routed = cluster.topology.with_shard(batch).persist()
        try:
            for r in routed.select("shard").distinct().collect():  # a row a shard
                apply_credits(cluster, r["shard"], routed.where(F.col("shard") == r["shard"]).drop("shard"))
        finally:
            routed.unpersist()

    writer = parsed.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def daily_totals(events: DataFrame, ts: str = "occurred_at", late: str = "1 day") -> DataFrame:
    """Count and amount by day of a stream (or table) of events, rows in time windows."""
    marked = events.withColumn("__t", F.col(ts).cast("timestamp"))
    marked = marked.withWatermark("__t", late) if events.isStreaming else marked
    days = marked.groupBy(F.window("__t", "1 day").alias("w")).agg(F.count("*").alias("events"), F.sum("amount_cents").alias("amount_cents"))
    return days.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "events", "amount_cents")
