"""Tracking events: near-repeats, and the status of a shipment after a sequence of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of the canonical statuses.
RANKS = {"Processing": 0, "Picked Up": 1, "In Transit": 2, "Out for Delivery": 3, "Delivered": 4, "Exception": 4, "Returned": 4}


def rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in RANKS.items():
        out = F.when(status == name, n).otherwise(out)
    return out


def drop_consecutive(events: DataFrame) -> DataFrame:
    """Events, newest first, without those that repeat the one before in minute, status and location."""
    minute = F.coalesce(F.date_format("event_timestamp", "yyyy-MM-dd HH:mm"), F.lit(""))
    key = F.concat_ws("|", minute, F.trim(F.coalesce("status", F.lit(""))), F.trim(F.coalesce("location", F.lit(""))))
    newest = Window.partitionBy("ge_tracking_number").orderBy(F.desc("event_timestamp"), F.desc("id"))
    return events.withColumn("key", key).withColumn("before", F.lag("key").over(newest)).where("before is null or before <> key").drop("key", "before")


def fold(events: DataFrame, order: str = "id") -> DataFrame:
    """The state of each shipment after its events in order of arrival.

    tracking_status is the last one; status moves only to a rank that isn't less; delivered_at is when Delivered first
    came; changes counts the events that changed tracking_status, and last_status_change_at is when the last of them came.
    """
    arrival = Window.partitionBy("ge_tracking_number").orderBy(order)
    mapped = F.when(F.col("status") == "Information Received", F.lit("Processing")).otherwise(F.col("status"))
    ranked = events.withColumn("mapped", mapped).withColumn("rank", rank(F.col("mapped")))
    # An accepted rank is the largest so far: the status is that of the last event that reaches it.
    reached = F.greatest(F.max("rank").over(arrival.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    changed = ~F.col("status").eqNullSafe(F.lag("status").over(arrival)) | (F.row_number().over(arrival) == 1)
    marked = ranked.withColumn("accepted", F.col("rank") == reached).withColumn("changed", changed)
    return marked.groupBy("ge_tracking_number").agg(
        F.max_by("status", order).alias("tracking_status"),
        F.coalesce(F.max_by("mapped", F.when(F.col("accepted"), F.col(order))), F.lit("Processing")).alias("status"),
        F.min_by("event_timestamp", F.when(F.col("status") == "Delivered", F.col(order))).alias("delivered_at"),
        F.count_if("changed").alias("changes"),
        F.max_by("event_timestamp", F.when(F.col("changed") & F.col("status").isNotNull(), F.col(order))).alias("last_status_change_at"),
    )
