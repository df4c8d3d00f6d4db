"""Dashboard and operational aggregates: one scan each, whatever the number of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOVING = ("In Transit", "Picked Up", "Out for Delivery")


def asked(first: str, end: str, status: str | None = None, carrier: str | None = None) -> Column:
    """Whether a row was created in [first, end) and has the status and carrier, if any are asked for."""
    at = F.col("created_at")
    inside = (at >= F.lit(first).cast("timestamp_ntz")) & (at < F.lit(end).cast("timestamp_ntz"))
    for column, value in (("status", status), ("carrier", carrier)):
        if value:
            inside &= F.col(column) == value
    return inside


def of_day(day: str) -> Column:
    start = F.lit(day).cast("timestamp_ntz")
    return (F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY"))


def uploads_today(jobs: DataFrame, today: str) -> DataFrame:
    return jobs.where(of_day(today)).agg(F.count("*").alias("uploads_today"))


def word_confidence(words: DataFrame) -> DataFrame:
    """doc and the mean of its words' confidences that aren't negative, 0 without any."""
    mean = F.round(F.avg(F.when(F.col("confidence") >= 0, F.col("confidence"))), 1)
    return words.groupBy("doc").agg(F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def block_confidence(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc and the mean of its blocks' confidences in percent: 85 if none is given, 0 if the document isn't annotated."""
    means = blocks.groupBy("doc").agg(F.round(F.avg(F.col("confidence") * 100), 1).alias("mean"))
    return docs.join(means, "doc", "left").select("doc", F.when(F.col("annotated"), F.coalesce("mean", F.lit(85.0))).otherwise(0.0).alias("confidence"))


def kpis(shipments: DataFrame, first: str, end: str, today: str, status: str | None = None, carrier: str | None = None) -> DataFrame:
    """All dashboard counts in one pass; the range [first, end) and filters don't hold for ``today``."""
    inside = asked(first, end, status, carrier)
    counted = {
        "total": F.lit(True),
        "delivered": (F.col("status") == "Delivered") | (F.col("tracking_status") == "Delivered"),
        "in_transit": F.col("tracking_status").isin(*MOVING),
        "pending": F.col("status") == "Processing",
        "exception": F.col("tracking_status") == "Exception",
        "waybills": F.col("waybill_generated") == 1,
        "manual_queue": F.col("manual_tracking") == 1,
    }
    now = of_day(today)
    return shipments.agg(*(F.count_if(inside & c).alias(k) for k, c in counted.items()), F.count_if(now).alias("today"))


def top_groups(df: DataFrame, by: str, k: int, *, blank: bool = False) -> DataFrame:
    """The k largest groups of non-null (and, unless blank, non-empty) values; ties by value."""
    held = F.col(by).isNotNull() if blank else F.coalesce(F.col(by), F.lit("")) != ""
    return df.where(held).groupBy(by).agg(F.count("*").alias("count")).orderBy(F.desc("count"), by).limit(k)


def shares(df: DataFrame, by: str, k: int) -> DataFrame:
    """top_groups with the rounded percentage of all rows, nulls included."""
    groups = df.groupBy(by).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row for each group
    pct = F.round(100 * F.col("count").cast("double") / total).cast("long")
    return groups.withColumn("pct", pct).where(F.col(by).isNotNull()).orderBy(F.desc("count"), by).limit(k)


def daily(df: DataFrame, since: str) -> DataFrame:
    """Rows for each day from since on, and the day's share of the largest."""
    days = df.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("count"))
    return days.withColumn("scale", F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1)))


def user_activity(audit: DataFrame, since: str, k: int) -> DataFrame:
    recent = audit.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    grouped = recent.groupBy("username", "role").agg(F.count("*").alias("actions"), F.max("created_at").alias("last_at"))
    return grouped.orderBy(F.desc("actions"), "username", "role").limit(k)


def band(rate: Column) -> Column:
    return F.when(rate >= 90, "good").when(rate >= 50, "warn").otherwise("bad")


def api_health(logs: DataFrame, since: str) -> DataFrame:
    recent = logs.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    grouped = recent.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("success").alias("ok"), F.round(F.avg("response_ms"), 0).alias("avg_ms"))
    rate = F.round(F.lit(100.0) * F.col("ok") / F.col("calls"), 1)
    return grouped.withColumn("success_rate", rate).withColumn("band", band(rate))


def job_totals(records: DataFrame) -> DataFrame:
    invalid = F.count_if(F.col("validation_status") == "Invalid")
    return records.groupBy("job").agg(F.count("*").alias("total_records"), invalid.alias("failed_count"), (F.count("*") - invalid).alias("success_count"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
