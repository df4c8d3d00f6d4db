"""Users and settings: access to rows, locked accounts, configurations; logs that are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Failures in a row that lock an account, and for how many minutes.
MOST_FAILURES, LOCKED_MINUTES = 5, 15


def accessible(shipments: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, id of each shipment that a user may see who isn't an admin: own ones, and those that an admin made.

    Rows that admins made are the same for all, so they come once with a null user_id ("everybody").
    """
    makers = users.select(F.col("id").alias("created_by"), "role")
    made = shipments.select("id", "created_by").join(makers, "created_by", "left")
    by_admin = F.coalesce(F.col("role") == "admin", F.lit(False))
    return made.where(by_admin | F.col("created_by").isNotNull()).select(F.when(~by_admin, F.col("created_by")).alias("user_id"), "id")


def locked(logins: DataFrame, most: int = MOST_FAILURES, minutes: int = LOCKED_MINUTES) -> DataFrame:
    """username, attempts, status and locked_until after logins(username, id, at, ok) in the order of id.

    A success sets attempts to 0. The failure that makes them most locks the account; what comes after changes nothing.
    """
    order = Window.partitionBy("username").orderBy("id")
    runs = logins.withColumn("run", F.sum(F.col("ok").cast("int")).over(order))
    failed = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("username", "run").orderBy("id"))
    counted = runs.withColumn("failed", failed)
    lock = F.min(F.when(F.col("failed") >= most, F.struct("id", "at")))
    state = counted.groupBy("username").agg(lock.alias("lock"), F.max_by("failed", "id").alias("last"))
    until = F.col("lock.at") + F.make_interval(mins=F.lit(minutes))
    return state.select("username", F.when(F.col("lock").isNotNull(), most).otherwise(F.col("last")).cast("long").alias("attempts"), F.when(F.col("lock").isNotNull(), "Locked").otherwise("Active").alias("status"), until.alias("locked_until"))


def with_configs(carriers: DataFrame, configs: DataFrame) -> DataFrame:
    """carriers with configs, a map of their configs(carrier_id, config_key, config_value); the last of equal keys by id."""
    last = configs.groupBy("carrier_id", "config_key").agg(F.max_by("config_value", "id").alias("value"))
    maps = last.groupBy(F.col("carrier_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("config_key", "value"))).alias("configs"))
    return carriers.join(maps, "id", "left")


def setting(rows: DataFrame, settings: DataFrame, key: str, default: str, name: str) -> DataFrame:
    """rows with the setting of the key as a column, or the default: one row is joined, whatever its source."""
    held = settings.where(F.col("key") == key).agg(F.coalesce(F.nullif(F.max("value"), F.lit("")), F.lit(default)).alias(name))
    return rows.join(F.broadcast(held))


def public(shipments: DataFrame, shown_as: str, hidden: tuple[str, ...] = ("carrier", "carrier_tracking_number", "awb_number", "ocr_raw_text")) -> DataFrame:
    """What the public may see: neither the carrier nor its numbers, but a name that is always the same."""
    return shipments.drop(*hidden).withColumn("carrier_display", F.lit(shown_as))


def api_failures(calls: DataFrame) -> DataFrame:
    """The audit rows of api calls(provider, endpoint, success, error) that failed."""
    details = F.trim(F.concat(F.coalesce("endpoint", F.lit("")), F.lit(" "), F.coalesce("error", F.lit(""))))
    return calls.where("success = 0").select(F.lit("system").alias("username"), F.lit("API_FAILURE").alias("action"), F.col("provider").alias("entity"), F.lit("failure").alias("status"), details.alias("details"))


def audit_row(action: str, old: Column, new: Column, **more: Column) -> list[Column]:
    """The columns of an audit row with old and new values as JSON; the status is success unless given."""
    json = lambda x: F.when(x.isNotNull(), F.to_json(x))
    status = F.coalesce(F.nullif(more.pop("status", F.lit(None).cast("string")), F.lit("")), F.lit("success"))
    return [F.lit(action).alias("action"), *(c.alias(n) for n, c in more.items()), json(old).alias("old_value"), json(new).alias("new_value"), status.alias("status")]
