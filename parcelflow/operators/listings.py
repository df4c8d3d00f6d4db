"""Listings: filters made of request parameters, search, role scope, paging, lookups and joins."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns that a page can be sorted by, and those that a search looks into.
SORTABLE = ("created_at", "ship_date", "booking_date", "ge_tracking_number", "to_name", "status", "tracking_status")
SEARCHED = (
    "ge_tracking_number", "carrier_tracking_number", "awb_number", "from_name", "to_name", "from_contact", "to_contact", "contents",
    "invoice_number", "reference_number", "sender_company", "receiver_company", "route_code",
)


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def search(df: DataFrame, text: str, columns: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows of which any column holds the text, letter case aside; % and _ in it are wildcards."""
    return df.where(reduce(or_, (F.col(c).ilike(f"%{text}%") for c in columns)))


#: Values of a list that stand in the query itself; more are joined.
LISTED = 1000


def in_list(df: DataFrame, column: str, wanted: list | DataFrame, listed: int = LISTED) -> DataFrame:
    """Rows whose column is among the wanted values: a list, or a table of one column.

    A short list is a literal IN, which reaches the scan as a filter. A longer one, or a table of any size, is a semi
    join, which Spark broadcasts only where the values are known to be few. Nulls are among nothing.
    """
    if not isinstance(wanted, DataFrame):
        if len(wanted) <= listed:
            return df.where(F.col(column).isin(wanted))
        wanted = df.sparkSession.createDataFrame([(v,) for v in wanted], f"`{column}` {df.schema[column].dataType.simpleString()}")
    keys = wanted.select(F.col(f"`{wanted.columns[0]}`").alias(column)).where(F.col(f"`{column}`").isNotNull())
    return df.join(keys, column, "left_semi").select(*(df[f"`{c}`"] for c in df.columns))


def filtered(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality on the columns that are asked for; date_from and date_to compare ship_date as text."""
    tests = {"date_from": lambda v: F.col("ship_date") >= v, "date_to": lambda v: F.col("ship_date") <= v}
    return df.where(all_of([tests.get(k, lambda v, k=k: F.col(k) == v)(v) for k, v in wanted.items() if v not in (None, "")]))


def visible(shipments: DataFrame, users: DataFrame, me: int) -> DataFrame:
    """Own rows, and rows that an admin made: a left join on the (small) key, so that no OR stands in a join."""
    admins = users.where("role = 'admin'").select(F.col("id").alias("created_by"), F.lit(True).alias("by_admin"))
    return shipments.join(admins, "created_by", "left").where((F.col("created_by") == me) | F.col("by_admin")).drop("by_admin")


def page(df: DataFrame, sort: str | None, order: str | None, number: int, size: int, key: str = "id") -> DataFrame:
    """A page by a listed column (else created_at); ascending only if order is 'asc'; ties by key."""
    column = F.col(sort if sort in SORTABLE else "created_at")
    by = column.asc_nulls_first() if order == "asc" else column.desc_nulls_last()
    return df.orderBy(by, key).offset((number - 1) * size).limit(size)


def newest_per_key(df: DataFrame, key: str, at: str, k: int, tie: str = "id") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie)))
    return df.withColumn("place", place).where(F.col("place") <= k)


def numbers(shipments: DataFrame) -> DataFrame:
    """number, id: a row for each distinct number that a shipment is known by."""
    return shipments.select(F.explode(F.array_distinct(F.array("carrier_tracking_number", "awb_number"))).alias("number"), "id").where("number is not null")


def known(rows: DataFrame, shipments: DataFrame, key: str) -> DataFrame:
    """rows whose key is a tracking or waybill number: an equi semi join on unfolded numbers."""
    return rows.join(numbers(shipments).select(F.col("number").alias(key)), key, "left_semi")


def latest_match(rows: DataFrame, shipments: DataFrame, key: str) -> DataFrame:
    """rows with shipment_id, the largest id known by the key; null without one."""
    newest = numbers(shipments).groupBy(F.col("number").alias(key)).agg(F.max("id").alias("shipment_id"))
    return rows.join(newest, key, "left")


def role_permissions(pairs: DataFrame, roles: DataFrame, permissions: DataFrame) -> DataFrame:
    joined = pairs.join(roles, pairs.role_id == roles.rid).join(permissions, pairs.permission_id == permissions.pid)
    return joined.groupBy("role").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def with_events(shipments: DataFrame, events: DataFrame, k: int = 50) -> DataFrame:
    """Each shipment with its newest k events, newest first."""
    newest = newest_per_key(events, "ge_tracking_number", "event_timestamp", k)
    nested = newest.groupBy("ge_tracking_number").agg(F.sort_array(F.collect_list(F.struct("place", "id", "status"))).alias("events"))
    return shipments.join(nested, "ge_tracking_number", "left")
