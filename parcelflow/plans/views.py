"""The application's tables, derived from the driver's tables by the same expressions in Spark and in SQL.

Each view is a mapping of column names to expressions that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Clock values; no query reads the machine's clock.
ORDERS_NOW, EVENTS_NOW, RETENTION_NOW = "2001-08-02", "2024-01-31", "2001-12-01"

_NUMBER = "CASE WHEN o_orderkey % 17 = 0 AND o_orderkey > 0 THEN o_orderkey - 1 ELSE o_orderkey END"
_TRACKING = f"""CASE ({_NUMBER}) % 7
 WHEN 1 THEN lpad(CAST({_NUMBER} AS STRING), 10, '2') WHEN 2 THEN lpad(CAST({_NUMBER} AS STRING), 12, '8')
 WHEN 3 THEN '1Z' || lpad(CAST({_NUMBER} AS STRING), 16, '4') WHEN 4 THEN lpad(CAST({_NUMBER} AS STRING), 11, '3')
 WHEN 5 THEN 'D' || lpad(CAST({_NUMBER} AS STRING), 9, '1') WHEN 6 THEN lpad(CAST({_NUMBER} AS STRING), 13, '9')
 ELSE 'X-' || CAST({_NUMBER} AS STRING) END"""

SHIPMENTS = {
    "id": "o_orderkey",
    "ge_tracking_number": "'GE' || CAST(1000000 + o_orderkey AS STRING)",
    "carrier": "CASE o_orderkey % 7 WHEN 1 THEN 'DHL' WHEN 2 THEN 'FedEx' WHEN 3 THEN 'UPS' WHEN 4 THEN 'Aramex' WHEN 5 THEN 'DTDC' WHEN 6 THEN 'Delhivery' END",
    "carrier_tracking_number": f"CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE {_TRACKING} END",
    "awb_number": f"CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_TRACKING} END",
    "status": "CASE o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'In Transit' ELSE 'Processing' END",
    "tracking_status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Out for Delivery' WHEN '2-HIGH' THEN 'In Transit' WHEN '3-MEDIUM' THEN 'Picked Up' WHEN '5-LOW' THEN 'Exception' END",
    "created_by": "o_custkey % 10",
    "from_name": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE 'Sender ' || CAST(o_custkey % 50 AS STRING) END",
    "from_contact": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE '9' || lpad(CAST(o_custkey AS STRING), 9, '0') END",
    "to_contact": "CASE WHEN o_orderkey % 14 = 0 THEN '' ELSE '44' || lpad(CAST(o_orderkey AS STRING), 9, '0') END",
    "contents": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Car parts' WHEN 2 THEN 'Papers 100%' ELSE 'Ladies wear' END",
    "invoice_number": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'INV-' || CAST(o_orderkey * 3 AS STRING) END",
    "reference_number": "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'R' || CAST(o_custkey AS STRING) END",
    "sender_company": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'Company ' || CAST(o_custkey % 30 AS STRING) END",
    "receiver_company": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE upper(c_mktsegment) || ' LTD' END",
    "route_code": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'RT' || CAST(o_orderkey % 100 AS STRING) END",
    "booking_date": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END",
    "from_city": "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Chennai' END",
    "to_name": "c_name",
    "to_city": "c_mktsegment",
    "to_country": "CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE n_name END",
    "service_type": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Express' END",
    "declared_value": "o_totalprice",
    "created_at": "o_orderdate",
    "ship_date": "substr(CAST(o_orderdate AS STRING), 1, 10)",
    "pieces": "COALESCE(n_lines, 1)",
    "actual_weight": "weight",
    "delivered_at": "CASE WHEN o_orderstatus = 'F' THEN shipped END",
    "manual_tracking": "CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END",
    "waybill_generated": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END",
    "tracking_registered": "CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 END",
    "auto_tracking": "CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 1 END",
    "last_tracked_at": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE shipped END",
}
_LINES_SQL = "SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS weight, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey"

USERS = {"id": "s_suppkey", "username": "s_name", "role": "CASE WHEN s_suppkey % 5 = 0 THEN 'admin' ELSE 'employee' END"}
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
TRACKING_EVENTS = {
    "id": "event_id",
    "ge_tracking_number": "'GE' || CAST(1000000 + user_id AS STRING)",
    "event_timestamp": "ts",
    "status": "CASE event_type WHEN 'view' THEN 'In Transit' WHEN 'click' THEN 'Picked Up' WHEN 'purchase' THEN 'Delivered' WHEN 'error' THEN 'Exception' ELSE 'Information Received' END",
    "location": f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE 'HUB ' || CAST({_K} % 4 AS STRING) || CASE WHEN {_K} % 7 = 0 THEN ' ' ELSE '' END END",
    "provider": f"CASE WHEN {_K} % 2 = 0 THEN 'A' ELSE 'B' END",
}
_AUDITED = {
    "entity": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'shipments' END",
    "entity_id": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id AS STRING) END",
    "ip_address": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE '10.0.0.' || CAST(event_id % 250 AS STRING) END",
    "device": "CASE WHEN event_id % 5 = 0 THEN 'a \"quoted\" agent' END",
    "status": "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END",
    "old_value": "CASE WHEN event_id % 7 = 0 THEN props END",
    "new_value": "props",
    "details": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE 'n. ' || CAST(event_id AS STRING) END",
}
API_LOGS = {"id": "event_id", "provider": "event_type", "success": "CASE WHEN value < 50 THEN 1 ELSE 0 END", "response_ms": "value", "created_at": "ts"}
AUDIT_LOG = {"id": "event_id", "username": "'user_' || CAST(user_id AS STRING)", "role": "CASE WHEN user_id % 5 = 0 THEN 'admin' ELSE 'employee' END", "action": "upper(event_type)", "created_at": "ts", **_AUDITED}
NOTIFICATIONS = {"id": "event_id", "user_id": "user_id", "status": f"CASE {_K} % 3 WHEN 0 THEN 'Queued' WHEN 1 THEN 'Failed' ELSE 'Sent' END", "event": "event_type", "created_at": "ts"}
UPLOAD_JOBS = {"id": "event_id", "uploaded_by": "user_id", "created_at": "ts"}
RECORDS = {"job": "source", "doc_id": "doc_id", "validation_status": "CASE quality WHEN 1 THEN 'Valid' WHEN 0 THEN 'Invalid' ELSE 'Pending' END"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


#: Columns of shipments that come from lines, and from customers and nations.
_OF_LINES, _OF_CUSTOMERS, _OF_NATIONS = ("n_lines", "weight", "shipped"), ("c_name", "c_mktsegment"), ("n_name",)


def shipments(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The shipments' columns, or those asked for; only tables that these need are joined.

    An order has one customer and a customer one nation (foreign keys), so the joins left out wouldn't drop a row.
    """
    wanted = {c: SHIPMENTS[c] for c in columns or SHIPMENTS}
    needs = lambda sources: any(s in e for e in wanted.values() for s in sources)
    orders = read(spark, sf_dir, "orders")
    if needs(_OF_CUSTOMERS) or needs(_OF_NATIONS):
        orders = orders.join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if needs(_OF_NATIONS):
        orders = orders.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if needs(_OF_LINES):
        orders = orders.join(_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return _select(orders, wanted)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("weight"), F.max("l_shipdate").alias("shipped"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "supplier"), USERS)


def tracking_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "events"), TRACKING_EVENTS)


def api_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "events"), API_LOGS)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "events"), AUDIT_LOG)


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "events"), NOTIFICATIONS)


def upload_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "events").where("event_type = 'signup'"), UPLOAD_JOBS)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left"), RECORDS)


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"


_VIEWS = {
    "shipments": _sql(SHIPMENTS, f"orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ({_LINES_SQL}) ON o_orderkey = l_orderkey"),
    "users": _sql(USERS, "supplier"),
    "tracking_events": _sql(TRACKING_EVENTS, "events"),
    "api_logs": _sql(API_LOGS, "events"),
    "audit_log": _sql(AUDIT_LOG, "events"),
    "notifications": _sql(NOTIFICATIONS, "events"),
    "upload_jobs": _sql(UPLOAD_JOBS, "events WHERE event_type = 'signup'"),
    "records": _sql(RECORDS, "documents LEFT JOIN labels USING (doc_id)"),
}


def over(*views: str, sql: str) -> str:
    """sql over the named views, for the oracle."""
    return "WITH " + ",\n".join(f"{v} AS ({_VIEWS[v]})" for v in views) + "\n" + sql
