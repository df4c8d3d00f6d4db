"""Listings, searches, pages, joins and windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values
from ..operators import events, listings
from . import views
from .registry import query
from .views import over

_COLUMNS = "id, ge_tracking_number, carrier, status"


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", "ge_tracking_number", "carrier", "status", *more)


@query(over("shipments", sql=f"SELECT {_COLUMNS}, ship_date FROM shipments WHERE status = 'Delivered' AND carrier = 'DHL' AND ship_date >= '2000-01-01' AND ship_date <= '2000-12-31'"))
def flt_dynamic_and(spark: SparkSession, d: str) -> DataFrame:
    return _shown(listings.filtered(views.shipments(spark, d), status="Delivered", carrier="DHL", tracking_status="", date_from="2000-01-01", date_to="2000-12-31"), "ship_date")


@query(over("shipments", sql=f"SELECT {_COLUMNS} FROM shipments WHERE " + " OR ".join(f"{c} ILIKE '%000012%'" for c in listings.SEARCHED)))
def flt_search_13(spark: SparkSession, d: str) -> DataFrame:
    return _shown(listings.search(views.shipments(spark, d), "000012"))


@query(over("audit_log", sql="SELECT * FROM audit_log WHERE created_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'"))
def flt_ts_range(spark: SparkSession, d: str) -> DataFrame:
    stamp = lambda s: F.lit(s).cast("timestamp_ntz")
    return views.audit_log(spark, d).where(F.col("created_at").between(stamp("2024-01-10"), stamp("2024-01-12")))


@query(over("shipments", sql=f"SELECT {_COLUMNS}, tracking_status FROM shipments WHERE tracking_status IS NULL OR tracking_status <> 'Exception'"))
def flt_null_or_ne(spark: SparkSession, d: str) -> DataFrame:
    return _shown(views.shipments(spark, d).where(~F.col("tracking_status").eqNullSafe(F.lit("Exception"))), "tracking_status")


@query(over("shipments", sql=f"SELECT {_COLUMNS} FROM shipments WHERE last_tracked_at IS NULL OR last_tracked_at <= TIMESTAMP '2001-08-02' - INTERVAL 25 MINUTE"))
def flt_stale(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("last_tracked_at")
    return _shown(views.shipments(spark, d).where(at.isNull() | (at <= F.lit("2001-08-01 23:35:00").cast("timestamp_ntz"))))


@query(over("shipments", sql=f"SELECT {_COLUMNS} FROM shipments WHERE auto_tracking = 1 AND carrier_tracking_number IS NOT NULL AND tracking_registered = 0 AND status <> 'Delivered' ORDER BY id LIMIT 100"))
def flt_retry_eligible(spark: SparkSession, d: str) -> DataFrame:
    wanted = views.shipments(spark, d).where("auto_tracking = 1 and carrier_tracking_number is not null and tracking_registered = 0 and status <> 'Delivered'")
    return _shown(wanted.orderBy("id").limit(100))


@query(over("shipments", sql=f"SELECT {_COLUMNS}, created_at FROM shipments WHERE manual_tracking = 1"))
def flt_manual_queue(spark: SparkSession, d: str) -> DataFrame:
    return _shown(views.shipments(spark, d).where("manual_tracking = 1").orderBy(F.desc("created_at"), "id"), "created_at")


@query(over("notifications", sql="SELECT id, user_id, status FROM notifications WHERE status IN ('Queued', 'Failed') ORDER BY id LIMIT 50"))
def flt_queue_status(spark: SparkSession, d: str) -> DataFrame:
    return views.notifications(spark, d).where(F.col("status").isin("Queued", "Failed")).orderBy("id").limit(50).select("id", "user_id", "status")


@query(over("audit_log", sql="SELECT * FROM audit_log WHERE username = 'user_8' AND action IN ('VIEW', 'SIGNUP', 'ERROR')"))
def flt_login_history(spark: SparkSession, d: str) -> DataFrame:
    return views.audit_log(spark, d).where((F.col("username") == "user_8") & F.col("action").isin("VIEW", "SIGNUP", "ERROR"))


@query(over("shipments", sql="SELECT id, regexp_matches(upper(regexp_replace(lower(ge_tracking_number) || ' ', '[ -]', '', 'g')), '^GE[0-9]{7}$') AS valid FROM shipments"))
def flt_valid_ge(spark: SparkSession, d: str) -> DataFrame:
    return views.shipments(spark, d).select("id", values.is_ge_number(F.concat(F.lower("ge_tracking_number"), F.lit(" "))).alias("valid"))


@query(over("shipments", sql=f"SELECT {_COLUMNS}, created_at FROM shipments ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 40"))
def top_page(spark: SparkSession, d: str) -> DataFrame:
    return _shown(listings.page(views.shipments(spark, d), "no such column", "desc", 3, 20), "created_at")


@query(over("shipments", sql=f"SELECT {_COLUMNS}, booking_date FROM shipments ORDER BY booking_date ASC NULLS FIRST, id LIMIT 25 OFFSET 25"))
def top_page_ascending(spark: SparkSession, d: str) -> DataFrame:
    return _shown(listings.page(views.shipments(spark, d), "booking_date", "asc", 2, 25), "booking_date")


@query(over("shipments", sql=f"SELECT {_COLUMNS} FROM shipments ORDER BY created_at ASC NULLS FIRST, id LIMIT 25 OFFSET 25"))
def flt_whitelist_sort(spark: SparkSession, d: str) -> DataFrame:
    """A column that isn't listed doesn't sort: the page is by creation."""
    return _shown(listings.page(views.shipments(spark, d), "carrier", "asc", 2, 25))


@query(over("tracking_events", sql="SELECT id, ge_tracking_number, event_timestamp FROM tracking_events QUALIFY row_number() OVER (PARTITION BY ge_tracking_number ORDER BY event_timestamp DESC, id DESC) <= 50"))
def top_per_key(spark: SparkSession, d: str) -> DataFrame:
    return listings.newest_per_key(views.tracking_events(spark, d), "ge_tracking_number", "event_timestamp", 50).select("id", "ge_tracking_number", "event_timestamp")


@query("SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages, count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def top_total_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return views.read(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.ceil(n / 20).alias("pages"), n.alias("total"))


@query(over("shipments", "users", sql=f"SELECT {_COLUMNS}, created_by FROM shipments WHERE created_by = 3 OR created_by IN (SELECT id FROM users WHERE role = 'admin')"))
def join_semi_or(spark: SparkSession, d: str) -> DataFrame:
    return _shown(listings.visible(views.shipments(spark, d), views.users(spark, d), 3), "created_by")


@query(over("notifications", "users", sql="SELECT n.id, n.status, username FROM notifications n LEFT JOIN users u ON n.user_id = u.id WHERE n.status = 'Queued'"))
def join_left(spark: SparkSession, d: str) -> DataFrame:
    users = views.users(spark, d).select(F.col("id").alias("user_id"), "username")
    return views.notifications(spark, d).where("status = 'Queued'").join(users, "user_id", "left").select("id", "status", "username")


@query("""WITH pairs AS (SELECT n_nationkey, n_name, r_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name AS role, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS codes FROM pairs GROUP BY r_name""")
def join_inner_3way(spark: SparkSession, d: str) -> DataFrame:
    nation, region = views.read(spark, d, "nation"), views.read(spark, d, "region")
    pairs = nation.select(F.col("n_regionkey").alias("role_id"), F.col("n_nationkey").alias("permission_id"))
    roles, permissions = region.select(F.col("r_regionkey").alias("rid"), F.col("r_name").alias("role")), nation.select(F.col("n_nationkey").alias("pid"), F.col("n_name").alias("code"))
    return listings.role_permissions(pairs, roles, permissions)


_ASKED = "SELECT DISTINCT CASE WHEN id % 2 = 0 THEN carrier_tracking_number ELSE '?' || carrier_tracking_number END AS number FROM shipments WHERE carrier_tracking_number IS NOT NULL"


def _asked(shipments: DataFrame) -> DataFrame:
    number = F.when(F.col("id") % 2 == 0, F.col("carrier_tracking_number")).otherwise(F.concat(F.lit("?"), "carrier_tracking_number"))
    return shipments.where("carrier_tracking_number is not null").select(number.alias("number")).distinct()


@query(over("shipments", sql=f"SELECT number FROM ({_ASKED}) WHERE number IN (SELECT carrier_tracking_number FROM shipments) OR number IN (SELECT awb_number FROM shipments)"))
def join_dup_or(spark: SparkSession, d: str) -> DataFrame:
    shipments = views.shipments(spark, d)
    return listings.known(_asked(shipments), shipments, "number")


@query(over("shipments", sql=f"""SELECT number, max(id) AS shipment_id FROM ({_ASKED})
LEFT JOIN (SELECT carrier_tracking_number AS n, id FROM shipments UNION SELECT awb_number, id FROM shipments) ON n = number GROUP BY number"""))
def join_latest_match(spark: SparkSession, d: str) -> DataFrame:
    shipments = views.shipments(spark, d)
    return listings.latest_match(_asked(shipments), shipments, "number")


@query(over("records", sql="SELECT job, doc_id, validation_status, row_number() OVER (PARTITION BY job ORDER BY doc_id) AS row_number FROM records"))
def join_job_records(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("job").orderBy("doc_id")).cast("long")
    return views.records(spark, d).select("job", "doc_id", "validation_status", place.alias("row_number"))


@query(over("shipments", "tracking_events", sql="""SELECT s.id, coalesce(e.n, 0) AS n, coalesce(e.ids, '') AS ids FROM shipments s LEFT JOIN (
 SELECT ge_tracking_number AS g, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY event_timestamp DESC, id DESC) AS ids
 FROM (SELECT * FROM tracking_events QUALIFY row_number() OVER (PARTITION BY ge_tracking_number ORDER BY event_timestamp DESC, id DESC) <= 50) GROUP BY 1
) e ON s.ge_tracking_number = e.g"""))
def join_one_to_many_nest(spark: SparkSession, d: str) -> DataFrame:
    nested = listings.with_events(views.shipments(spark, d).select("id", "ge_tracking_number"), views.tracking_events(spark, d))
    ids = F.array_join(F.transform("events", lambda e: e["id"].cast("string")), ",")
    return nested.select("id", F.coalesce(F.size("events"), F.lit(0)).cast("long").alias("n"), F.coalesce(ids, F.lit("")).alias("ids"))


@query(over("tracking_events", sql="""SELECT id, ge_tracking_number, status FROM (
 SELECT *, strftime(event_timestamp, '%Y-%m-%d %H:%M') || '|' || trim(status) || '|' || trim(coalesce(location, '')) AS key FROM tracking_events)
QUALIFY key IS DISTINCT FROM lag(key) OVER (PARTITION BY ge_tracking_number ORDER BY event_timestamp DESC, id DESC)"""))
def win_dedupe_consecutive(spark: SparkSession, d: str) -> DataFrame:
    return events.drop_consecutive(views.tracking_events(spark, d)).select("id", "ge_tracking_number", "status")


@query(over("shipments", sql="SELECT id, carrier_tracking_number, row_number() OVER (PARTITION BY carrier_tracking_number ORDER BY id) = 1 AS imported FROM shipments WHERE carrier_tracking_number IS NOT NULL"))
def win_first_in_batch(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("carrier_tracking_number").orderBy("id")) == 1
    return views.shipments(spark, d).where("carrier_tracking_number is not null").select("id", "carrier_tracking_number", first.alias("imported"))


@query(over("shipments", sql="SELECT id, status, coalesce(last_tracked_at, created_at) AS since FROM shipments WHERE status <> 'Delivered' ORDER BY since, id LIMIT 500"))
def win_since(spark: SparkSession, d: str) -> DataFrame:
    since = F.coalesce("last_tracked_at", "created_at").alias("since")
    return views.shipments(spark, d).where("status <> 'Delivered'").select("id", "status", since).orderBy("since", "id").limit(500)


@query(over("tracking_events", sql="""SELECT ge_tracking_number, tracking_status, status, delivered_at, changes, last_status_change_at FROM (
 SELECT ge_tracking_number, arg_max(status, id) AS tracking_status, coalesce(arg_max(mapped, id) FILTER (rank = greatest(reached, 0)), 'Processing') AS status,
  arg_min(event_timestamp, id) FILTER (status = 'Delivered') AS delivered_at, count(*) FILTER (changed) AS changes, arg_max(event_timestamp, id) FILTER (changed AND status IS NOT NULL) AS last_status_change_at
 FROM (SELECT *, max(rank) OVER (PARTITION BY ge_tracking_number ORDER BY id ROWS UNBOUNDED PRECEDING) AS reached,
   status IS DISTINCT FROM lag(status) OVER (PARTITION BY ge_tracking_number ORDER BY id) AS changed
  FROM (SELECT *, CASE mapped WHEN 'Processing' THEN 0 WHEN 'Picked Up' THEN 1 WHEN 'In Transit' THEN 2 WHEN 'Out for Delivery' THEN 3 WHEN 'Delivered' THEN 4 WHEN 'Exception' THEN 4 WHEN 'Returned' THEN 4 END AS rank
   FROM (SELECT *, CASE WHEN status = 'Information Received' THEN 'Processing' ELSE status END AS mapped FROM tracking_events)))
 GROUP BY ge_tracking_number)"""))
def state_machine(spark: SparkSession, d: str) -> DataFrame:
    return events.fold(views.tracking_events(spark, d))
