"""Reports: dashboard figures, group counts, health, jobs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from . import views
from .registry import query
from .views import ORDERS_NOW, over


_COUNTED = ("created_at", "status", "carrier", "tracking_status", "waybill_generated", "manual_tracking")


@query(over("shipments", sql=f"""SELECT
 count(*) FILTER (r) AS total, count(*) FILTER (r AND (status = 'Delivered' OR tracking_status = 'Delivered')) AS delivered,
 count(*) FILTER (r AND tracking_status IN ('In Transit', 'Picked Up', 'Out for Delivery')) AS in_transit,
 count(*) FILTER (r AND status = 'Processing') AS pending, count(*) FILTER (r AND tracking_status = 'Exception') AS exception,
 count(*) FILTER (r AND waybill_generated = 1) AS waybills, count(*) FILTER (r AND manual_tracking = 1) AS manual_queue,
 count(*) FILTER (created_at >= TIMESTAMP '2001-08-01' AND created_at < TIMESTAMP '2001-08-02') AS today
FROM (SELECT *, created_at >= TIMESTAMP '2001-01-01' AND created_at < TIMESTAMP '{ORDERS_NOW}' AS r FROM shipments)"""))  # fmt: skip
def agg_kpi_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return reports.kpis(views.shipments(spark, d, *_COUNTED), "2001-01-01", ORDERS_NOW, "2001-08-01")


@query(over("shipments", sql="""SELECT count(*) FILTER (r) AS total, count(*) FILTER (r AND (status = 'Delivered' OR tracking_status = 'Delivered')) AS delivered,
 count(*) FILTER (r AND tracking_status IN ('In Transit', 'Picked Up', 'Out for Delivery')) AS in_transit,
 count(*) FILTER (r AND status = 'Processing') AS pending, count(*) FILTER (r AND tracking_status = 'Exception') AS exception,
 count(*) FILTER (r AND waybill_generated = 1) AS waybills, count(*) FILTER (r AND manual_tracking = 1) AS manual_queue,
 count(*) FILTER (created_at >= TIMESTAMP '2000-06-01' AND created_at < TIMESTAMP '2000-06-02') AS today
FROM (SELECT *, created_at >= TIMESTAMP '2000-01-01' AND created_at < TIMESTAMP '2001-01-01' AND status = 'Delivered' AND carrier = 'DHL' AS r FROM shipments)"""))  # fmt: skip
def agg_kpi_filtered(spark: SparkSession, d: str) -> DataFrame:
    return reports.kpis(views.shipments(spark, d, *_COUNTED), "2000-01-01", "2001-01-01", "2000-06-01", "Delivered", "DHL")


@query(over("shipments", sql="SELECT carrier, count(*) AS count FROM shipments WHERE carrier IS NOT NULL GROUP BY carrier ORDER BY count DESC, carrier LIMIT 15"))
def agg_by_carrier(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_groups(views.shipments(spark, d, "carrier"), "carrier", 15, blank=True)


@query(over("upload_jobs", sql="SELECT count(*) AS uploads_today FROM upload_jobs WHERE created_at >= TIMESTAMP '2024-01-20' AND created_at < TIMESTAMP '2024-01-21'"))
def agg_kpi_uploads_today(spark: SparkSession, d: str) -> DataFrame:
    return reports.uploads_today(views.upload_jobs(spark, d), "2024-01-20")


_ASKED = "created_at >= TIMESTAMP '2000-01-01' AND created_at < TIMESTAMP '2001-01-01' AND status = 'Delivered'"


@query(over("shipments", sql=f"SELECT carrier, count(*) AS count FROM shipments WHERE {_ASKED} AND carrier IS NOT NULL GROUP BY carrier ORDER BY count DESC, carrier LIMIT 15"))
def agg_by_carrier_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked = views.shipments(spark, d, "carrier", "status", "created_at").where(reports.asked("2000-01-01", "2001-01-01", "Delivered"))
    return reports.top_groups(asked, "carrier", 15, blank=True)


@query(over("shipments", sql=f"""SELECT c AS to_country, count(*) AS count FROM (SELECT *, CASE WHEN id % 10 = 1 THEN ' ' ELSE to_country END AS c FROM shipments)
 WHERE {_ASKED} AND carrier = 'DHL' AND c <> '' GROUP BY c ORDER BY count DESC, to_country LIMIT 15"""))
def agg_by_country_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A blank of spaces is a country here, only an empty text isn't."""
    asked = views.shipments(spark, d, "id", "carrier", "status", "created_at", "to_country").where(reports.asked("2000-01-01", "2001-01-01", "Delivered", "DHL"))
    return reports.top_groups(asked.withColumn("to_country", F.when(F.col("id") % 10 == 1, " ").otherwise(F.col("to_country"))), "to_country", 15)


@query(over("shipments", sql="SELECT to_country, count(*) AS count FROM shipments WHERE coalesce(to_country, '') <> '' GROUP BY to_country ORDER BY count DESC, to_country LIMIT 15"))
def agg_by_country(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_groups(views.shipments(spark, d), "to_country", 15)


@query(over("shipments", sql="""SELECT carrier, count, CAST(round(100 * count::DOUBLE / total) AS BIGINT) AS pct
FROM (SELECT carrier, count(*) AS count, sum(count(*)) OVER () AS total FROM shipments GROUP BY carrier)
WHERE carrier IS NOT NULL ORDER BY count DESC, carrier LIMIT 6"""))
def agg_carrier_share(spark: SparkSession, d: str) -> DataFrame:
    return reports.shares(views.shipments(spark, d, "carrier"), "carrier", 6)


@query(over("shipments", sql="""SELECT day, count, greatest(max(count) OVER (), 1) AS scale
FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS count FROM shipments WHERE created_at >= TIMESTAMP '2001-07-26' GROUP BY 1)"""))
def agg_daily_7d(spark: SparkSession, d: str) -> DataFrame:
    return reports.daily(views.shipments(spark, d, "created_at"), "2001-07-26")


@query(over("audit_log", sql="""SELECT username, role, count(*) AS actions, max(created_at) AS last_at FROM audit_log
WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY username, role ORDER BY actions DESC, username, role LIMIT 10"""))
def agg_user_activity(spark: SparkSession, d: str) -> DataFrame:
    return reports.user_activity(views.audit_log(spark, d), "2024-01-24", 10)


@query(over("api_logs", sql="""SELECT *, CASE WHEN success_rate >= 90 THEN 'good' WHEN success_rate >= 50 THEN 'warn' ELSE 'bad' END AS band
FROM (SELECT provider, count(*) AS calls, CAST(sum(success) AS BIGINT) AS ok, round(avg(response_ms), 0) AS avg_ms, round(100.0e0 * sum(success) / count(*), 1) AS success_rate
 FROM api_logs WHERE created_at >= TIMESTAMP '2024-01-24' GROUP BY provider)"""))
def agg_api_health(spark: SparkSession, d: str) -> DataFrame:
    return reports.api_health(views.api_logs(spark, d), "2024-01-24")


@query(over("records", sql="""SELECT job, count(*) AS total_records, count(*) FILTER (validation_status = 'Invalid') AS failed_count,
 count(*) - count(*) FILTER (validation_status = 'Invalid') AS success_count FROM records GROUP BY job"""))
def agg_job_finalize(spark: SparkSession, d: str) -> DataFrame:
    return reports.job_totals(views.records(spark, d))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("orders", "events", "supplier", "nation")))
def agg_table_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_counts({t: views.read(spark, d, t) for t in ("orders", "events", "supplier", "nation")})


@query(over("tracking_events", sql="SELECT ge_tracking_number, status, location, min(id) AS id FROM tracking_events GROUP BY ALL"))
def agg_min_id_per_key(spark: SparkSession, d: str) -> DataFrame:
    return views.tracking_events(spark, d).groupBy("ge_tracking_number", "status", "location").agg(F.min("id").alias("id"))


@query(over("shipments", sql="""SELECT count(*) FILTER (status = 'Processing') AS pending, count(*) FILTER (status = 'In Transit') AS moving, count(*) FILTER (status = 'Delivered') AS done,
 count(*) FILTER (carrier IS NULL) AS without_carrier FROM shipments"""))
def agg_card_counts(spark: SparkSession, d: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return views.shipments(spark, d, "status", "carrier").agg(status("Processing").alias("pending"), status("In Transit").alias("moving"), status("Delivered").alias("done"), F.count_if(F.col("carrier").isNull()).alias("without_carrier"))


@query("""SELECT l_orderkey AS doc, coalesce(round(avg(c) FILTER (c >= 0), 1), 0.0e0) AS confidence
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 OR l_orderkey % 9 = 0 THEN -1 ELSE l_quantity END AS c FROM lineitem) GROUP BY l_orderkey""")
def agg_ocr_conf(spark: SparkSession, d: str) -> DataFrame:
    word = F.when((F.col("l_linenumber") % 2 == 1) | (F.col("l_orderkey") % 9 == 0), -1.0).otherwise(F.col("l_quantity"))
    return reports.word_confidence(views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), word.alias("confidence")))


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 = 0 THEN 0.0e0 ELSE coalesce(round(avg(c * 100), 1), 85.0e0) END AS confidence
FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber / 8.0e0 END AS c FROM lineitem) ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def agg_mean_conf(spark: SparkSession, d: str) -> DataFrame:
    blocks = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linenumber") % 3 > 0, F.col("l_linenumber") / 8.0).alias("confidence"))
    return reports.block_confidence(views.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_orderkey") % 5 != 0).alias("annotated")), blocks)


@query("SELECT r_name AS region, count(*) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def agg_region_counts(spark: SparkSession, d: str) -> DataFrame:
    nations = views.read(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    return views.read(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), "nations")
