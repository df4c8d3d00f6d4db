"""Tables after inserts, upserts, patches, deletes and purges."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, reports
from . import views
from .registry import query
from .views import RETENTION_NOW, over


@query(over("tracking_events", sql="""SELECT id, ge_tracking_number, status, location FROM tracking_events WHERE provider = 'A'
UNION ALL SELECT id, ge_tracking_number, status, location FROM tracking_events WHERE provider = 'B' AND location IS NULL
UNION ALL SELECT min(id), ge_tracking_number, status, location FROM tracking_events t WHERE provider = 'B' AND location IS NOT NULL
 AND NOT EXISTS (SELECT 1 FROM tracking_events o WHERE o.provider = 'A' AND o.ge_tracking_number = t.ge_tracking_number AND o.status = t.status AND o.location = t.location)
 GROUP BY ge_tracking_number, status, location"""))
def snk_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    events = views.tracking_events(spark, d)
    old, new = (events.where(F.col("provider") == p).select("id", "ge_tracking_number", "status", "location") for p in ("A", "B"))
    return changes.insert_ignore(old, new, ["ge_tracking_number", "status", "location"], "id")


@query(over("users", "tracking_events", sql="""SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN o.value ELSE n.value END AS value
FROM (SELECT 'GE' || CAST(1000000 + id AS STRING) AS key, role AS value FROM users) o
FULL JOIN (SELECT ge_tracking_number AS key, arg_max(status, id) AS value FROM tracking_events GROUP BY 1) n ON o.key = n.key"""))
def snk_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = views.users(spark, d).select(F.concat(F.lit("GE"), (F.col("id") + 1000000).cast("string")).alias("key"), F.col("role").alias("value"))
    new = views.tracking_events(spark, d).select(F.col("ge_tracking_number").alias("key"), F.col("status").alias("value"), "id")
    return changes.upsert(old, new, "key", "id")


#: Every third shipment is changed twice; the second change counts.
_CHANGED = "SELECT id, CASE WHEN id % 3 = 0 THEN 'Lost' WHEN from_city = '' THEN NULL ELSE 'Returned' END AS status, 'Mumbai' AS from_city FROM shipments WHERE status = 'In Transit'"


def _changed(shipments: DataFrame) -> DataFrame:
    moving = shipments.where("status = 'In Transit'")
    first = moving.select("id", F.when(F.col("from_city") != "", "Returned").alias("status"), F.lit("Mumbai").alias("from_city"), F.lit(1).alias("nth"))
    return first.union(moving.where("id % 3 = 0").select("id", F.lit("Lost"), F.lit("Mumbai"), F.lit(2)))


@query(over("shipments", sql=f"SELECT s.id, coalesce(c.status, s.status) AS status, coalesce(c.from_city, s.from_city) AS from_city FROM shipments s LEFT JOIN ({_CHANGED}) c ON s.id = c.id"))
def snk_patch_update(spark: SparkSession, d: str) -> DataFrame:
    shipments = views.shipments(spark, d).select("id", "status", "from_city")
    return changes.patch(shipments, _changed(shipments), "id", "nth")


@query(over("shipments", sql=f"SELECT s.id, CASE WHEN c.id IS NULL THEN s.status ELSE c.status END AS status, CASE WHEN c.id IS NULL THEN s.from_city ELSE c.from_city END AS from_city FROM shipments s LEFT JOIN ({_CHANGED}) c ON s.id = c.id"))
def snk_overwrite_update(spark: SparkSession, d: str) -> DataFrame:
    shipments = views.shipments(spark, d).select("id", "status", "from_city")
    return changes.overwrite(shipments, _changed(shipments), "id", "nth")


@query(over("tracking_events", sql="SELECT id, ge_tracking_number, status, location FROM tracking_events WHERE id IN (SELECT min(id) FROM tracking_events GROUP BY ge_tracking_number, status, location)"))
def snk_dedupe_cleanup(spark: SparkSession, d: str) -> DataFrame:
    events = views.tracking_events(spark, d).select("id", "ge_tracking_number", "status", "location")
    return changes.drop_repeats(events, ["ge_tracking_number", "status", "location"])


_UNDATED = "CASE WHEN id % 10 = 0 THEN NULL ELSE created_at END"


@query(over("audit_log", sql=f"SELECT id, created_at FROM (SELECT id, {_UNDATED} AS created_at FROM audit_log) WHERE NOT coalesce(created_at < TIMESTAMP '2024-01-15', false)"))
def snk_delete_ttl(spark: SparkSession, d: str) -> DataFrame:
    return changes.keep_newer(views.audit_log(spark, d).select("id", F.expr(_UNDATED).alias("created_at")), "created_at", "2024-01-15")


@query(over("shipments", sql=f"""SELECT id, due, CASE WHEN due <= DATE '{RETENTION_NOW}' THEN 'due' WHEN due <= DATE '{RETENTION_NOW}' + 15 THEN 'warning' ELSE 'kept' END AS state
FROM (SELECT id, CAST(delivered_at + INTERVAL 6 MONTH AS DATE) AS due FROM shipments WHERE delivered_at IS NOT NULL)"""))
def job_retention(spark: SparkSession, d: str) -> DataFrame:
    return changes.retention(views.shipments(spark, d), RETENTION_NOW, 6, 15)


@query(over("shipments", "tracking_events", sql=f"""SELECT id, ge_tracking_number FROM tracking_events WHERE ge_tracking_number NOT IN (
 SELECT ge_tracking_number FROM shipments WHERE delivered_at IS NOT NULL AND CAST(delivered_at + INTERVAL 6 MONTH AS DATE) <= DATE '{RETENTION_NOW}')"""))
def join_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    shipments = views.shipments(spark, d)
    due = changes.retention(shipments, RETENTION_NOW, 6, 15).where("state = 'due'").select("id")
    gone = shipments.join(due, "id", "left_semi").select("ge_tracking_number")
    return changes.purge(views.tracking_events(spark, d).select("id", "ge_tracking_number"), gone, "ge_tracking_number")


@query(over("shipments", sql="""SELECT status, count(*) AS n, string_agg(line, chr(10) ORDER BY id) FILTER (place <= 50) AS report FROM (
 SELECT id, status, ge_tracking_number || ' since ' || substr(CAST(created_at AS STRING), 1, 10) AS line, row_number() OVER (PARTITION BY status ORDER BY id) AS place FROM shipments) GROUP BY status"""))
def fn_report_line(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 lines of each status; only those are collected."""
    from pyspark.sql import Window

    line = F.concat("ge_tracking_number", F.lit(" since "), F.substring(F.col("created_at").cast("string"), 1, 10))
    shipments = views.shipments(spark, d)
    placed = shipments.select("id", "status", line.alias("line"), F.row_number().over(Window.partitionBy("status").orderBy("id")).alias("place")).where("place <= 50")
    lines = placed.groupBy("status").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("lines"))
    counts = shipments.groupBy("status").agg(F.count("*").alias("n"))
    return counts.join(lines, "status").select("status", "n", F.array_join(F.col("lines.line"), "\n").alias("report"))


@query(over("records", "api_logs", sql="SELECT 'records' AS name, count(*) AS rows FROM records UNION ALL SELECT 'api_logs', count(*) FROM api_logs"))
def snk_delete_all_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.table_counts({"records": views.records(spark, d), "api_logs": views.api_logs(spark, d)})
