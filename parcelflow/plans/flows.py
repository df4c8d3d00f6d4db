"""Uploads read back, streams run to their end, and records merged."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..folders import work_dir
from ..functions import validation, values
from ..operators import changes, listings, waybills
from ..sources import exports, uploads, xlsx
from ..streaming import pushes, tracking
from . import views
from .registry import query
from .views import over

col = F.col


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """A customer's sheet: headers in a form of their own, quotes and commas in values, blanks."""
    rows = views.shipments(spark, d, "id", "carrier", "carrier_tracking_number", "to_city", "contents")
    attention = F.when(col("id") % 4 == 1, F.concat(F.lit('the "boss", floor '), (col("id") % 9).cast("string")))
    return rows.select(col("id").cast("string").alias("Ref"), col("carrier").alias(" Courier "), col("carrier_tracking_number").alias("AWB"), F.when(col("id") % 3 == 0, "").otherwise("5").alias("Weight"), col("to_city").alias("Destination  City"), attention.alias("ATTN"), F.lit("7").alias("Pkg Length"))


_SHEET_SQL = """SELECT CAST(id AS STRING) AS reference_number, carrier, carrier_tracking_number, CASE WHEN id % 3 > 0 THEN '5' END AS actual_weight, to_city,
 CASE WHEN id % 4 = 1 THEN 'the "boss", floor ' || CAST(id % 9 AS STRING) END AS receiver_attention, '7' AS package_length FROM shipments"""
_READ = ("reference_number", "carrier", "carrier_tracking_number", "actual_weight", "to_city", "receiver_attention", "package_length")


@query(over("shipments", sql=_SHEET_SQL))
def src_csv(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: written as CSV, and read with every alias of the headers."""
    path = f"{work_dir(spark)}/sheet"
    uploads.write_csv(_sheet(spark, d), path)
    return uploads.normalised(uploads.read_csv(spark, path)).select(*_READ)


@query(over("shipments", sql=_SHEET_SQL))
def src_excel(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: written as workbooks of 20,000 rows, and read in parts of a megabyte, with every alias of the headers."""
    path = f"{work_dir(spark)}/books"
    xlsx.register(spark)
    _sheet(spark, d).write.format("xlsx").option("rows", 20_000).mode("append").save(path)
    return uploads.normalised(spark.read.format("xlsx").option("bytes", 1 << 20).load(path)).select(*_READ)


_MEMBERS = "CASE id % 9 WHEN 0 THEN 'in/scan ' || id || '.pdf' WHEN 1 THEN 'a' || id || '.TIFF' WHEN 2 THEN 'deep/er/b&' || id || '.webp' WHEN 3 THEN 'c' || id || '.txt' WHEN 4 THEN 'd(' || id || ').jpeg' WHEN 5 THEN 'e' || id || '.png' WHEN 6 THEN 'folder' || id || '.pdf/' WHEN 7 THEN 'f' || chr(92) || 'g' || id || '.jpg' ELSE 'no ending' || id END"


@query(over("shipments", sql=f"""SELECT CAST(id // 500 AS STRING) AS archive, regexp_replace(regexp_extract(replace(name, chr(92), '/'), '[^/]*$'), '[^a-zA-Z0-9._-]', '_', 'g') AS name, to_city AS content
FROM (SELECT id, to_city, {_MEMBERS} AS name FROM shipments) WHERE id % 9 NOT IN (3, 6, 8)"""))
def src_zip(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: 500 shipments' files to a zip archive, and its pictures and documents read again by tidy names."""
    rows = views.shipments(spark, d, "id", "to_city")
    files = rows.select(F.floor(col("id") / 500).cast("string").alias("archive"), F.expr(_MEMBERS).alias("name"), F.encode("to_city", "utf-8").alias("content"))
    found = uploads.members(exports.zipped(files).select(col("archive").alias("path"), "content"))
    return found.select("archive", "name", F.decode("content", "utf-8").alias("content"))


@query(over("shipments", sql="""SELECT row_number() OVER (ORDER BY nth, o) AS id, reference, nth FROM (
SELECT 1 AS nth, id AS o, 'R' || id AS reference FROM shipments WHERE id % 3 > 0 UNION ALL SELECT 2, id, 'R' || id FROM shipments WHERE id % 3 = 0)"""))
def snk_insert(spark: SparkSession, d: str) -> DataFrame:
    """Two imports, each run twice: every row once, under ids without gaps that follow the table's greatest."""
    path, rows = f"{work_dir(spark)}/shipments", views.shipments(spark, d, "id")
    sheet = lambda k, test: rows.where(test).select(col("id").alias("o"), F.concat(F.lit("R"), col("id").cast("string")).alias("reference"), F.lit(k).alias("nth"))
    for k, test in ((1, "id % 3 > 0"), (2, "id % 3 = 0"), (1, "id % 3 > 0"), (2, "id % 3 = 0")):
        table = changes.append_import(spark, path, sheet(k, test), f"import-{k}", ["o"])
    return table.select("id", "reference", "nth")


@query(over("shipments", sql="SELECT id, status, 'short' AS kind FROM shipments WHERE id IN (1, 2, 33, 34, 1000) UNION ALL SELECT id, status, 'long' FROM shipments WHERE id % 2 = 0 AND id < 6000 UNION ALL SELECT id, status, 'table' FROM shipments WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)"))
def src_in_list(spark: SparkSession, d: str) -> DataFrame:
    """A short list in the query, a longer one joined, and a table of values."""
    rows = views.shipments(spark, d, "id", "status")
    values = views.read(spark, d, "lineitem").where("l_quantity > 48").select("l_orderkey")
    lists = {"short": [1, 2, 33, 34, 1000, None], "long": list(range(0, 6000, 2)), "table": values}
    found = [listings.in_list(rows, "id", v).withColumn("kind", F.lit(k)) for k, v in lists.items()]
    return found[0].union(found[1]).union(found[2])


@query(over("shipments", sql="SELECT id, CASE id % 7 WHEN 0 THEN 'csv' WHEN 1 THEN 'excel' WHEN 2 THEN 'excel' WHEN 3 THEN 'zip' WHEN 4 THEN 'pdf' ELSE 'unknown' END AS kind FROM shipments"))
def src_file_filter(spark: SparkSession, d: str) -> DataFrame:
    endings = F.element_at(F.array(*map(F.lit, ("a.csv", "B.XLSX", "c.d.xls", "x/y.Zip", "z.pdf", "no ending", "pdf"))), (col("id") % 7 + 1).cast("int"))
    return views.shipments(spark, d, "id").select("id", uploads.file_kind(endings).alias("kind"))


@query(over("shipments", "tracking_events", sql="""SELECT s.ge_tracking_number, strftime(created_at, '%Y-%m') AS month, coalesce(n, 0) AS events FROM shipments s
LEFT JOIN (SELECT ge_tracking_number AS g, count(*) AS n FROM tracking_events GROUP BY 1) ON g = s.ge_tracking_number WHERE delivered_at IS NOT NULL"""))
def snk_json_backup(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: backed up as JSON in a folder for each month, and read again."""
    path = f"{work_dir(spark)}/backup"
    uploads.write_backup(views.shipments(spark, d, "ge_tracking_number", "created_at", "delivered_at").where("delivered_at is not null"), views.tracking_events(spark, d), "created_at", path)
    held = spark.read.schema("ge_tracking_number string, tracking_events array<struct<id: long>>, month string").json(path)
    return held.select("ge_tracking_number", "month", F.coalesce(F.size("tracking_events"), F.lit(0)).cast("long").alias("events"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    told = pushes.follow(spark, f"{d}/events.parquet").select(*(F.expr(e).alias(c) for c, e in views.TRACKING_EVENTS.items()))
    return told.select(col("ge_tracking_number").alias("number"), col("id").alias("seq"), F.date_format("event_timestamp", "yyyy-MM-dd HH:00:00").alias("ts"), "status", "location")


_COUNTED = """SELECT ge_tracking_number AS number, id, status FROM (SELECT *, strftime(event_timestamp, '%Y-%m-%d %H') AS hour FROM tracking_events)
 QUALIFY location IS NULL OR row_number() OVER (PARTITION BY ge_tracking_number, hour, status, trim(location) ORDER BY id) = 1"""


@query(over("tracking_events", sql=f"""SELECT number, arg_max(status, id) AS tracking_status, coalesce(arg_max(mapped, id) FILTER (rank = greatest(reached, 0)), 'Processing') AS status, count(*) AS n_events FROM (
 SELECT *, max(rank) OVER (PARTITION BY number ORDER BY id ROWS UNBOUNDED PRECEDING) AS reached FROM (
  SELECT *, CASE mapped WHEN 'Processing' THEN 0 WHEN 'Picked Up' THEN 1 WHEN 'In Transit' THEN 2 WHEN 'Out for Delivery' THEN 3 WHEN 'Delivered' THEN 4 WHEN 'Exception' THEN 4 WHEN 'Returned' THEN 4 END AS rank
  FROM (SELECT *, CASE WHEN status = 'Information Received' THEN 'Processing' ELSE status END AS mapped FROM ({_COUNTED})))) GROUP BY number"""))
def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream, hours as their time, so that some are told twice; the last state of each shipment."""
    return pushes.newest_states(spark, _events(spark, d))


@query(over("tracking_events", sql="SELECT strftime(event_timestamp, '%Y-%m-%d %H') AS hour, status, count(*) AS events FROM tracking_events GROUP BY ALL"))
def stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    totals = pushes.hourly_totals(spark, _events(spark, d))
    return totals.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "status", "events")


@query(over("tracking_events", sql="""SELECT ge_tracking_number AS number, CASE id % 4 WHEN 0 THEN 'In Transit' WHEN 1 THEN 'Delivered' WHEN 2 THEN 'Exception' ELSE 'Information Received' END AS current,
 least(id % 30, 20) AS n_events, CASE WHEN id % 30 > 0 THEN 'E' || (id % 30) END AS first FROM tracking_events WHERE provider = 'A'"""))
def src_webhook_a(spark: SparkSession, d: str) -> DataFrame:
    """Vendor A's lines with up to 29 events, of which the oldest 20 count; told newest first."""
    n = col("id") % 30
    event = lambda k: F.struct(F.lit("2024-01-01").alias("checkpoint_date"), F.concat(F.lit(" E"), k.cast("string")).alias("tracking_detail"), F.lit(None).cast("string").alias("location"))
    told = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), n), event))
    status = F.element_at(F.array(*map(F.lit, ("transit", "delivered", "undelivered", ""))), (col("id") % 4 + 1).cast("int"))
    line = F.to_json(F.struct(F.struct(col("ge_tracking_number").alias("tracking_number"), status.alias("delivery_status"), F.struct(told.alias("trackinfo")).alias("origin_info")).alias("data")))
    found = pushes.payloads(views.tracking_events(spark, d).where("provider = 'A'").select(line.alias("value")), "A")
    return found.select("number", "current", F.size("events").cast("long").alias("n_events"), F.try_element_at("events", F.lit(1))["status"].alias("first"))


@query(over("shipments", sql="""SELECT id, CASE WHEN id % 2 = 0 THEN carrier ELSE coalesce(carrier, 'TNT') END AS carrier, CASE WHEN from_city <> '' THEN from_city WHEN id % 2 = 1 THEN 'Pune' END AS from_city,
 concat_ws('; ', CASE WHEN carrier_tracking_number IS NULL THEN 'Tracking number not detected' END, CASE WHEN to_country = '' THEN 'Destination country not detected' END, CASE WHEN id % 5 = 0 THEN 'odd' END) AS warnings,
 TRY_CAST(id || '.5' AS DOUBLE) AS loose FROM shipments"""))
def tx_hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """Gaps filled from a second reading, warnings of both without repeats, and what lacks of the mandatory fields."""
    rows = views.shipments(spark, d, "id", "carrier", "from_city", "carrier_tracking_number", "to_name", "to_country")
    other = rows.where("id % 2 = 1").select("id", F.lit("TNT").alias("carrier"), F.lit("Pune").alias("from_city"))
    lacking = validation.missing_fields(col("carrier_tracking_number"), col("to_name"), col("to_country"))
    both = validation.merge_warnings(lacking, F.concat(F.when(col("id") % 5 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")), lacking))
    loose = values.to_number_loose(F.concat(F.lit("about "), col("id").cast("string"), F.lit(".5 kg")))
    return waybills.fill_gaps(rows, other, "id", ("carrier", "from_city")).select("id", "carrier", "from_city", F.array_join(both, "; ").alias("warnings"), loose.alias("loose"))


_RAW_A = "CASE status WHEN 'In Transit' THEN 'transit' WHEN 'Delivered' THEN 'delivered' WHEN 'Exception' THEN 'undelivered' WHEN 'Picked Up' THEN 'pickup' ELSE 'odd' END"
_RAW_B = "CASE status WHEN 'In Transit' THEN 'InTransit' WHEN 'Delivered' THEN 'Delivered' WHEN 'Exception' THEN 'DeliveryFailure' WHEN 'Picked Up' THEN 'OutForDelivery' ELSE 'InfoReceived' END"
_TOLD = "CASE status WHEN 'Picked Up' THEN 'Out for Delivery' WHEN 'Information Received' THEN CASE WHEN provider = 'B' THEN 'Information Received' ELSE 'odd' END ELSE status END"
_RANKED = "CASE mapped WHEN 'Processing' THEN 0 WHEN 'In Transit' THEN 2 WHEN 'Out for Delivery' THEN 3 WHEN 'Delivered' THEN 4 WHEN 'Exception' THEN 4 END"


@query(over("tracking_events", sql=f""",
 timed AS (SELECT ge_tracking_number AS number, id, id % 3 AS wave, provider, status, strftime(event_timestamp, '%Y-%m-%d %H') AS ts, trim(coalesce(location, '')) AS location FROM tracking_events),
 seen AS (SELECT number, count(*) AS n FROM (SELECT DISTINCT number, ts, status, location FROM (
   SELECT a.number, a.id AS update, h.ts, h.status, h.location, row_number() OVER (PARTITION BY a.number, a.id ORDER BY h.id) AS nth FROM timed a JOIN timed h ON a.number = h.number AND (h.wave < a.wave OR h.wave = a.wave AND h.id <= a.id)) WHERE nth <= 20) GROUP BY 1),
 updates AS (SELECT number, provider, id, wave, row_number() OVER (PARTITION BY number ORDER BY wave, id) AS nth, {_TOLD} AS current FROM timed),
 steps AS (SELECT *, lag(current) OVER (PARTITION BY number ORDER BY nth) AS before, max({_RANKED}) OVER (PARTITION BY number ORDER BY nth ROWS UNBOUNDED PRECEDING) AS reached, {_RANKED} AS rank
  FROM (SELECT *, CASE WHEN current = 'Information Received' THEN 'Processing' ELSE current END AS mapped FROM updates))
SELECT number, arg_max(provider, nth) AS provider, arg_max(coalesce(current, '-'), nth) AS tracking_status, coalesce(arg_max(mapped, nth) FILTER (rank = greatest(reached, 0)), 'Processing') AS status, max(n) AS n_events, count(*) AS n_updates,
 count(*) FILTER (current IS NOT NULL AND current IS DISTINCT FROM before) AS n_changes FROM steps JOIN seen USING (number) GROUP BY number"""))
def src_pull_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Lines of both vendors in three waves. Each tells a shipment's history so far again; a third of all events come late."""
    rows = views.tracking_events(spark, d).withColumns({"wave": col("id") % 3, "ts": F.date_format("event_timestamp", "yyyy-MM-dd HH")})
    so_far = F.collect_list(F.struct("id", "ts", "status", "location")).over(Window.partitionBy("ge_tracking_number").orderBy("wave", "id"))
    by_id = F.sort_array(so_far, asc=False)
    history = F.transform(by_id, lambda e: F.struct(e["ts"].alias("t"), F.concat(F.lit(" "), e["status"]).alias("s"), e["location"].alias("l")))
    told = rows.select("ge_tracking_number", "id", "wave", "provider", "status", history.alias("told"))
    a = F.struct(F.struct(col("ge_tracking_number").alias("tracking_number"), F.expr(_RAW_A).alias("delivery_status"), F.struct(F.transform("told", lambda e: F.struct(e["t"].alias("checkpoint_date"), e["s"].alias("tracking_detail"), e["l"].alias("location"))).alias("trackinfo")).alias("origin_info")).alias("data"))
    providers = F.array(F.struct(F.transform("told", lambda e: F.struct(e["t"].alias("time_iso"), e["s"].alias("description"), e["l"].alias("location"))).alias("events")))
    b = F.struct(F.lit("TRACKING_UPDATED").alias("event"), F.struct(col("ge_tracking_number").alias("number"), F.struct(F.struct(F.expr(_RAW_B).alias("status")).alias("latest_status"), F.struct(providers.alias("providers")).alias("tracking")).alias("track_info")).alias("data"))
    lines = told.select("provider", col("id").alias("arrival"), F.when(col("provider") == "A", F.to_json(a)).otherwise(F.to_json(b)).alias("value"), "wave")
    found = tracking.waves(spark, lines, "wave", 3)
    return found.withColumn("tracking_status", F.coalesce("tracking_status", F.lit("-")))


_NATIVE = {"carrier_tracking_number": "CASE id % 4 WHEN 0 THEN 'N' || id WHEN 1 THEN 'null' ELSE '' END", "actual_weight": "CASE WHEN id % 8 = 3 THEN 2.5e0 END", "contents": "CAST(NULL AS STRING)", "to_city": "CASE WHEN id % 3 = 0 THEN to_city END"}
_PICTURE = {"carrier_tracking_number": "'P' || id", "actual_weight": "9.5e0", "contents": "CASE WHEN id % 2 = 0 THEN 'THINGS' END", "to_city": "'Pune'"}


@query(over("shipments", sql=f"""SELECT id, CASE WHEN id % 10 = 9 THEN 'ocr' WHEN need THEN 'pdf_text_layer+ocr' ELSE 'pdf_text_layer' END AS engine, CASE WHEN need OR id % 10 = 9 THEN pt ELSE ct END AS carrier_tracking_number,
 CASE WHEN need OR id % 10 = 9 THEN pw ELSE cw END AS actual_weight, CASE WHEN need OR id % 10 = 9 THEN pc END AS contents, CASE WHEN id % 10 = 9 THEN 'Pune' WHEN need THEN coalesce(city, 'Pune') ELSE city END AS to_city
FROM (SELECT id, id % 7 > 0 AND ({_NATIVE['carrier_tracking_number']}) IN ('', 'null') AND ({_NATIVE['actual_weight']}) IS NULL AS need, {_NATIVE['carrier_tracking_number']} AS ct, {_NATIVE['actual_weight']} AS cw, {_NATIVE['to_city']} AS city,
 {_PICTURE['carrier_tracking_number']} AS pt, {_PICTURE['actual_weight']} AS pw, {_PICTURE['contents']} AS pc FROM shipments) WHERE id % 10 < 9 OR id % 7 > 0"""))
def tx_second_reading(spark: SparkSession, d: str) -> DataFrame:
    """Text layers without any critical field are filled from the pictures' reading; others stay, gaps and all."""
    rows = views.shipments(spark, d, "id", "to_city")
    of = lambda fields, test: rows.where(test).select("id", *(F.expr(e).alias(c) for c, e in fields.items()))
    return waybills.with_second_reading(of(_NATIVE, "id % 10 < 9"), of(_PICTURE, "id % 7 > 0"), tuple(_NATIVE))
