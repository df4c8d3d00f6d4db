"""Vendor sheets, pushes of vendors, glyphs to words, calls of an extractor, and texts that people read."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages
from ..operators import batches, glyphs, replies
from ..sources import vendors
from ..streaming import pushes
from . import views
from .registry import query
from .views import over

col = F.col

#: A sheet's cells by header, as SQL of both engines.
_CELLS = {
    "forwading  no": "CASE WHEN id % 13 = 0 THEN ' ' WHEN id % 5 = 0 THEN 'F' || CAST(id % 50 AS STRING) ELSE 'T' || CAST(id AS STRING) END",
    "AWBNo": "CASE WHEN id % 9 = 0 THEN 'T' || CAST(id + 1 AS STRING) END",
    "Booking Date": "CASE WHEN id % 2 = 0 THEN '3/12/1998' ELSE 'soon' END",
    "Shipper Name": "'S ' || to_name",
    "Consignee Name": "CASE WHEN id % 17 = 0 THEN '' ELSE ' ' || to_name || ' ' END",
    "Destination Country": "to_country",
    "Chargeable Weight": "CAST(id % 100 AS STRING) || '.5 kg'",
    "Total No of Items": "CASE WHEN id % 3 = 0 THEN '2' END",
    "Dimensions": "CASE WHEN id % 3 = 1 THEN '1*2*3*4=5; 1*1*1*2=1' END",
    "value": "'1,' || CAST(100 + id % 900 AS STRING)",
    "Shipment_Value": "'7'",
    "Origin": "'MAA'",
    "MODE": "'Air'",
}


def _sheet(spark: SparkSession, d: str, vendor: str) -> DataFrame:
    cells = F.map_from_arrays(F.array(*(F.lit(h) for h in _CELLS)), F.array(*(F.expr(e) for e in _CELLS.values())))
    mapped = vendors.mapped(views.shipments(spark, d).select("id", cells.alias("cells")), vendor)
    return mapped.select("id", *(c.alias(n) for n, c in vendors.shipment_columns().items()))


_CELL_SQL = ", ".join(f"nullif(trim({e}), '') AS \"{h}\"" for h, e in _CELLS.items())
_RECORD_SQL = """SELECT id, "forwading  no" AS carrier_tracking_number, "AWBNo" AS awb_number, "Consignee Name" AS to_name, 'MAA' AS from_city, "Destination Country" AS to_country,
 CASE id % 3 WHEN 0 THEN 2.0e0 WHEN 1 THEN 6.0e0 ELSE 1.0e0 END AS pieces, id % 100 + 0.5e0 AS actual_weight, 1100.0e0 + id % 900 AS declared_value, CASE WHEN id % 2 = 0 THEN '1998-12-03' ELSE 'soon' END AS ship_date,
 'Air' AS service_type, 'INR' AS currency, '{"vendor":"World First","service_name":null,"currency_code":null,"origin":"MAA","customer_name":null,"mode":"Air","client_reference":null,"source":"excel_import"}' AS carrier_specific"""


@query(over("shipments", sql=f"{_RECORD_SQL} FROM (SELECT id, {_CELL_SQL} FROM shipments)"))
def fn_ship_record(spark: SparkSession, d: str) -> DataFrame:
    return _sheet(spark, d, "World First").select("id", "carrier_tracking_number", "awb_number", "to_name", "from_city", "to_country", "pieces", "actual_weight", "declared_value", "ship_date", "service_type", "currency", "carrier_specific")


@query(over("shipments", sql="SELECT id, 7.0e0 AS declared_value, CAST(NULL AS STRING) AS from_city, CAST(NULL AS STRING) AS service_type, CASE id % 4 WHEN 0 THEN 'ICL' WHEN 1 THEN 'World First' WHEN 2 THEN 'World First' END AS vendor FROM shipments"))
def fn_vendor_map(spark: SparkSession, d: str) -> DataFrame:
    named = vendors.resolve(F.expr("CASE id % 4 WHEN 0 THEN ' I C L' WHEN 1 THEN 'World First' WHEN 2 THEN 'WF' WHEN 3 THEN 'other' END"))
    return _sheet(spark, d, "ICL").select("id", "declared_value", "from_city", "service_type", named.alias("vendor"))


_CLASSES = f"""sheet AS (SELECT id, "forwading  no" AS t, "AWBNo" AS awb, "Consignee Name" AS c FROM (SELECT id, {_CELL_SQL} FROM shipments)),
 ok AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY id) AS nth FROM sheet WHERE t IS NOT NULL AND c IS NOT NULL),
 brought AS (SELECT awb, min(id) AS first FROM ok WHERE nth = 1 AND t <> 'F10' AND awb IS NOT NULL GROUP BY awb),
 told AS (SELECT ok.id, CASE WHEN nth > 1 OR t = 'F10' OR first < ok.id THEN 'duplicate' ELSE 'imported' END AS outcome FROM ok LEFT JOIN brought ON brought.awb = ok.t),
 outcomes AS (SELECT sheet.id, coalesce(outcome, 'invalid') AS outcome FROM sheet LEFT JOIN told USING (id))"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    known = spark.range(1).select(F.lit("F10").alias("carrier_tracking_number"), F.lit(None).cast("string").alias("awb_number"), col("id"))
    return vendors.classified(_sheet(spark, d, "World First"), known, "id")


@query(over("shipments", sql=f", {_CLASSES} SELECT id, outcome FROM outcomes"))
def win_import_outcome(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("id", "outcome")


@query(over("shipments", sql=f", {_CLASSES} SELECT count(*) AS rows_read, count_if(outcome = 'imported') AS imported, count_if(outcome = 'duplicate') AS duplicate, count_if(outcome = 'invalid') AS invalid FROM outcomes"))
def agg_import_summary(spark: SparkSession, d: str) -> DataFrame:
    return vendors.summary(_classified(spark, d))


_EVENT = "CASE id % 3 WHEN 0 THEN 'shipment_delivered' WHEN 1 THEN 'exception_detected' ELSE 'unknown' END"


@query(over("shipments", sql="""SELECT id, CASE id % 3 WHEN 0 THEN 'Good news! Shipment ' || ge_tracking_number || ' was delivered' || CASE WHEN from_city <> '' THEN ' at ' || from_city ELSE '' END || ' on ' || ship_date || '.'
 WHEN 1 THEN 'An exception was reported for shipment ' || ge_tracking_number || ': please check the tracking page for details.' END AS body FROM shipments"""))
def fn_template(spark: SparkSession, d: str) -> DataFrame:
    told = messages.message(F.expr(_EVENT), {"number": col("ge_tracking_number"), "location": col("from_city"), "delivered_at": col("ship_date")}, "Parcels")
    return views.shipments(spark, d).select("id", told["body"].alias("body"))


@query(over("shipments", sql="""SELECT id, CASE WHEN id % 2 = 0 THEN to_name || chr(10) || '1 ROAD' || chr(10) || to_city || CASE WHEN to_country <> '' THEN chr(10) || upper(to_country) ELSE '' END
  ELSE to_name || ' • ' || to_name || ' • ' || to_city || CASE WHEN to_country <> '' THEN ' • ' || to_country ELSE '' END END AS party,
 CASE WHEN from_city = '' THEN 'Chennai' ELSE from_city END || ', India' AS origin, to_city || ', ' || CASE WHEN to_country = '' THEN '—' ELSE to_country END AS destination FROM shipments"""))
def fn_waybill_view(spark: SparkSession, d: str) -> DataFrame:
    none, address = F.lit(None).cast("string"), F.when(col("id") % 2 == 0, "1 ROAD")
    box = messages.party(col("to_name"), none, col("to_name"), address, col("to_city"), none, col("to_country"), F.lit(" "), none)
    return views.shipments(spark, d).select(
        "id", box.alias("party"), messages.place_cell(none, col("from_city"), none, "Chennai", "India").alias("origin"), messages.place_cell(F.lit(""), col("to_city"), col("to_country")).alias("destination")
    )


@query(over("tracking_events", sql="""SELECT ge_tracking_number AS number, CASE WHEN status = 'Delivered' THEN 'Delivered' WHEN status = 'Exception' THEN 'Exception' ELSE status END AS current,
 location IS NOT NULL AS located, trim(coalesce(location, '')) AS last_location, 2 AS n_events FROM tracking_events WHERE provider = 'B' AND id % 7 <> 0"""))
def src_webhook(spark: SparkSession, d: str) -> DataFrame:
    """Vendor B's lines, written from the events (newest first) and read back oldest first."""
    event = lambda place: F.struct(F.lit("2024-01-01T00:00:00Z").alias("time_iso"), F.lit(" moved ").alias("description"), place.alias("location"))
    told = F.array(F.struct(F.array(event(col("location")), event(F.lit("FIRST"))).alias("events")))
    info = F.struct(F.struct(col("status").alias("status")).alias("latest_status"), F.struct(told.alias("providers")).alias("tracking"))
    kind = F.when(col("id") % 7 == 0, "TRACKING_STOPPED").otherwise("TRACKING_UPDATED")
    line = F.to_json(F.struct(kind.alias("event"), F.struct(col("ge_tracking_number").alias("number"), info.alias("track_info")).alias("data")))
    lines = views.tracking_events(spark, d).where("provider = 'B'").select(line.alias("value"))
    last = col("events")[1]["location"]
    return pushes.payloads(lines, "B").select("number", "current", (last != "").alias("located"), last.alias("last_location"), F.size("events").alias("n_events"))


@query("SELECT doc, y0, unnest(regexp_extract_all(chunk, '[^ ]+')) AS text FROM (SELECT p_partkey AS doc, k * 20.0e0 AS y0, substr(p_name, k * 16 + 1, 16) AS chunk FROM (SELECT *, unnest(range(0, 1 + length(p_name) // 16)) AS k FROM part))")
def src_pdf_words(spark: SparkSession, d: str) -> DataFrame:
    """Names as glyphs in lines of 16, every third one drawn twice, and read as words again."""
    letters = views.read(spark, d, "part").select(col("p_partkey").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("p_name", "")).alias("seq", "text")).where("text <> ''")
    x, top = (col("seq") % 16 * 6).cast("double"), (F.floor(col("seq") / 16) * 20).cast("double")
    placed = letters.withColumns({"x0": x, "top": top, "x1": x + 6, "bottom": top + 10})
    again = placed.where("seq % 3 = 0").withColumns({"seq": col("seq") + 1000, "x0": col("x0") + 0.01})
    return glyphs.words(placed.unionByName(again)).select("doc", "y0", "text")


def _shout(texts: list[str]) -> list[str]:
    if any("7" in t for t in texts):
        raise ValueError("no sevens")
    return [t.upper() for t in texts]


@query(over("shipments", sql="SELECT id, CASE WHEN contains(to_name, '7') OR id % 6 = 0 THEN NULL ELSE upper(to_name) END AS reply FROM shipments"))
def tx_llm_batch(spark: SparkSession, d: str) -> DataFrame:
    """An extractor that fails on some texts: their calls go one by one, and only they have no reply."""
    text = F.when(col("id") % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "to_name"))
    return batches.extracted(views.shipments(spark, d).select("id", text.alias("text")), _shout)


def _replied(texts: list[str]) -> list[str]:
    """An extractor's JSON in all its forms; it gives up on texts of one kind."""
    found = []
    for number, city in (t.split("|") for t in texts):
        n = int(number)
        if n % 6 == 5:
            raise ValueError("refused")
        record = {"to_name": f" R {city} ", "to_city": city if n % 4 else "N/A", "pieces": f"{n % 9} pcs" if n % 2 else n % 9 + 0.5, "actual_weight": f"1,{n % 900 + 100}.5 kg", "currency": None, "carrier_specific": {"dhl": {"n": n % 3}}}
        whole = json.dumps(record)
        found.append({0: f"```json\n{whole}\n```", 1: whole[:-9], 2: f"[{whole}, 5]", 3: '{"to_name": 7}', 4: '"nothing"'}[n % 6])
    return found


@query(over("shipments", sql="""SELECT id, id % 6 IN (0, 2, 3, 4) AS from_reply, CASE id % 6 WHEN 0 THEN 'R ' || to_city WHEN 2 THEN 'R ' || to_city WHEN 3 THEN '7' WHEN 4 THEN NULL ELSE to_name END AS to_name,
 CASE WHEN id % 6 IN (0, 2) THEN CASE WHEN id % 4 > 0 THEN to_city END WHEN id % 6 IN (3, 4) THEN NULL ELSE 'P' END AS to_city,
 CASE WHEN id % 6 IN (0, 2) THEN id % 9 + 1 ELSE 1 END AS pieces, CASE WHEN id % 6 IN (0, 2) THEN CAST('1' || CAST(id % 900 + 100 AS STRING) || '.5' AS DOUBLE) WHEN id % 6 IN (1, 5) THEN 2e0 END AS actual_weight,
 CASE WHEN id % 6 IN (1, 5) THEN 'USD' ELSE 'INR' END AS currency, CASE WHEN id % 6 IN (0, 2) THEN '{"dhl":{"n":' || id % 3 || '}}' END AS carrier_specific FROM shipments"""))
def tx_llm_fields(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are fenced, broken, lists, short, no records or missing: fields of what can be read, else the patterns'."""
    rows = views.shipments(spark, d, "id", "to_name", "to_city")
    texts = rows.select("id", F.concat_ws("|", "id", "to_city").alias("text"))
    read = rows.select("id", "to_name", F.lit("P").alias("to_city"), F.lit(1).alias("pieces"), F.lit(2.0).alias("actual_weight"), F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("carrier_specific"))
    return replies.answered(read, batches.extracted(texts, _replied)).select("id", "from_reply", "to_name", "to_city", "pieces", "actual_weight", "currency", "carrier_specific")


@query(over("shipments", sql="""SELECT id, CASE id % 5 WHEN 0 THEN 'Your shipment ' || ge_tracking_number || ' has been delivered' WHEN 1 THEN 'Action needed: shipment ' || ge_tracking_number || ' has an exception'
 WHEN 2 THEN 'Bulk upload complete — ' || id % 7 || ' imported, ' || pieces || ' skipped' WHEN 3 THEN 'Your Parcels password was reset' END AS subject,
 CASE id % 5 WHEN 0 THEN 'Good news! Shipment ' || ge_tracking_number || ' was delivered on today.' WHEN 1 THEN 'An exception was reported for shipment ' || ge_tracking_number || ': held in ' || to_city
 WHEN 2 THEN 'Your bulk upload job #' || id || ' finished. ' || id % 7 || ' shipment(s) were imported successfully, ' || pieces || ' were skipped (see the import queue for details).'
 WHEN 3 THEN 'Your password was reset by an administrator. ' || CASE WHEN id % 2 = 0 THEN 'You will be asked to set a new password on next login.' ELSE '' END END AS body FROM shipments"""))
def fn_template_all(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and bodies of all four events, and of one that nobody is told."""
    event = F.element_at(F.array(*map(F.lit, ("shipment_delivered", "exception_detected", "bulk_upload_completed", "password_reset", "other"))), (col("id") % 5 + 1).cast("int"))
    context = {"number": col("ge_tracking_number"), "detail": F.concat(F.lit("held in "), "to_city"), "imported": col("id") % 7, "skipped": col("pieces"), "job": col("id"), "must_change": F.when(col("id") % 2 == 0, "1")}
    told = messages.message(event, context, "Parcels")
    return views.shipments(spark, d, "id", "ge_tracking_number", "to_city", "pieces").select("id", told["subject"].alias("subject"), told["body"].alias("body"))


@query(over("shipments", sql="""SELECT id, CASE WHEN id % 3 = 0 THEN '—' WHEN id % 3 = 1 THEN id % 50 || '.5 lb' ELSE id % 50 || ' kg' END AS weight,
 CASE WHEN id % 4 = 0 THEN '—' ELSE CASE WHEN id % 2 = 0 THEN 'USD' ELSE 'INR' END || ' 1,' || lpad(CAST(id % 1000 AS STRING), 3, '0') || CASE WHEN id % 4 = 1 THEN '.25' ELSE '' END END AS value FROM shipments"""))
def fn_fmt_cells(spark: SparkSession, d: str) -> DataFrame:
    """Weights and values as a waybill shows them, with what stands for none."""
    n = (col("id") % 50).cast("double")
    weight = messages.weight_cell(F.when(col("id") % 3 == 1, n + 0.5), F.when(col("id") % 3 > 0, n), F.when(col("id") % 3 == 1, "lb").otherwise(" "))
    value = F.when(col("id") % 4 > 0, 1000.0 + col("id") % 1000 + F.when(col("id") % 4 == 1, 0.25).otherwise(0.0))
    return views.shipments(spark, d, "id").select("id", weight.alias("weight"), messages.value_cell(value, F.when(col("id") % 2 == 0, "USD")).alias("value"))


@query(over("users", sql="""SELECT id, CASE id % 4 WHEN 0 THEN 'Must be at least 10 characters|Must contain an uppercase letter|Must contain a number|Must contain a symbol' WHEN 1 THEN 'Must contain a symbol' WHEN 2 THEN ''
 ELSE 'Must be at least 10 characters|Must contain an uppercase letter|Must contain a lowercase letter|Must contain a number|Must contain a symbol' END AS errors, id % 5 > 2 AND id % 5 < 4 AS expired FROM users"""))
def fn_password_policy(spark: SparkSession, d: str) -> DataFrame:
    """What passwords lack, and which are older than 90 days."""
    password = F.element_at(F.array(F.lit("abc"), F.concat(F.lit("Longenough"), "id"), F.concat(F.lit("Long-enough"), "id"), F.lit(None).cast("string")), (col("id") % 4 + 1).cast("int"))
    changed = F.element_at(F.array(*(F.lit(t).cast("timestamp") for t in ("2024-04-01", "2024-03-01", "2024-01-02", "2024-01-01", None))), (col("id") % 5 + 1).cast("int"))
    now = F.lit("2024-03-31 00:00:01").cast("timestamp")
    return views.users(spark, d).select("id", F.array_join(messages.password_errors(password), "|").alias("errors"), messages.expired(changed, now).alias("expired"))
