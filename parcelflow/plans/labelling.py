"""Waybill text to whole records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import waybills
from . import views
from .registry import query
from .views import over

_N = "lpad(CAST(id AS STRING), 12, '0')"
_NAMED = f"""'EXPRESS WORLDWIDE' || n || 'WPX' || n || 'From : SENDER A' || n || 'SENDER A' || n || 'NO ' || CAST(id % 90 + 1 AS STRING) || ' SAMPLE STREET' || n || '600001 SAMPLETOWN' || n || 'INDIA' || n
 || 'To : Mr. RECEIVER A' || n || n || CAST(id % 97 + 1 AS STRING) || ' TEST AVE' || n || CAST(2000 + id % 7000 AS STRING) || ' ' || to_city || n || CASE WHEN id % 4 = 0 THEN 'ISRAEL' ELSE 'AUSTRALIA' END || n || 'Origin:' || n
 || 'Date: ' || ship_date || n || 'Contents: CAR PARTS,' || n || 'FOR ' || to_city || n || 'WAYBILL ' || substr({_N}, 3, 2) || ' ' || substr({_N}, 5, 4) || ' ' || substr({_N}, 9, 4) || n || CAST(id % 90 AS STRING) || '.50 KG 1/3' || n || 'Custom Val: 1,200.5 USD' || n"""
_CODED = f"""'ORIGIN ID:MAAA 0000000001' || n || 'SENDER B' || n || n || 'SENDER B' || n || 'PLOT 7' || n || 'SAMPLETOWN, TN 600001 ' || n || 'IN' || n || 'SHIP DATE: 02JAN00' || n
 || 'TO RECEIVER B' || n || 'UNIT 5' || n || to_city || ' ONTARIO K1A 0' || chr(CAST(65 + id % 26 AS INT)) || CAST(id % 10 AS STRING) || n || '(CA)' || n || '613-5550100' || n || 'ACTWGT: ' || CAST(id % 90 AS STRING) || '.50 LB' || n
 || 'TRK# ' || substr({_N}, 1, 4) || ' ' || substr({_N}, 5, 4) || ' ' || substr({_N}, 9, 4) || n || 'DESC1:THINGS' || n || 'DESC2:' || n || n || 'DESC3:MORE ' || to_city || n || '1 OF 2' || n || 'INTERNATIONAL PRIORITY'"""
_PLAIN = f"""'5 KG 1 OF 1' || n || 'SENDER C 91-9566122447' || n || '12 LONG ROAD SHP WT: 9 KG' || n || 'Salem Tamil Nadu' || n || 'India 600018' || n || 'UPS SAVER' || n
 || 'SHIP TO:' || n || 'RECEIVER C' || n || 'Dr. HELPER' || n || '9 SHORT LANE' || n || to_city || ', NSW ' || CAST(2000 + id % 7000 AS STRING) || n || 'AUSTRALIA' || n || 'BILLING: P/P' || n || 'DESC: LADIES WEAR' || n
 || 'TRACKING #: 1Z 1234 ' || {_N} || n || 'DATE: 16 MAR 2026'"""
_TEXT = f"CASE id % 3 WHEN 0 THEN {_NAMED} WHEN 1 THEN {_CODED} ELSE {_PLAIN} END"
_SHOWN = (
    "carrier carrier_tracking_number ship_date pieces actual_weight weight_unit contents service_type declared_value currency from_name from_address from_city from_state from_country from_postal "
    "from_contact to_name receiver_attention to_address to_city to_state to_country to_postal to_contact field_score"
).split()


def _pick(*three: str) -> str:
    return "CASE id % 3 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(three)) + " END"


_CITY = "upper(substr(to_city, 1, 1)) || lower(substr(to_city, 2))"
_EXPECTED = {
    "carrier": _pick("'DHL'", "'FedEx'", "'UPS'"),
    "carrier_tracking_number": _pick(f"substr({_N}, 3)", _N, f"'1Z1234' || {_N}"),
    "ship_date": _pick("ship_date", "'02JAN00'", "'16 MAR 2026'"),
    "pieces": _pick("3", "2", "1"),
    "actual_weight": _pick("id % 90 + 0.5e0", "id % 90 + 0.5e0", "9.0e0"),
    "weight_unit": _pick("'kg'", "'lb'", "'kg'"),
    "contents": _pick("'CAR PARTS FOR ' || to_city", "'THINGS; MORE ' || to_city", "'LADIES WEAR'"),
    "service_type": _pick("'Express Worldwide (WPX)'", "'International Priority'", "'UPS Saver'"),
    "declared_value": _pick("1200.5e0", "NULL", "NULL"),
    "currency": _pick("'USD'", "'INR'", "'INR'"),
    "from_name": "'SENDER ' || " + _pick("'A'", "'B'", "'C'"),
    "from_address": _pick("'NO ' || CAST(id % 90 + 1 AS STRING) || ' SAMPLE STREET'", "'PLOT 7'", "'12 LONG ROAD, Salem Tamil Nadu'"),
    "from_city": _pick("'Sampletown'", "'Sampletown'", "'Salem'"),
    "from_state": _pick("NULL", "'TN'", "'TN'"),
    "from_country": "'India'",
    "from_postal": _pick("'600001'", "'600001'", "'600018'"),
    "from_contact": _pick("NULL", "NULL", "'919566122447'"),
    "to_name": "'RECEIVER ' || " + _pick("'A'", "'B'", "'C'"),
    "receiver_attention": _pick("NULL", "NULL", "'Dr. HELPER'"),
    "to_address": _pick("CAST(id % 97 + 1 AS STRING) || ' TEST AVE'", "'UNIT 5'", "'9 SHORT LANE'"),
    "to_city": _CITY,
    "to_state": _pick("NULL", "'ON'", "'NSW'"),
    "to_country": _pick("CASE WHEN id % 4 <> 0 THEN 'Australia' END", "'Canada'", "'Australia'"),
    "to_postal": _pick("CAST(2000 + id % 7000 AS STRING)", "'K1A0' || chr(CAST(65 + id % 26 AS INT)) || CAST(id % 10 AS STRING)", "CAST(2000 + id % 7000 AS STRING)"),
    "to_contact": _pick("NULL", "'6135550100'", "NULL"),
    "field_score": "CASE WHEN id % 12 = 0 THEN 92.9e0 ELSE 100.0e0 END",
}


def waybill_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rows are dealt to tasks by their number, however few bytes they have, before they become texts."""
    rows = views.shipments(spark, d, "id", "to_city", "ship_date").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.withColumn("n", F.lit("\n")).select("id", F.expr(_TEXT).alias("text"))


@query(over("shipments", sql="SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in _EXPECTED.items()) + " FROM shipments"))
def tx_waybills(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: waybills of three layouts, written from the columns and read back whole."""
    return waybills.records(waybill_texts(spark, d)).select("id", *_SHOWN)


_LINES = "CASE id % 4 WHEN 0 THEN 'RECEIVER ' || to_city WHEN 1 THEN 'Dept/Floor' WHEN 2 THEN 'AB1' ELSE 'LONG LINEs OF TEXT' END"


@query(over("shipments", sql="SELECT id, id % 4 IN (0, 3) AS caps, round(0.7e0 * (id % 100) + 0.3e0 * 50, 1) AS confidence FROM shipments"))
def tx_caps_like(spark: SparkSession, d: str) -> DataFrame:
    ocr = (F.col("id") % 100).cast("double")
    return views.shipments(spark, d).select("id", labels.caps_like(F.expr(_LINES)).alias("caps"), labels.confidence(ocr, F.lit(50.0)).alias("confidence"))


#: Texts of no known layout: hints of two carriers, numbers between asterisks and runs of 12 and 10 digits, a telephone
#: number that is no tracking number, and weights and dates of which some are odd.
_UNKNOWN = """CASE id % 5 WHEN 0 THEN 'Sent by dtdc' || n || '*7' || lpad(CAST(id AS STRING), 9, '0') || '* and *123*' WHEN 1 THEN 'BLUE DART label' || n || 'No: 5' || lpad(CAST(id AS STRING), 11, '0') || ' end'
 WHEN 2 THEN 'call 9876543210 for' || n || 'parcel 5' || lpad(CAST(id AS STRING), 9, '0') || ' end' WHEN 3 THEN '' END
 || CASE WHEN id % 5 < 3 THEN n || 'weighs ' || CAST(id % 3 * 1000 AS STRING) || '.50 KG' || n || 'DATE: 20' || CAST(26 + id % 2 * 60 AS STRING) || '-03-01' || n || 'box 2 OF 3' || n || 'DECLARED VALUE: 0.00 EUR' ELSE '' END"""


@query(over("shipments", sql="""SELECT id, CASE id % 5 WHEN 0 THEN 'DTDC' WHEN 1 THEN 'BlueDart' END AS carrier, CASE id % 5 WHEN 0 THEN '7' || lpad(CAST(id AS STRING), 9, '0') WHEN 1 THEN '5' || lpad(CAST(id AS STRING), 11, '0') WHEN 2 THEN '5' || lpad(CAST(id AS STRING), 9, '0') END AS carrier_tracking_number,
 CASE WHEN id % 5 < 3 THEN id % 3 * 1000 + 0.5e0 END AS actual_weight, CASE WHEN id % 5 < 3 THEN 3 ELSE 1 END AS pieces, CASE WHEN id % 5 < 3 THEN 'EUR' ELSE 'INR' END AS currency,
 concat_ws(';', CASE WHEN id % 5 < 3 AND id % 3 > 0 THEN 'actual_weight:flag' END, CASE WHEN id % 5 < 3 THEN 'declared_value:flag' END, CASE WHEN id % 5 < 3 AND id % 2 = 1 THEN 'ship_date:warn' END) AS sanity,
 CASE WHEN id % 5 < 3 THEN 2 ELSE 3 END AS n_warnings, round(100.0e0 * CASE id % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END / 14, 1) AS field_score FROM shipments"""))
def tx_generic(spark: SparkSession, d: str) -> DataFrame:
    """Texts without a layout as whole records with their score, what they lack, and what looks wrong as of a day."""
    rows = views.shipments(spark, d, "id").repartition(4 * spark.sparkContext.defaultParallelism).withColumn("n", F.lit("\n")).select("id", F.expr(_UNKNOWN).alias("text"))
    found = waybills.records(rows, as_of=F.lit("2026-03-15").cast("date"))
    sanity = F.array_join(F.transform("sanity_warnings", lambda w: F.concat_ws(":", w["field"], w["severity"])), ";")
    return found.select("id", "carrier", "carrier_tracking_number", "actual_weight", "pieces", "currency", sanity.alias("sanity"), F.size("warnings").alias("n_warnings"), "field_score")
