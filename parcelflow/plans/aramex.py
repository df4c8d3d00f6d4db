"""Aramex waybills of three kinds, written from the columns of shipments and read back whole."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import waybills
from . import views
from .registry import query
from .views import over

_TEN = "lpad(CAST(id AS STRING), 10, '0')"
_SEVEN = "lpad(CAST(id % 10000000 AS STRING), 7, '0')"
_MONTH, _DAY = "CAST(id % 12 + 1 AS STRING)", "lpad(CAST(id % 28 + 1 AS STRING), 2, '0')"
_CITY = "upper(substr(to_city, 1, 1)) || lower(substr(to_city, 2))"


def _lines(*lines: str) -> str:
    return " || n || ".join(lines)


#: Glyph runs within lines; values with decimals, beside which the nearest line counts as contents; descriptions
#: of one and two lines; a name told once.
_THERMAL = _lines(
    "'█▐ █▌▐ ▐▌▌ █▌▐▌'", "'Parcel slip 1 of 1 ▐▐▐▐'", "'MAA'", "'*3' || " + _TEN + " || '*'", f"'Destination: Pickup Date: ' || {_MONTH} || '/' || {_DAY} || '/2026 1:00:00PM'",
    "CASE WHEN id % 2 = 0 THEN 'DXB' ELSE 'AUH' END", "'Product Group: Type: Payment:'", "'EXP PPX P'", "'Weight: ' || CAST(id % 90 AS STRING) || '.50KG Chargeable: 99.00KG'",
    "'Description:COTTON ' || to_city || ' Custom Value: ' || CASE WHEN id % 5 = 0 THEN '1,500.00' ELSE '1' || CAST(id % 900 + 100 AS STRING) END || ' USD'",
    "CASE WHEN id % 3 = 0 THEN 'Cash on delivery: Pieces:' ELSE 'FROCKS' || n || 'Cash on delivery: Pieces:' END || CAST(id % 9 + 1 AS STRING)",
    "'From:'", "'Account: 6054' || " + _SEVEN, "'SENDER ONE'", "CASE WHEN id % 4 = 0 THEN '' ELSE 'SENDER ONE ▌▌' END", "'PLOT NO ' || CAST(id % 90 AS STRING) || ', SAMPLE STREET-'",
    "'████████ ▌▌▌▌▌▌▌▌'", "'Chennai India'", "'▌▌▌▌▌▌▌▌* ████████'", "'Tel: 9177' || " + _SEVEN + " || '8'", "'▐▐▐▐▐▐▐▐8 ████████'", "'To: RECEIVER ONE ████████8 ▐▐▐▐▐▐▐▐'", "'▌▌▌▌8'",
    "'RECEIVER ONE ▐▐▐▐'", "'VILLA ' || CAST(id % 70 AS STRING) || ' , ▐▐▐▐▐▐▐▐'", "to_city || ' ROAD 5 ▌▌▌▌▌▌▌▌'", "'Dubai - ▌▌▌▌▌▌▌▌'", "'████████'", "'United Arab Emirates ▌▌▌▌▌▌▌▌'",
    "'Tel: 9715' || " + _SEVEN + " || '1 ████████'", "':Vat'", "'Mob: 9715' || " + _SEVEN + " || '1'", "'Shpr Ref: GARUDA Con Ref:'",
)
#: Every seventh has a line above the block, so its signature is missing and only what follows the barcode counts.
_CLASSIC = _lines(
    "CASE WHEN id % 7 = 0 THEN 'COPY' || n ELSE '' END || '6054' || " + _SEVEN, "'917708992856'", "'SENDER TWO +9177' || " + _SEVEN + " || '8'", "'SENDER TWO'", "'NO ' || CAST(id % 90 AS STRING) || ', SAMPLE STREET-'",
    "CASE id % 3 WHEN 0 THEN 'Chennai Tamil Nadu' WHEN 1 THEN 'Saint Ives New South Wales' ELSE 'Old Town XY' END", "'India 6000' || CAST(id % 90 + 10 AS STRING)", "'RECEIVER T'", "'6139' || " + _SEVEN + " || ' 6139' || " + _SEVEN,
    "CASE WHEN id % 2 = 0 THEN 'RECEIVER TWO' ELSE 'R' END", "CAST(id % 97 + 1 AS STRING) || ' TEST AVE -'", "'New South Wales'", _CITY, "CASE WHEN id % 4 = 0 THEN 'Ruritania' ELSE 'Australia' END || ' 2' || CAST(id % 900 + 100 AS STRING)",
    f"'03/' || {_DAY} || '/2026'", "'CONDITIONS OF CARRIAGE'", "'1. ARAMEX may refuse goods: ANYTHING AT ALL worth 99.99 EUR or 7.77 KG'", "'2. Clauses go on 01/01/1999'", "'*4' || " + _TEN + " || '*'",
    "CASE WHEN id % 2 = 0 THEN 'MAA SYD' ELSE 'XYZ QQQ' END", "CAST(id % 9 + 1 AS STRING) || ' ' || CAST(id % 90 AS STRING) || '.50 KG ' || CAST(id % 90 + 1 AS STRING) || '.00 KG'", "'BOOKS FOR ' || to_city", "'1,500.00 AUD'", "'EXP PPX'",
)
#: The grid (whose labels must not be read as the classic form), the flat form around an attention line, and one whose
#: labels are scattered on both sides of it.
_GRID = _lines(
    "'1 FROM (SHIPPER)'", "'Shipper''s Account No.'", "'60542311'", "'From (Your Name)'", "'SENDER THREE'", "'Phone Number'", "'9177' || " + _SEVEN + " || '8'", "'Street Address'", "'NO 1 SAMPLE STREET'", "'City'", "'Akkur Town'",
    "'State/Province'", "'Tamil Nadu'", "'Country'", "'India'", "'ZIP/Postal Code'", "'609301'", "'2 TO (RECEIVER)'", "'To (Receiver Name)'", "'KIND ATTN MR.THREE'", "'Company'", "'SAMPLE PLANT LLC SPC'", "'Street Address'",
    "'BOX ' || CAST(id % 90 AS STRING) || ' SAMPLE STREET'", "'City'", _CITY, "'Country'", "'United Arab Emirates'", "'*5' || " + _TEN + " || '*'", "'EXP PPX'", "'150.00 INR'", "'CALENDARS OF ' || to_city", f"'03/' || {_DAY} || '/2026'",
)
_FLAT = _lines(
    "'aramex'", "'4 FROM (SHIPPER)'", "'Shipper''s Ref.'", "'Dept/Floor No'", "'SENDER FOUR'", "'NO 2 SAMPLE STREET'", "'India 6000' || CAST(id % 90 + 10 AS STRING)", "'9177' || " + _SEVEN + " || '8'", "'KIND ATTN MS.FOUR'",
    "'FOUR TRADING LLC'", "'BOX ' || CAST(id % 90 AS STRING) || ' SAMPLE ROAD'", "'9715' || " + _SEVEN + " || '1'", "'SHIPPER SIGNS'", "'No. of Pieces ' || CAST(id % 9 + 1 AS STRING)", "'8 COST OF GOODS: NONE'", "'Customs Value'", "'BOOKS OF ' || to_city",
    "'200.00 AED'", "'Weight'", "'2.20 KG'", "'*6' || " + _TEN + " || '*'", "'India'", "'Oman'", "'MAA MCT'", "'PPX'",
)
_SCATTERED = _lines(
    "'ARAMEX'", "'City'", "'Salem Town'", "'Country'", "'India'", "'9177' || " + _SEVEN + " || '8'", "'KIND ATTN MR.FIVE'", "'SHIPPER'", "'9177' || " + _SEVEN + " || '8'", "'Company'", "'FIVE INDUSTRIES'", "'City'", _CITY, "'9715' || " + _SEVEN + " || '1'",
    "'Description of Goods/Code: Customs Value'", "'COMMODITY: TOYS FOR ' || to_city", "'52345678901 ' || CAST(id % 9 + 1 AS STRING) || ' OF 12'", "'ORG. STN MAA'", "'DEST. STN AUH'", "'75.25 and then EUR'",
)
_GENERIC = f"CASE id % 3 WHEN 0 THEN {_GRID} WHEN 1 THEN {_FLAT} ELSE {_SCATTERED} END"


def _texts(spark: SparkSession, d: str, text: str) -> DataFrame:
    """Rows are dealt to tasks by their number, however few bytes they have, before they become texts."""
    rows = views.shipments(spark, d, "id", "to_city").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.withColumn("n", F.lit("\n")).select("id", F.expr(text).alias("text"))


def _sql(expected: dict[str, str]) -> str:
    return over("shipments", sql="SELECT id, " + ", ".join(f"{e} AS {c}" for c, e in expected.items()) + " FROM shipments")


_SPECIFIC = """'{"aramex": {"ppx": ' || %s || ', "exp": ' || %s || ', "route": ' || %s || '}}'"""
_THERMAL_FIELDS = {
    "carrier": "'Aramex'", "carrier_tracking_number": "'3' || " + _TEN, "origin_code": "'MAA'", "destination_code": "CASE WHEN id % 2 = 0 THEN 'DXB' ELSE 'AUH' END",
    "ship_date": f"{_MONTH} || '/' || {_DAY} || '/2026'", "actual_weight": "id % 90 + 0.5e0", "billing_weight": "id % 90 + 0.5e0", "pieces": "CAST(id % 9 + 1 AS INT)",
    "contents": "CASE WHEN id % 5 = 0 THEN 'Weight: ' || CAST(id % 90 AS STRING) || '.50KG Chargeable: 99.00KG' ELSE 'COTTON ' || to_city || CASE WHEN id % 3 = 0 THEN '' ELSE ' FROCKS' END END", "declared_value": "CASE WHEN id % 5 = 0 THEN 500e0 ELSE CAST('1' || CAST(id % 900 + 100 AS STRING) AS DOUBLE) END", "currency": "'USD'",
    "service_type": "'Express'", "billing_type": "'Prepaid'", "account_number": "'6054' || " + _SEVEN, "from_name": "'SENDER ONE'", "from_address": "'PLOT NO ' || CAST(id % 90 AS STRING) || ', SAMPLE STREET'",
    "from_city": "'Chennai'", "from_country": "'India'", "from_contact": "'9177' || " + _SEVEN + " || '8'", "to_name": "'RECEIVER ONE'", "to_address": "'VILLA ' || CAST(id % 70 AS STRING) || ' , ' || to_city || ' ROAD 5'",
    "to_city": "'Dubai'", "to_country": "'UAE'", "to_contact": "'9715' || " + _SEVEN + " || '1'", "carrier_specific": _SPECIFIC % ("'true'", "'true'", "'\"MAA ' || CASE WHEN id % 2 = 0 THEN 'DXB' ELSE 'AUH' END || '\"'"),
}


@query(_sql(_THERMAL_FIELDS))
def tx_aramex_thermal(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: thermal labels, whose rows hold the glyphs of a barcode."""
    return waybills.records(_texts(spark, d, _THERMAL)).select("id", *_THERMAL_FIELDS)


def _signed(value: str) -> str:
    return f"CASE WHEN id % 7 <> 0 THEN {value} END"


_CLASSIC_FIELDS = {
    "carrier": "'Aramex'", "carrier_tracking_number": "'4' || " + _TEN, "account_number": _signed("'6054' || " + _SEVEN), "from_name": _signed("'SENDER TWO'"), "from_contact": _signed("'+9177' || " + _SEVEN + " || '8'"),
    "from_address": _signed("'NO ' || CAST(id % 90 AS STRING) || ', SAMPLE STREET'"), "from_city": _signed("CASE id % 3 WHEN 0 THEN 'Chennai' WHEN 1 THEN 'Saint Ives' ELSE 'Old Town' END"),
    "from_state": _signed("CASE id % 3 WHEN 0 THEN 'Tamil Nadu' WHEN 1 THEN 'New South Wales' ELSE 'XY' END"), "from_country": _signed("'India'"), "from_postal": _signed("'6000' || CAST(id % 90 + 10 AS STRING)"),
    "to_name": _signed("CASE WHEN id % 2 = 0 THEN 'RECEIVER TWO' ELSE 'RECEIVER T' END"), "to_contact": _signed("'6139' || " + _SEVEN), "to_address": _signed("CAST(id % 97 + 1 AS STRING) || ' TEST AVE'"), "to_state": _signed("'New South Wales'"),
    "to_city": _signed(_CITY), "to_country": _signed("CASE WHEN id % 4 = 0 THEN 'Ruritania' ELSE 'Australia' END"), "to_postal": _signed("'2' || CAST(id % 900 + 100 AS STRING)"), "ship_date": f"'03/' || {_DAY} || '/2026'",
    "origin_code": "CASE WHEN id % 2 = 0 THEN 'MAA' ELSE 'XYZ' END", "destination_code": "CASE WHEN id % 2 = 0 THEN 'SYD' ELSE 'QQQ' END", "pieces": "CAST(id % 9 + 1 AS INT)", "actual_weight": "id % 90 + 0.5e0",
    "billing_weight": "id % 90 + 1e0", "contents": "'BOOKS FOR ' || to_city", "declared_value": "1500e0", "currency": "'AUD'", "service_type": "'Express'",
    "carrier_specific": _SPECIFIC % ("'true'", "'true'", "'\"' || CASE WHEN id % 2 = 0 THEN 'MAA SYD' ELSE 'XYZ QQQ' END || '\"'"),
}


@query(_sql(_CLASSIC_FIELDS))
def tx_aramex_classic(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: classic forms in two blocks of lines around the conditions of carriage, and near misses."""
    return waybills.records(_texts(spark, d, _CLASSIC)).select("id", *_CLASSIC_FIELDS)


def _pick(*three: str) -> str:
    return "CASE id % 3 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(three)) + " END"


_PHONES = ("'9177' || " + _SEVEN + " || '8'", "'9715' || " + _SEVEN + " || '1'")
_GENERIC_FIELDS = {
    "carrier": "'Aramex'", "carrier_tracking_number": _pick("'5' || " + _TEN, "'6' || " + _TEN, "'52345678901'"), "ship_date": _pick(f"'03/' || {_DAY} || '/2026'", "NULL", "NULL"), "pieces": "CAST(" + _pick("1", "id % 9 + 1", "12") + " AS INT)",
    "actual_weight": _pick("NULL", "2.2e0", "NULL"), "contents": _pick("'CALENDARS OF ' || to_city", "'BOOKS OF ' || to_city", "'TOYS FOR ' || to_city"), "declared_value": _pick("150e0", "200e0", "75.25e0"),
    "currency": _pick("'INR'", "'AED'", "'EUR'"), "service_type": _pick("'Express'", "NULL", "NULL"), "billing_type": _pick("'Prepaid'", "'Prepaid'", "NULL"), "origin_code": _pick("NULL", "'MAA'", "'MAA'"),
    "destination_code": _pick("NULL", "'MCT'", "'AUH'"), "sender_company": "CAST(NULL AS STRING)", "receiver_company": _pick("'SAMPLE PLANT LLC SPC'", "'FOUR TRADING LLC'", "'FIVE INDUSTRIES'"),
    "from_name": _pick("'SENDER THREE'", "'SENDER FOUR'", "'City'"), "from_country": "'India'", "from_postal": _pick("'609301'", "'6000' || CAST(id % 90 + 10 AS STRING)", "NULL"), "from_contact": _PHONES[0],
    "to_name": _pick("'KIND ATTN MR.THREE'", "'KIND ATTN MS.FOUR'", "'KIND ATTN MR.FIVE'"), "to_city": _pick(_CITY, "'Muscat'", _CITY), "to_country": _pick("'UAE'", "'Oman'", "'United Arab Emirates'"), "to_contact": _pick("NULL", _PHONES[1], _PHONES[1]),
    "carrier_specific": _SPECIFIC % ("CASE WHEN id % 3 < 2 THEN 'true' ELSE 'false' END", "CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END", _pick("'null'", "'\"MAA MCT\"'", "'\"MAA AUH\"'")),
}


@query(_sql(_GENERIC_FIELDS))
def tx_aramex_generic(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: a grid of labels, a flat form and scattered labels, none of which is a label or a classic form."""
    return waybills.records(_texts(spark, d, _GENERIC)).select("id", *_GENERIC_FIELDS)
