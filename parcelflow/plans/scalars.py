"""Scalar rules over whole tables: carriers, validation, values, label text and page layout."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import carriers, labels, validation, values
from ..operators import layout, listings, waybills
from . import views
from .registry import query
from .views import ORDERS_NOW, over

col = F.col


def _cases(formats, subject: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p.replace(chr(92) + 'd', '[0-9]')}') THEN '{n}'" for n, p in formats) + " END"


@query(over("shipments", sql=f"SELECT id, {_cases(carriers.FORMATS, 'carrier_tracking_number')} AS detected, {_cases(carriers.GUESSES, 'upper(trim(carrier_tracking_number))')} AS guessed FROM shipments"))
def fn_detect_carrier(spark: SparkSession, d: str) -> DataFrame:
    number = col("carrier_tracking_number")
    return views.shipments(spark, d).select("id", carriers.detect_carrier(number).alias("detected"), carriers.guess_carrier(number).alias("guessed"))


_A = "CASE id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'transit' WHEN 2 THEN 'pickup' WHEN 3 THEN 'delivered' WHEN 4 THEN 'lost at sea' END"


@query(over("shipments", sql=f"""SELECT id, CASE coalesce({_A}, '') WHEN '' THEN 'Information Received' WHEN 'pending' THEN 'Information Received' WHEN 'transit' THEN 'In Transit'
 WHEN 'pickup' THEN 'Out for Delivery' WHEN 'delivered' THEN 'Delivered' ELSE {_A} END AS mapped FROM shipments"""))
def fn_map_status(spark: SparkSession, d: str) -> DataFrame:
    return views.shipments(spark, d).select("id", carriers.map_status(F.expr(_A), carriers.STATUSES_A).alias("mapped"))


@query(over("shipments", sql=f""", n AS (SELECT unnest([carrier_tracking_number, awb_number]) AS number, id FROM shipments),
 firsts AS (SELECT number, min(id) AS first FROM n WHERE number IS NOT NULL GROUP BY number),
 checked AS (SELECT id, carrier_tracking_number AS number, carrier, to_country, actual_weight, service_type, coalesce(first < id, false) AS duplicate,
  coalesce(nullif(carrier, ''), {_cases(carriers.FORMATS, 'carrier_tracking_number')}) AS detected,
  CASE carrier {' '.join(f"WHEN '{n}' THEN regexp_matches(carrier_tracking_number, '{p.replace(chr(92) + 'd', '[0-9]')}')" for n, p in carriers.FORMATS)} ELSE true END AS fits
  FROM shipments LEFT JOIN firsts ON number = carrier_tracking_number)
SELECT id, detected,
 concat_ws('; ', CASE WHEN length(coalesce(number, '')) < 6 THEN 'AWB number missing or too short' WHEN carrier IS NOT NULL AND NOT fits THEN 'AWB does not match expected ' || carrier || ' format' END,
  CASE WHEN duplicate THEN 'Duplicate AWB / tracking number already exists in system' END,
  CASE WHEN actual_weight <= 0 OR actual_weight > 1000 THEN 'Weight out of plausible range (0–1000 kg)' END) AS errors,
 concat_ws('; ', CASE WHEN length(coalesce(number, '')) >= 6 AND detected IS NULL THEN 'Unrecognized AWB format — carrier could not be auto-detected' END,
  CASE WHEN to_country <> '' THEN '"' || to_country || '" is not a recognized country name' END,
  CASE WHEN service_type IS NULL THEN 'Service type not detected' END) AS warnings FROM checked"""))
def fn_validate_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order of id: a number that an earlier row has is a duplicate. Numbers are joined, not looked up."""
    shipments = views.shipments(spark, d)
    firsts = listings.numbers(shipments).groupBy(col("number").alias("carrier_tracking_number")).agg(F.min("id").alias("first"))
    joined = shipments.join(firsts, "carrier_tracking_number", "left")
    duplicate = F.coalesce(col("first") < col("id"), F.lit(False))
    checked = validation.validate(col("carrier_tracking_number"), col("carrier"), col("to_country"), col("actual_weight"), col("service_type"), duplicate)
    return joined.select("id", checked.alias("v")).select("id", col("v.detected_carrier").alias("detected"), F.array_join("v.errors", "; ").alias("errors"), F.array_join("v.warnings", "; ").alias("warnings"))


_CHECKED = {
    "from_country": "CASE WHEN id % 2 = 0 THEN 'UK' ELSE 'Atlantis' END",
    "from_postal": "CASE WHEN id % 3 = 0 THEN 'SW1A 1AA' WHEN id % 3 = 1 THEN 'SW' || CAST(id AS STRING) END",
    "from_contact": "CASE WHEN id % 5 = 0 THEN NULL ELSE '+' || CAST(id AS STRING) || '-5' END",
    "to_country": "CASE WHEN id % 4 = 0 THEN NULL ELSE 'India' END",
    "to_postal": "CAST(100000 + id * 7 AS STRING)",
    "to_contact": "CAST(id * 900001 AS STRING)",
    "from_name": "CASE WHEN id % 31 = 0 THEN lower(to_name) WHEN id % 31 = 1 THEN '' ELSE 'S' END",
    "to_name": "to_name",
    "actual_weight": "CASE WHEN id % 50 = 0 THEN 0.001e0 WHEN id % 50 = 1 THEN 1200.5e0 ELSE actual_weight END",
    "billing_weight": "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 20 AS DOUBLE) END",
    "pieces": "CASE WHEN id % 40 = 0 THEN -1 WHEN id % 40 = 1 THEN 101 ELSE pieces END",
    "declared_value": "CASE WHEN id % 60 = 0 THEN 0.0e0 WHEN id % 60 = 1 THEN 10000000.5e0 ELSE declared_value END",
    "ship_date": "CASE WHEN id % 70 = 0 THEN 'soon' WHEN id % 70 = 1 THEN '2001-12-31' ELSE ship_date END",
}


@query(over("shipments", sql=f"""SELECT id, concat_ws(';',
 CASE WHEN from_country = 'UK' AND NOT regexp_matches(from_postal, '^[A-Za-z]{{1,2}}[0-9][A-Za-z0-9]?\\s?[0-9][A-Za-z]{{2}}$') THEN 'from_postal:flag:"' || from_postal || '" doesn''t look like a UK postal code (expected e.g. SW1A 1AA)' END,
 CASE WHEN to_country = 'India' AND NOT regexp_matches(to_postal, '^[0-9]{{6}}$') THEN 'to_postal:flag:"' || to_postal || '" doesn''t look like a India postal code (expected 6 digits)' END,
 CASE WHEN from_country = 'UK' AND length(from_digits) NOT BETWEEN 10 AND 12 THEN 'from_contact:warn:"' || from_contact || '" has ' || length(from_digits) || ' digits — unusual for a UK phone number (expected 10-12)' END,
 CASE WHEN to_country = 'India' AND length(to_contact) NOT BETWEEN 10 AND 12 THEN 'to_contact:warn:"' || to_contact || '" has ' || length(to_contact) || ' digits — unusual for a India phone number (expected 10-12)' END,
 CASE WHEN actual_weight > 1000 THEN 'actual_weight:flag:' || actual_weight || 'kg is unusually heavy for a parcel — check for a misplaced decimal' WHEN actual_weight < 0.01 THEN 'actual_weight:flag:' || actual_weight || 'kg is implausibly light — check the unit/decimal' END,
 CASE WHEN billing_weight > 0 AND actual_weight / billing_weight > 3 THEN 'billing_weight:warn:Billing weight (' || billing_weight || 'kg) is much lower than actual weight (' || actual_weight || 'kg)' END,
 CASE WHEN pieces <= 0 THEN 'pieces:flag:' || pieces || ' pieces isn''t valid — expected a positive integer' WHEN pieces > 100 THEN 'pieces:warn:' || pieces || ' pieces is unusually high — check for a misread' END,
 CASE WHEN declared_value <= 0 THEN 'declared_value:flag:Declared value ' || declared_value || ' isn''t valid — expected a positive amount' WHEN declared_value > 10000000 THEN 'declared_value:warn:Declared value ' || declared_value || ' is unusually high — check for a misplaced decimal' END,
 CASE WHEN ship_date = 'soon' THEN 'ship_date:flag:"soon" doesn''t look like a valid date' WHEN TRY_CAST(ship_date AS DATE) > DATE '{ORDERS_NOW}' + 14 THEN 'ship_date:warn:"' || ship_date || '" is more than 2 weeks in the future — check for a misread'
  WHEN TRY_CAST(ship_date AS DATE) < DATE '{ORDERS_NOW}' - 3650 THEN 'ship_date:warn:"' || ship_date || '" is more than 10 years old — check for a misread (e.g. 2-digit year)' END,
 CASE WHEN from_name <> '' AND upper(from_name) = upper(to_name) THEN 'to_name:flag:Sender and receiver names are identical — likely a mis-extraction' END) AS findings
FROM (SELECT *, regexp_replace(from_contact, '[^0-9]', '', 'g') AS from_digits FROM (SELECT id, {", ".join(f"{e} AS {c}" for c, e in _CHECKED.items())} FROM shipments))"""))
def fn_sanity(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d).select("id", *(F.expr(e).alias(c) for c, e in _CHECKED.items()))
    found = validation.sanity(F.lit(ORDERS_NOW).cast("date"), {c: col(c) for c in _CHECKED})
    return rows.select("id", F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["field"], x["severity"], x["message"])), ";").alias("findings"))


@query(over("shipments", sql="""SELECT id, TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)'), '') AS DOUBLE) AS number,
 strftime(created_at, '%Y-%m-%d') AS iso, coalesce(nullif(regexp_replace(regexp_replace(raw, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'file') AS name
FROM (SELECT *, CASE id % 4 WHEN 0 THEN '1,2' || CAST(id AS STRING) || '.5kg' WHEN 1 THEN ' -3.' || CAST(id AS STRING) WHEN 2 THEN 'kg ' || CAST(id AS STRING) ELSE ' /() ' END AS raw FROM shipments)"""))
def fn_values(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE id % 4 WHEN 0 THEN '1,2' || CAST(id AS STRING) || '.5kg' WHEN 1 THEN ' -3.' || CAST(id AS STRING) WHEN 2 THEN 'kg ' || CAST(id AS STRING) ELSE ' /() ' END")
    return views.shipments(spark, d).select("id", values.to_number(raw).alias("number"), values.to_iso_date(F.date_format("created_at", "d/M/yyyy")).alias("iso"), values.safe_filename(raw).alias("name"))


@query(over("shipments", sql="SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 5 + 2 END AS pieces, CASE WHEN id % 3 = 0 THEN 0 ELSE 2 END AS groups FROM shipments"))
def fn_parse_dims(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(col("id") % 3 == 0, "n/a").otherwise(F.concat(F.lit("10*20.5 * 3*"), (col("id") % 5).cast("string"), F.lit("=1.5, 4*5*6*2=7")))
    return views.shipments(spark, d).select("id", values.pieces_of(raw).alias("pieces"), F.size(values.dimension_groups(raw)).alias("groups"))


@query(over("shipments", sql="""SELECT id, substr(upper(regexp_replace(to_name, '[^A-Za-z]', '', 'g')), 1, 8) AS code, sha256(coalesce(carrier_tracking_number, '') || '/key') AS hash,
 greatest(1, least(10, coalesce(TRY_CAST(service_type AS INT), 5))) AS clamped, 'https://example.org/track?id=' || ge_tracking_number AS url,
 'GE' || CAST(1000000 + (id * 7368787 + 12345) % 9000000 AS STRING) AS number, array_to_string(list_filter(list_transform(string_split('a, ' || coalesce(carrier, '') || ',,b ', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM shipments"""))
def fn_texts(spark: SparkSession, d: str) -> DataFrame:
    listed = values.split_list(F.concat(F.lit("a, "), F.coalesce("carrier", F.lit("")), F.lit(",,b ")))
    return views.shipments(spark, d).select(
        "id", values.carrier_code(col("to_name")).alias("code"), F.sha2(F.concat(F.coalesce("carrier_tracking_number", F.lit("")), F.lit("/key")), 256).alias("hash"), values.clamp(col("service_type"), 5, 1, 10).alias("clamped"),
        F.concat(F.lit("https://example.org/track?id="), F.url_encode("ge_tracking_number")).alias("url"), values.shipment_number(col("id")).alias("number"), F.array_join(listed, "|").alias("parts"),
    )


@query(over("shipments", sql="""SELECT id, round(100.0e0 * ((carrier IS NOT NULL)::INT + (carrier_tracking_number IS NOT NULL)::INT + (from_city <> '')::INT + (to_country <> '')::INT + (service_type IS NOT NULL)::INT + (actual_weight IS NOT NULL)::INT) / 6, 1) AS score FROM shipments"""))
def agg_field_score(spark: SparkSession, d: str) -> DataFrame:
    held = [col(c) for c in ("carrier", "carrier_tracking_number", "from_city", "to_country", "service_type", "actual_weight")]
    return views.shipments(spark, d).select("id", values.field_score(held).alias("score"))


_N = "lpad(CAST(id AS STRING), 10, '0')"
_LABEL = f"""CASE id % 3
 WHEN 0 THEN 'EXPRESS WORLDWIDE' || chr(10) || 'Date: ' || ship_date || chr(10) || 'WAYBILL ' || substr({_N}, 1, 2) || ' ' || substr({_N}, 3, 4) || ' ' || substr({_N}, 7, 4) || chr(10) || CAST(weight10 AS STRING) || '.50 kg 1/' || CAST(pieces AS STRING) || chr(10) || 'Custom Val: ' || CAST(worth AS STRING) || ' INR'
 WHEN 1 THEN 'SHIP DATE: ' || ship_date || chr(10) || 'ACTWGT: ' || CAST(weight10 AS STRING) || '.50 KG' || chr(10) || 'TRK# ' || substr('00' || {_N}, 1, 4) || ' ' || substr('00' || {_N}, 5, 4) || ' ' || substr('00' || {_N}, 9, 4) || chr(10) || '1 OF ' || CAST(pieces AS STRING) || chr(10) || 'Declared Value=' || CAST(worth AS STRING) || ' USD'
 ELSE 'UPS SAVER' || chr(10) || 'DATE: ' || ship_date || chr(10) || 'SHP WT: ' || CAST(weight10 AS STRING) || '.50 KG' || chr(10) || '1 OF ' || CAST(pieces AS STRING) || chr(10) || 'TRACKING #: 1Z 123 456 ' || {_N} || chr(10) || 'Declared Value=' || CAST(worth AS STRING) || chr(10) || 'Conditions of carriage 9/9 1/9' END"""
_LABELLED = "SELECT id, ship_date, pieces, CAST(declared_value AS BIGINT) AS worth, id % 90 AS weight10 FROM shipments"


@query(over("shipments", sql=f"""SELECT id, CASE id % 3 WHEN 0 THEN 'DHL' WHEN 1 THEN 'FedEx' ELSE 'UPS' END AS carrier,
 CASE id % 3 WHEN 0 THEN {_N} WHEN 1 THEN '00' || {_N} ELSE '1Z123456' || {_N} END AS tracking, weight10 + 0.5e0 AS weight, CAST(worth AS DOUBLE) AS value, CAST(pieces AS INT) AS pieces, ship_date
FROM ({_LABELLED.replace('CAST(declared_value AS BIGINT)', 'CAST(floor(declared_value) AS BIGINT)')})"""))
def tx_labels(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: labels of three layouts, written from the columns and read back."""
    rows = views.shipments(spark, d, "id", "ship_date", "pieces", "declared_value").select("id", "ship_date", "pieces", F.floor("declared_value").alias("worth"), (col("id") % 90).alias("weight10"))
    names = {"carrier": "carrier", "carrier_tracking_number": "tracking", "actual_weight": "weight", "declared_value": "value", "pieces": "pieces", "ship_date": "ship_date"}
    text = rows.select("id", F.expr(_LABEL).alias("text")).repartition(2 * spark.sparkContext.defaultParallelism)
    return waybills.label_fields(text).select("id", *(col(c).alias(n) for c, n in names.items()))


@query(over("shipments", sql="""SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE '123456789' || CAST(10 + id % 90 AS STRING) END AS barcode,
 '+9715' || lpad(CAST(id % 1000000 AS STRING), 8, '6') || ',' || CAST(44 + id % 9 AS STRING) || lpad(CAST(id % 1000000 AS STRING), 7, '7') || ',4165550100' AS phones FROM shipments"""))
def tx_barcode_phones(spark: SparkSession, d: str) -> DataFrame:
    bars = F.when(col("id") % 4 != 0, F.concat(F.lit("*12345678* *123456789"), (10 + col("id") % 90).cast("string"), F.lit("*"))).otherwise("none")
    number = lambda n, digit: F.lpad((col("id") % 1_000_000).cast("string"), n, digit)
    text = F.concat(F.lit("TEL: +971-5"), number(8, "6"), F.lit("\nPH 12-34 12345678901234567\n"), (44 + col("id") % 9).cast("string"), F.lit("-"), number(7, "7"), F.lit(" or (416) 555-0100"))
    return views.shipments(spark, d).select("id", labels.barcode(bars).alias("barcode"), F.array_join(labels.phones(text), ",").alias("phones"))


@query("""SELECT doc, 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM (
 SELECT doc, (pos - 1) // 10 AS n, string_agg(word, ' ' ORDER BY pos) AS line FROM (
  SELECT doc_id AS doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\n]+') AS words FROM documents))
 GROUP BY doc, n) GROUP BY doc""")
def ly_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Each document's words placed ten to a line, shuffled by the join of their boxes, and read in order again."""
    placed = views.read(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \n]+"), 0)).alias("pos", "word"))
    left = (col("pos") % 10 * 50).cast("double")
    top = (F.floor(col("pos") / 10) * 20).cast("double")
    boxes = placed.select(col("doc_id").alias("doc"), F.lit(1).alias("page"), col("word").alias("text"), left.alias("x0"), top.alias("y0"), (left + 49).alias("x1"), (top + 10).alias("y1"))
    return layout.reading_order(boxes)


#: 24 parts a page, in two columns of twelve rows or three of eight; half of the full pages have a long line below that
#: runs over the gutters.
_CELLS = """SELECT p_partkey // 24 AS doc, CAST(p_partkey % 24 AS INT) AS k, CASE WHEN (p_partkey // 24) % 2 = 0 THEN 12 ELSE 8 END AS n, replace(p_brand, ' ', '') || p_partkey AS word FROM part"""


@query(f"""SELECT doc, 1 AS page, string_agg(word, chr(10) ORDER BY place) AS text FROM (SELECT doc, k AS place, word FROM ({_CELLS})
 UNION ALL SELECT doc, CASE WHEN (doc % 2) = 0 THEN 11.5 ELSE 15.5 END, 'A LONG LINE OVER THE WHOLE WIDTH OF IT' FROM (SELECT doc, count(*) AS n FROM ({_CELLS}) GROUP BY doc) WHERE doc % 4 < 2 AND n = 24) GROUP BY doc""")
def ly_split_columns(spark: SparkSession, d: str) -> DataFrame:
    """Pages of two and three columns, with long lines over the gutters, read column by column."""
    cells = views.read(spark, d, "part").selectExpr("p_partkey div 24 AS doc", "CAST(p_partkey % 24 AS INT) AS k", "CASE WHEN (p_partkey div 24) % 2 = 0 THEN 12 ELSE 8 END AS n", "replace(p_brand, ' ', '') || p_partkey AS word")
    box = lambda text, x0, y0, x1: (col("doc"), F.lit(1).alias("page"), text.alias("text"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), (y0 + 10).cast("double").alias("y1"))
    left = F.floor(col("k") / col("n")) * 300
    words = cells.select(*box(col("word"), left, col("k") % col("n") * 20, left + 90))
    whole = cells.groupBy("doc", "n").count().where("count = 24 and doc % 4 < 2")
    line = F.split(F.lit("A LONG LINE OVER THE WHOLE WIDTH OF IT"), " ")
    spread = whole.select("doc", "n", F.posexplode(line).alias("i", "text"))
    step = F.when(col("n") == 12, 43).otherwise(76)
    words = words.union(spread.select(*box(col("text"), col("i") * step, col("n") * 20, col("i") * step + step - 4)))
    return layout.reading_order(words)
