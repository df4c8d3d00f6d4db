"""Access, accounts, settings, what the public sees, pages that were read, and exports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import work_dir
from ..functions import carriers, labels
from ..operators import accounts, choices, layout
from ..operators.listings import SEARCHED
from ..sources import exports
from . import views
from .registry import query
from .views import over

col = F.col


@query(over("shipments", sql="SELECT id, ge_tracking_number, carrier, status FROM shipments WHERE ge_tracking_number = 'GE1000007'"))
def src_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return views.shipments(spark, d, "id", "ge_tracking_number", "carrier", "status").where("ge_tracking_number = 'GE1000007'").limit(1)


@query(over("shipments", "users", sql="SELECT CASE WHEN role = 'admin' THEN NULL ELSE created_by END AS user_id, s.id FROM shipments s LEFT JOIN users u ON s.created_by = u.id"))
def join_access_check(spark: SparkSession, d: str) -> DataFrame:
    return accounts.accessible(views.shipments(spark, d, "id", "created_by"), views.users(spark, d))


_LOGINS = "SELECT username, id, created_at AS told, action <> 'ERROR' AS ok FROM audit_log WHERE action IN ('ERROR', 'SIGNUP')"


@query(over("audit_log", sql=f"""SELECT username, CASE WHEN locked_at IS NULL THEN last ELSE 3 END AS attempts, CASE WHEN locked_at IS NULL THEN 'Active' ELSE 'Locked' END AS status, locked_at + INTERVAL 15 MINUTE AS locked_until FROM (
 SELECT username, arg_max(failed, id) AS last, arg_min(told, id) FILTER (failed >= 3) AS locked_at FROM (
  SELECT *, CAST(sum((NOT ok)::INT) OVER (PARTITION BY username, run ORDER BY id) AS BIGINT) AS failed FROM (
   SELECT *, sum(ok::INT) OVER (PARTITION BY username ORDER BY id) AS run FROM ({_LOGINS}))) GROUP BY username)"""))
def fn_lockout(spark: SparkSession, d: str) -> DataFrame:
    logins = views.audit_log(spark, d).where("action in ('ERROR', 'SIGNUP')").select("username", "id", col("created_at").alias("at"), (col("action") != "ERROR").alias("ok"))
    return accounts.locked(logins, most=3)


@query("""SELECT id, name, coalesce(configs, '') AS configs FROM (SELECT n_nationkey AS id, n_name AS name FROM nation) LEFT JOIN (
 SELECT n, string_agg(k || '=' || v, ',' ORDER BY k) AS configs FROM (SELECT c_nationkey AS n, c_mktsegment AS k, CAST(max(c_custkey) AS STRING) AS v FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1, 2) GROUP BY n) ON n = id""")
def join_carrier_configs(spark: SparkSession, d: str) -> DataFrame:
    configs = views.read(spark, d, "customer").where("c_nationkey % 5 <> 0").select(col("c_nationkey").alias("carrier_id"), col("c_mktsegment").alias("config_key"), col("c_custkey").cast("string").alias("config_value"), col("c_custkey").alias("id"))
    found = accounts.with_configs(views.read(spark, d, "nation").select(col("n_nationkey").alias("id"), col("n_name").alias("name")), configs)
    pairs = F.transform(F.array_sort(F.map_entries("configs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select("id", "name", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("configs"))


@query(over("shipments", sql="SELECT id, '1' AS months, '15' AS days FROM shipments WHERE status = 'Delivered'"))
def join_setting_lookup(spark: SparkSession, d: str) -> DataFrame:
    settings = views.read(spark, d, "region").select(F.when(col("r_regionkey") == 1, "months").otherwise(col("r_name")).alias("key"), col("r_regionkey").cast("string").alias("value"))
    rows = views.shipments(spark, d, "id", "status").where("status = 'Delivered'").select("id")
    return accounts.setting(accounts.setting(rows, settings, "months", "6", "months"), settings, "warn_days", "15", "days")


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS region, s_acctbal AS priority FROM supplier ORDER BY s_nationkey, s_acctbal, s_suppkey LIMIT 40")
def top_multi_key(spark: SparkSession, d: str) -> DataFrame:
    listed = views.read(spark, d, "supplier").select(col("s_suppkey").alias("id"), col("s_name").alias("name"), col("s_nationkey").alias("region"), col("s_acctbal").alias("priority"))
    return listed.orderBy("region", "priority", "id").limit(40)


@query(over("shipments", sql="SELECT id, status, to_city, 'Parcels' AS carrier_display FROM shipments"))
def fn_sanitize_public(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d, "id", "carrier", "carrier_tracking_number", "awb_number", "status", "to_city")
    return accounts.public(rows, "Parcels")


@query(over("shipments", sql="""SELECT id, CASE carrier WHEN 'DHL' THEN 'dhl' WHEN 'FedEx' THEN 'fedex' WHEN 'UPS' THEN 'ups' WHEN 'Aramex' THEN 'aramex' WHEN 'DTDC' THEN 'dtdc' WHEN 'Delhivery' THEN 'delhivery' END AS slug,
 CASE carrier WHEN 'DHL' THEN 100001 WHEN 'FedEx' THEN 100003 WHEN 'UPS' THEN 100002 WHEN 'Aramex' THEN 100006 WHEN 'DTDC' THEN 11020 WHEN 'Delhivery' THEN 19318 END AS code, CASE WHEN id % 2 = 0 THEN NULL ELSE carrier END AS name FROM shipments"""))
def fn_map_carrier_code(spark: SparkSession, d: str) -> DataFrame:
    code = carriers.code_b(col("carrier"))
    return views.shipments(spark, d, "id", "carrier").select("id", carriers.code_a(col("carrier")).alias("slug"), code.alias("code"), carriers.name_b(F.when(col("id") % 2 == 1, code.cast("string")).otherwise("7")).alias("name"))


@query(over("shipments", sql="""SELECT id, coalesce(carrier, CASE WHEN id % 2 = 0 THEN 'TNT' END) AS carrier, CASE WHEN id % 2 = 0 THEN CAST(id % 9 AS STRING) END AS carrier_code, CASE WHEN id % 2 = 0 THEN 'A' END AS code_provider,
 CASE WHEN id % 2 = 0 THEN 1 ELSE tracking_registered END AS tracking_registered, CASE WHEN id % 2 = 0 THEN 0 ELSE manual_tracking END AS manual_tracking FROM shipments"""))
def snk_coalesce_register(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d, "id", "carrier", "tracking_registered", "manual_tracking")
    return choices.registered(rows, rows.where("id % 2 = 0").select("id", F.lit("TNT").alias("carrier"), (col("id") % 9).alias("code")), "A")


_PAGES = """SELECT o_orderkey // 8 AS doc, CAST(o_orderkey % 8 AS INT) + 1 AS page, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Weight: 5 KG' WHEN 2 THEN 'nothing' WHEN 3 THEN 'SHIP DATE 1 Origin ID'
 WHEN 4 THEN 'sender and recipient of contents' WHEN 5 THEN 'TRK# 12' ELSE 'a far longer page without any word of them' END AS text FROM orders"""
_HITS = f"list_sum(list_transform([{', '.join(repr(w) for w in choices.KNOWN_WORDS)}], lambda w: contains(lower(coalesce(text, '')), w)::INT))::INT"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    texts = {1: "Weight: 5 KG", 2: "nothing", 3: "SHIP DATE 1 Origin ID", 4: "sender and recipient of contents", 5: "TRK# 12", 6: "a far longer page without any word of them"}
    text = F.try_element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), (col("o_orderkey") % 7).cast("int"))
    return views.read(spark, d, "orders").select(F.floor(col("o_orderkey") / 8).alias("doc"), (col("o_orderkey") % 8 + 1).cast("int").alias("page"), text.alias("text"))


@query(f"SELECT doc, page, text, {_HITS} AS hits FROM ({_PAGES}) WHERE page <= 3 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY hits DESC, page) = 1")
def src_best_page(spark: SparkSession, d: str) -> DataFrame:
    return choices.best_page(_pages(spark, d))


@query(f"SELECT doc, page, text FROM ({_PAGES}) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY length(coalesce(text, '')) DESC, page) = 1")
def src_longest_page(spark: SparkSession, d: str) -> DataFrame:
    return choices.longest_page(_pages(spark, d))


@query(f"SELECT doc, page, {_HITS} AS hits, CASE WHEN length(trim(text)) >= 40 AND {_HITS} >= 2 THEN text END AS used FROM (SELECT doc, page, text || CASE WHEN page % 2 = 0 THEN '   ' ELSE ' of thirty more characters, or so' END AS text FROM ({_PAGES}))")
def src_native_usable(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).withColumn("text", F.concat("text", F.when(col("page") % 2 == 0, "   ").otherwise(" of thirty more characters, or so")))
    return pages.select("doc", "page", choices.known_word_hits(col("text")).alias("hits"), choices.usable(col("text")).alias("used"))


@query(over("shipments", "tracking_events", sql="""SELECT id, coalesce(nullif(tracking_status, ''), newest) AS current FROM shipments s
LEFT JOIN (SELECT ge_tracking_number AS g, last(status ORDER BY event_timestamp, id) AS newest FROM tracking_events GROUP BY 1) ON g = s.ge_tracking_number"""))
def win_first_match(spark: SparkSession, d: str) -> DataFrame:
    return choices.told_now(views.shipments(spark, d, "id", "ge_tracking_number", "tracking_status"), views.tracking_events(spark, d)).select("id", "current")


@query(over("shipments", sql="""SELECT id, CASE WHEN trim(coalesce(contents, '')) = '' THEN to_city ELSE contents END AS preferred, coalesce(from_city, 'x') AS given,
 CASE WHEN id % 3 = 0 THEN 'LOUD,quiet,soft' ELSE 'quiet,soft' END AS lines, CASE WHEN id % 2 = 0 THEN 'a|b ' || id ELSE '' END AS parsed FROM shipments"""))
def fn_merge_prefer_new(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d, "id", "contents", "to_city", "from_city")
    lines = F.when(col("id") % 3 == 0, F.array(F.lit("quiet"), F.lit("LOUD"), F.lit("soft"))).otherwise(F.array(F.lit("quiet"), F.lit("soft")))
    json = F.when(col("id") % 2 == 0, F.concat(F.lit('["a", "b '), col("id").cast("string"), F.lit('"]'))).when(col("id") % 3 == 0, "no json")
    sorted_lines = choices.caps_first(lines, F.transform(lines, lambda x: x == F.upper(x)))
    return rows.select("id", choices.prefer_new(col("to_city"), col("contents")).alias("preferred"), choices.prefer_given(F.lit("x"), col("from_city")).alias("given"), F.array_join(sorted_lines, ",").alias("lines"), F.array_join(choices.parsed_list(json), "|").alias("parsed"))


@query(over("shipments", sql="""SELECT id, CASE id % 3 WHEN 0 THEN '{"l":' || id % 100000 || '.0,"w":2.0,"h":3.0,"unit":"in"}' WHEN 1 THEN '{"l":' || id % 100000 || '.0,"w":20.0,"h":3.0,"unit":"cm"}' END AS dims,
 CASE WHEN id % 2 = 0 THEN 'GE/' || id % 100000 END AS invoice, 8 + length(CAST(id % 100000 AS STRING)) AS at, '9876543210' AS phone FROM shipments"""))
def tx_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """Dimensions, invoice numbers and the places of telephone numbers."""
    number = (col("id") % 100000).cast("string")
    dims = F.when(col("id") % 3 == 0, F.concat(F.lit("DIMS: "), number, F.lit(" x 2 × 3 IN"))).when(col("id") % 3 == 1, F.concat(F.lit("dwt: "), number, F.lit(" , 20,3")))
    bill = F.when(col("id") % 2 == 0, F.concat(F.lit("Inv: GE/"), number, F.lit(" x"))).otherwise("Inv: " + "9" * 40)
    phone = F.try_element_at(labels.phones_at(F.concat(F.lit("call #"), number, F.lit("; 9876543210, or 12-345"))), F.lit(1))
    return views.shipments(spark, d, "id").select("id", labels.dimensions(dims).alias("dims"), labels.invoice(bill).alias("invoice"), phone["at"].alias("at"), phone["number"].alias("phone"))


_BOXES = "SELECT p_partkey AS doc, p_name AS text, CAST(p_partkey % 3 AS INT) AS kind, CAST(p_partkey % 5 - 1 AS STRING) AS conf FROM part"


@query(f"""SELECT doc, 1 AS page, trim(text) AS text, CASE kind WHEN 2 THEN 50.0e0 ELSE 5.0e0 END AS x0, CASE kind WHEN 2 THEN 40.0e0 ELSE 2.0e0 END AS y0, CASE kind WHEN 0 THEN 9.0e0 WHEN 1 THEN 12.0e0 ELSE 100.0e0 END AS x1,
 CASE kind WHEN 0 THEN 4.0e0 WHEN 1 THEN 5.0e0 ELSE 80.0e0 END AS y1 FROM ({_BOXES}) WHERE kind <> 1 OR doc % 5 > 0""")
def ly_adapters(spark: SparkSession, d: str) -> DataFrame:
    """The boxes of three engines in one form."""
    part = views.read(spark, d, "part").select(col("p_partkey").alias("doc"), F.lit(1).alias("page"), col("p_name").alias("text"))
    of = lambda k: part.where(col("doc") % 3 == k)
    number = lambda **values: {c: F.lit(float(v)) for c, v in values.items()}
    words = layout.boxes_of_words(of(0).withColumns(number(x0=5, top=2, x1=9, bottom=4)).union(of(0).withColumns(number(x0=5, top=2, x1=9, bottom=4)).withColumn("text", F.lit(" "))))
    scans = layout.boxes_of_scans(of(1).withColumns(number(left=5, top=2, width=7, height=3)).withColumn("conf", F.when(col("doc") % 5 == 0, "?").otherwise((col("doc") % 5 - 1).cast("string"))))
    shares = layout.boxes_of_shares(of(2).withColumns(number(x0=0.5, y0=0.5, x1=1, y1=1, page_width=100, page_height=80)))
    return words.union(scans).union(shares)


_Q = lambda c: f"'\"' || replace(coalesce(CAST({c} AS STRING), ''), '\"', '\"\"') || '\"'"


@query(over("audit_log", sql=f"SELECT id, {' || chr(44) || '.join(_Q(c) for c in exports.AUDIT if c != 'created_at')} AS line FROM (SELECT * FROM audit_log ORDER BY created_at DESC, id DESC LIMIT 5000)"))
def snk_csv_audit(spark: SparkSession, d: str) -> DataFrame:
    """All columns but the time, whose text differs between the engines."""
    return exports.audit_csv(views.audit_log(spark, d), tuple(c for c in exports.AUDIT if c != "created_at"))


@query(over("audit_log", sql="""SELECT id, '[' || strftime(created_at, '%Y-%m-%d') || '] ' || username || ' (' || role || ') — ' || action || ' on ' || coalesce(entity, '-') || CASE WHEN entity_id IS NULL THEN '' ELSE '#' || entity_id END || ' — ' || status || ' — ' || coalesce(ip_address, '') AS line
FROM audit_log ORDER BY created_at DESC, id DESC LIMIT 500"""))
def snk_text_audit(spark: SparkSession, d: str) -> DataFrame:
    lines = exports.audit_text(views.audit_log(spark, d))
    return lines.select("id", F.regexp_replace("line", r"^\[([0-9-]+) [^\]]*\]", "[$1]").alias("line"))


@query(over("shipments", sql="""SELECT id AS row, id || ',"' || coalesce(carrier_tracking_number, '') || '","' || CASE WHEN carrier IS NULL THEN 'no ""carrier""' ELSE coalesce(carrier, '') END || '"' AS line FROM shipments WHERE id % 7 < 3"""))
def snk_csv_skipped(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d, "id", "carrier", "carrier_tracking_number").where("id % 7 < 3")
    return exports.skipped_csv(rows.select(col("id").alias("row"), col("carrier_tracking_number").alias("tracking_number"), F.coalesce("carrier", F.lit('no "carrier"')).alias("reason")))


@query(over("api_logs", sql="SELECT 'system' AS username, 'API_FAILURE' AS action, provider AS entity, 'failure' AS status, trim('/' || CASE WHEN id % 2 = 0 THEN ' e' || id ELSE '' END) AS details FROM api_logs WHERE success = 0"))
def snk_api_log(spark: SparkSession, d: str) -> DataFrame:
    calls = views.api_logs(spark, d).withColumns({"endpoint": F.lit("/"), "error": F.when(col("id") % 2 == 0, F.concat(F.lit("e"), col("id").cast("string")))})
    return accounts.api_failures(calls)


@query(over("shipments", sql="""SELECT 'SHIPMENT_UPDATE' AS action, id AS entity_id, CASE WHEN id % 2 = 0 THEN '{"status":"' || status || '"}' END AS old_value, '{"status":"Lost","id":' || id || '}' AS new_value, CASE WHEN id % 5 = 0 THEN 'failure' ELSE 'success' END AS status FROM shipments"""))
def snk_audit_log(spark: SparkSession, d: str) -> DataFrame:
    old = F.when(col("id") % 2 == 0, F.struct("status"))
    row = accounts.audit_row("SHIPMENT_UPDATE", old, F.struct(F.lit("Lost").alias("status"), "id"), entity_id=col("id"), status=F.when(col("id") % 5 == 0, "failure").otherwise(""))
    return views.shipments(spark, d, "id", "status").select(*row)


@query(over("shipments", sql="""SELECT ge_tracking_number AS "GE Number", coalesce(from_name, '') AS "From Name", from_city AS "From City", '' AS "From Country", to_name AS "To Name", to_city AS "To City", to_country AS "To Country", coalesce(carrier, '') AS "Carrier",
 CASE WHEN id % 4 = 0 THEN coalesce(CAST(nullif(actual_weight, 0) AS STRING), '') ELSE CAST(id % 4 AS STRING) || '.0' END AS "Weight (kg)", pieces AS "Pieces", status AS "Status", CASE WHEN id % 6 = 0 THEN substr(CAST(created_at AS STRING), 1, 10) ELSE ship_date END AS "Date" FROM shipments"""))
def snk_visible_export(spark: SparkSession, d: str) -> DataFrame:
    rows = views.shipments(spark, d).withColumns({"from_country": F.lit(None).cast("string"), "billing_weight": (col("id") % 4).cast("double"), "ship_date": F.when(col("id") % 6 != 0, col("ship_date"))})
    return rows.select(*exports.visible_columns())


#: The tables of an export by the names of their sheets: a view (or a table) and columns whose texts both engines agree on.
_EXPORTED = {
    "Shipments": ("shipments", "id, carrier, status"),
    "TrackingEvents": ("tracking_events", "id, ge_tracking_number, status, location"),
    "TrackingCache": ("tracking_events", "DISTINCT ge_tracking_number, provider"),
    "Notifications": ("notifications", "id, user_id, status, event"),
    "BulkUploadJobs": ("upload_jobs", "id, uploaded_by"),
    "BulkUploadRecords": ("records", "job, doc_id, validation_status"),
    "ShipmentDocuments": ("lineitem", "l_orderkey, l_linenumber, l_returnflag || ' & <' || l_linestatus || '>' AS kind"),
    "ShipmentBackups": ("nation", "n_nationkey, n_name"),
    "ApiLogs": ("api_logs", "id, provider, success"),
    "AuditLog": ("audit_log", "id, username, action, details"),
}
_ROWS_SQL = " UNION ALL ".join(
    f"SELECT '{sheet}' AS sheet, concat_ws('|', {', '.join(f'coalesce(CAST(x.{c} AS STRING), chr(0))' for c in [p.split(' AS ')[-1].split()[-1] for p in columns.split(', ')])}) AS row FROM (SELECT {columns} FROM {view}) x"
    for sheet, (view, columns) in _EXPORTED.items()
)


@query(over("shipments", "tracking_events", "notifications", "upload_jobs", "records", "api_logs", "audit_log", sql=f"SELECT sheet, replace(row, chr(0), '') AS row FROM ({_ROWS_SQL})"))
def snk_xlsx_multi(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: ten tables as sheets of workbooks with 5,000 rows at most, and read again."""
    path = f"{work_dir(spark)}/export"
    made = {v: getattr(views, v)(spark, d) for v in ("shipments", "tracking_events", "notifications", "upload_jobs", "records", "api_logs", "audit_log")}
    made |= {t: views.read(spark, d, t) for t in ("lineitem", "nation")}
    tables = {}
    for sheet, (view, columns) in _EXPORTED.items():
        own = made[view].selectExpr(*columns.removeprefix("DISTINCT ").split(", "))
        tables[sheet] = own.distinct() if columns.startswith("DISTINCT ") else own
    exports.export_tables(tables, path, rows=5000)
    found = None
    for sheet in tables:
        read = spark.read.format("xlsx").option("sheet", sheet).load(f"{path}/{sheet}")
        rows = read.select(F.lit(sheet).alias("sheet"), F.concat_ws("|", *read.columns).alias("row"))
        found = rows if found is None else found.union(rows)
    return found


_LISTED = ("id", "ge_tracking_number", "carrier", "status", "ship_date", "to_name")


@query(over("shipments", sql=f"SELECT CAST(id AS STRING) AS id, {', '.join(_LISTED[1:])}, FALSE AS raw FROM shipments WHERE carrier = 'DHL' AND ship_date >= '1996-01-01' AND (" + " OR ".join(f"{c} ILIKE '%00001%'" for c in SEARCHED) + ")"))
def snk_xlsx_export(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: a filtered listing as workbooks, read again; the raw text isn't among its columns."""
    path = f"{work_dir(spark)}/listing"
    rows = views.shipments(spark, d).withColumn("ocr_raw_text", F.lit("raw"))
    exports.export_listing(rows, path, "00001", rows=1000, carrier="DHL", date_from="1996-01-01", status="")
    read = spark.read.format("xlsx").load(path)
    return read.select(*_LISTED, F.lit("ocr_raw_text" in read.columns).alias("raw"))
