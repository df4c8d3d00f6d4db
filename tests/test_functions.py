import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from parcelflow.functions import carriers, labels, messages, validation, values
from parcelflow.operators import accounts, changes, choices, layout, waybills
from parcelflow.sources import exports, uploads
from parcelflow.streaming import pushes


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()[0]


def test_values(spark):
    assert one(spark, "string", " 1,200.5kg", values.to_number) == 1200.5
    assert one(spark, "string", "kg 5", values.to_number) is None
    assert one(spark, "string", None, values.to_number) is None
    assert one(spark, "string", "3/4/2020", values.to_iso_date) == "2020-04-03"
    assert one(spark, "string", "soon", values.to_iso_date) == "soon"
    assert one(spark, "string", "25/12/2020", values.parse_date) == datetime.date(2020, 12, 25)
    assert one(spark, "string", "2020-13-01", values.parse_date) is None
    assert one(spark, "string", "__ / ", values.safe_filename) == "file"
    assert one(spark, "string", "ge-123 4567", values.is_ge_number) is True
    assert one(spark, "string", "", values.pieces_of) is None


def test_carriers(spark):
    known = {"1ZH4Y8210404603959": "UPS", "123456789012": "FedEx", "1234567890": "DHL", "12345678901": "Aramex", "12345678": "BlueDart", "AB123456C": "DTDC", "1234567890123": "Delhivery", "EE123456789IN": "IndiaPost", "x": None, None: None}
    for number, carrier in known.items():
        assert one(spark, "string", number, carriers.detect_carrier) == carrier
    assert one(spark, "string", "OutForDelivery", lambda c: carriers.map_status(c, carriers.STATUSES_B)) == "Out for Delivery"
    assert one(spark, "string", "Lost", lambda c: carriers.map_status(c, carriers.STATUSES_B)) == "Lost"
    assert one(spark, "string", None, lambda c: carriers.map_status(c, carriers.STATUSES_B)) == "Information Received"


def test_validation_of_blank_rows(spark):
    row = spark.range(1).select(validation.validate(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(" "), F.lit(False)).alias("v")).first()[0]
    assert row.valid is False and row.errors == ["AWB number missing or too short"] and row.warnings == ["Service type not detected"]


def test_label_pieces_and_layout(spark):
    assert one(spark, "string", "9/3 1/2 2/5", labels.pieces_in_pairs) == 2
    assert one(spark, "string", None, labels.layout) == "Generic"
    assert one(spark, "string", "*12345678* *1234567890* *0987654321*", labels.barcode) == "1234567890"


def test_null_keys_are_never_equal(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, k string, l string")
    new = spark.createDataFrame([(3, "a", None), (4, "a", None), (5, "b", "x"), (6, "c", "y"), (7, "c", "y")], "id int, k string, l string")
    assert sorted(r.id for r in changes.insert_ignore(old, new, ["k", "l"], "id").collect()) == [1, 2, 3, 4, 6]


def test_columns_are_read_one_after_the_other(spark):
    words = [(1, 1, t, x, y, x + 40.0, y + 10.0) for t, x, y in [("left1", 0.0, 0.0), ("right1", 300.0, 1.0), ("left2", 0.0, 20.0), ("right2", 300.0, 21.0), ("left3", 0.0, 40.0)]]
    page = layout.reading_order(spark.createDataFrame(words, "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")).first()
    assert page.text == "left1\nleft2\nleft3\nright1\nright2"


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Courier,AWB,Weight\nDHL,"1,2",\n')
    row = uploads.normalised(uploads.read_csv(spark, str(tmp_path / "a.csv"))).first()
    assert (row.carrier, row.carrier_tracking_number, row.actual_weight, row.to_name) == ("DHL", "1,2", None, None)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>AWB</t></si><si><t>Pieces</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    row = uploads.read_xlsx(spark, str(tmp_path / "b.xlsx")).first()
    assert row.row_number == 2 and row.cells == {"AWB": "", "Pieces": "3"}
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/a.pdf", b"1")
        z.writestr("in/b.txt", b"2")
    (tmp_path / "c.zip").write_bytes(buffer.getvalue())
    assert [(r.name, bytes(r.content)) for r in uploads.zip_members(spark, str(tmp_path / "c.zip")).collect()] == [("a.pdf", b"1")]


def test_pushes_sent_again_change_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    steps = [["Picked Up", "In Transit"], ["Picked Up", "In Transit", "Delivered"], ["In Transit", "Delivered", "Information Received"]]
    for i, statuses in enumerate(steps):
        events = [{"seq": 10 * i + k, "ts": f"2024-01-01T0{['Picked Up', 'In Transit', 'Delivered', 'Information Received'].index(s)}:00", "status": s, "location": "HUB"} for k, s in enumerate(statuses)]
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"number": "GE1", "events": events}) + "\n")
    q = pushes.states(pushes.read_pushes(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("states").orderBy(F.desc("n_events")).first()
    assert (last.tracking_status, last.status, last.n_events) == ("Information Received", "Delivered", 4)


WAYBILLS = [
    (1, "EXPRESS WORLDWIDE\nShipper : SENDER ONE\n\nSENDER ONE\nUNIT 1\nCHENNAI-TN-600018\nIndia\nReceiver : RECEIVER ONE Contact: 1\nMs. Some Person\n2 TEST AVE\nSINGAPORE SG 768161\nWAYBILL 00 0000 0001\n13.50 KG\n9/3 1/2"),
    (2, "TRK# 0000 0000 0001\nORIGIN ID:MAAA 0000000001\n12 LONG ROAD\nSHIP DATE: 02JAN00\nTOSWETHA K 16136971929\nUNIT 5\nOTTAWA ONTARIO K1G 4B5\n(CA)\nFROM X"),
    (3, "nothing *37294289760* EXP 971566902667"),
    (4, None),
    (5, " \n "),
    (6, "x" * 100_000),
]


def test_waybills_of_odd_layouts(spark):
    found = {r.id: r for r in waybills.records(spark.createDataFrame(WAYBILLS, "id int, text string")).collect()}
    one, two, three = found[1], found[2], found[3]
    assert (one.from_name, one.from_address, one.from_city, one.from_state, one.from_postal, one.from_country) == ("SENDER ONE", "UNIT 1", "Chennai", "TN", "600018", "India")
    assert (one.to_name, one.receiver_attention, one.to_address, one.to_city, one.to_state, one.to_postal, one.to_country) == ("RECEIVER ONE", "Ms. Some Person", "2 TEST AVE", "Singapore", None, "768161", "Singapore")
    assert (one.carrier_tracking_number, one.actual_weight, one.pieces) == ("0000000001", 13.5, 2)
    assert (two.from_name, two.from_address) == (None, "12 LONG ROAD")
    assert (two.to_name, two.to_city, two.to_state, two.to_postal, two.to_country, two.to_contact) == ("SWETHA K", "Ottawa", "ON", "K1G4B5", "Canada", "16136971929")
    assert (three.carrier, three.carrier_tracking_number) == ("Aramex", "37294289760")
    for k in (4, 5, 6):
        assert found[k].field_score == 0.0 and found[k].pieces == 1 and len(found[k].warnings) == 3


def test_texts_for_people(spark):
    assert one(spark, "string", "Abc", messages.password_errors) == ["Must be at least 10 characters", "Must contain a number", "Must contain a symbol"]
    assert one(spark, "string", '```json\n{"a": 1}\n```', messages.without_fence) == '{"a": 1}\n'
    assert one(spark, "double", 1200.5, lambda c: messages.value_cell(c, F.lit(None).cast("string"))) == "INR 1,200.5"
    assert one(spark, "double", 5.0, lambda c: messages.weight_cell(F.lit(None).cast("double"), c, F.lit(""))) == "5 kg"
    assert one(spark, "double", None, lambda c: messages.weight_cell(c, c, F.lit("kg"))) == "—"
    assert one(spark, "timestamp", datetime.datetime(2024, 1, 1), lambda c: messages.expired(c, F.lit("2024-04-01").cast("timestamp"))) is True


def test_gaps_alone_are_filled(spark):
    a = spark.createDataFrame([(1, "", 2.0), (2, "x", None)], "id int, name string, w double")
    b = spark.createDataFrame([(1, "n", 9.0)], "id int, name string, w double")
    assert sorted(tuple(r) for r in waybills.fill_gaps(a, b, "id", ("name", "w")).collect()) == [(1, "n", 2.0), (2, "x", None)]


def test_payloads_without_events_or_number(spark):
    lines = ['{"data": {"tracking_number": "N1", "delivery_status": "transit"}}', '{"data": {"delivery_status": "transit"}}', "nonsense", None]
    got = pushes.payloads(spark.createDataFrame([(x,) for x in lines], "value string"), "A").collect()
    assert [(r.number, r.current, r.events) for r in got] == [("N1", "In Transit", [])]


def test_a_long_line_over_a_gutter_stays_whole(spark):
    left = [("one", 0.0, 20.0 * k, 60.0) for k in range(12)] + [("two", 64.0, 20.0 * k, 110.0) for k in range(12)]
    right = [("right", 300.0, 20.0 * k, 360.0) for k in range(12)]
    long = [(t, x, 240.0, x + 50.0) for t, x in [("5", 0.0), ("YISHUN", 54.0), ("STREET", 108.0), ("1", 162.0), ("2", 216.0)]]
    words = [(1, 1, t, x0, y, x1, y + 10.0) for t, x0, y, x1 in left + right + long]
    page = layout.reading_order(spark.createDataFrame(words, "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")).first()
    assert page.text.split("\n") == ["one two"] * 12 + ["5 YISHUN STREET 1 2"] + ["right"] * 12


def test_the_first_sheet_is_the_workbook_s(spark):
    book = exports.workbook({"b": (["x"], [("1",)]), "a": (["y"], []), **{f"s{k}": (["z"], [(str(k),)]) for k in range(9)}})
    assert uploads.sheet_rows(book) == [["x"], ["1"]]
    sheets = uploads.sheets_of(book)
    assert list(sheets)[:3] == ["b", "a", "s0"] and sheets["a"] == [["note"], ["No rows"]] and sheets["s8"] == [["z"], ["8"]]


def test_numbers_of_shipments_are_one_to_one(spark):
    keys = spark.range(0, 27_000_000, 1_000).union(spark.range(9_000_000, 9_001_000))
    made = keys.distinct().select(values.shipment_number(F.col("id")).alias("n"))
    assert made.distinct().count() == made.count() and one(spark, "long", 5, values.shipment_number) == "GE" + str(1_000_000 + (5 * 7_368_787 + 12_345) % 9_000_000)


def test_rows_without_a_time_stay_and_the_last_change_counts(spark):
    rows = spark.createDataFrame([(1, None), (2, datetime.datetime(2020, 1, 1)), (3, datetime.datetime(2024, 1, 1))], "id int, at timestamp_ntz")
    assert sorted(r.id for r in changes.keep_newer(rows, "at", "2023-01-01").collect()) == [1, 3]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    new = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (1, None, 3)], "id int, s string, nth int")
    assert sorted(tuple(r) for r in changes.patch(old, new.where("nth < 3"), "id", "nth").collect()) == [(1, "x"), (2, "b")]
    assert sorted(tuple(r) for r in changes.overwrite(old, new, "id", "nth").collect()) == [(1, None), (2, "b")]


def test_places_of_telephone_numbers(spark):
    text = "A 9876543210 then 12 x 9876543210"
    assert [tuple(x) for x in one(spark, "string", text, labels.phones_at)] == [("9876543210", 2), ("9876543210", 23)]
    assert one(spark, "string", None, labels.phones_at) is None and one(spark, "string", "", labels.phones_at) == []


def test_empty_tables_give_empty_answers(spark):
    pages = spark.createDataFrame([], "doc long, page int, text string")
    assert choices.best_page(pages).count() == choices.longest_page(pages).count() == 0
    logins = spark.createDataFrame([], "username string, id long, at timestamp_ntz, ok boolean")
    assert accounts.locked(logins).count() == 0 and one(spark, "string", None, choices.known_word_hits) == 0
    assert one(spark, "string", "nothing", choices.parsed_list) == [] and one(spark, "string", None, choices.usable) is None
