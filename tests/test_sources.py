"""The xlsx source, imports that are run again, long lists, and Aramex texts that are nearly of a kind."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import aramex
from parcelflow.operators import changes, listings, waybills
from parcelflow.sources import exports, uploads, xlsx

PREFIXED = """<?xml version="1.0"?><x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><x:dimension ref="A1"/><x:sheetData>
<x:row r="1"><x:c r="A1" t="s"><x:v>0</x:v></x:c><x:c r="C1" t="inlineStr"><x:is><x:t>n</x:t></x:is></x:c></x:row><x:row r="2"/><x:row r="5" spans="1:3"><x:c r="C5"><x:v>7</x:v></x:c></x:row></x:sheetData><x:rowBreaks/></x:worksheet>"""


def with_names(path, sheet):
    import zipfile

    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>na</t></r><r><t>me</t></r></si></sst>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)


def test_a_sheet_is_read_in_parts(spark, tmp_path):
    xlsx.register(spark)
    out = str(tmp_path / "books")
    rows = spark.range(0, 3000, 1, 2).select(F.col("id").cast("string").alias("Key"), F.concat(F.lit("a <b> & \r\n ' \" "), "id").alias("two words"), F.when(F.col("id") % 3 > 0, "é😀").alias("n"))
    rows.write.format("xlsx").option("rows", 700).mode("append").save(out)
    assert len(os.listdir(out)) == 6 and all(f.endswith(".xlsx") for f in os.listdir(out))
    want = sorted((r[0], r[1], r[2] or "") for r in rows.collect())
    for size in (1 << 25, 40_000, 999):
        read = spark.read.format("xlsx").option("bytes", size).load(out)
        assert read.columns == rows.columns and sorted(map(tuple, read.collect())) == want
    some = spark.read.format("xlsx").schema("n string, absent string").load(out)
    assert some.where("absent is null").count() == 3000 and some.where("n = 'é😀'").count() == 2000
    with pytest.raises(Exception, match="must be strings"):
        spark.read.format("xlsx").schema("n int").load(out).collect()


def test_rows_as_written_here_are_read_without_the_parser_and_others_with_it(monkeypatch):
    import io

    odd = [["a<b>&amp;\r\n\"'", None, "é😀"], ["\x01\x1e", "\x1f", "\ufffe"], [], [5, "", "]]>"], ["&#13;", "&lt;", "&#65;"]]
    for rows in ([[r] for r in odd] + [odd]):
        assert xlsx._rows_xml(rows) == "".join(map(xlsx._xml, rows))
    parsed = []
    pull = xlsx.ElementTree.XMLPullParser
    monkeypatch.setattr(xlsx.ElementTree, "XMLPullParser", lambda events: type("P", (), {"p": pull(events), "feed": lambda self, d: (parsed.append(len(d)), self.p.feed(d))[1], "read_events": lambda self: self.p.read_events()})())
    rows = [[f"r{k} <&>", "x\ry" if k % 5 == 0 else "é", ""] for k in range(4000)]
    sheet = xlsx._HEAD + xlsx._rows_xml(rows).encode() + b"</sheetData></worksheet>"
    read = lambda content, size, step: [(n, xlsx.cells_of(r, None)) for a in range(0, size, step) for n, r in xlsx.rows_between(io.BytesIO(content), a, a + step)]
    monkeypatch.setattr(xlsx, "_CHUNK", 5000)
    for step in (len(sheet), 70_001, 100_000):
        assert read(sheet, len(sheet), step) == list(enumerate(rows, 1)) and not parsed
    foreign = sheet.replace(b"<row><c t=\"inlineStr\"><is><t xml:space=\"preserve\">r2000 ", b"<row><c t=\"inlineStr\"><is><t>r2000 ")
    assert read(foreign, len(foreign), len(foreign)) == list(enumerate(rows, 1)) and parsed


def test_namespaces_gaps_and_shared_texts(spark, tmp_path):
    xlsx.register(spark)
    with_names(str(tmp_path / "p.xlsx"), PREFIXED)
    for size in (1 << 20, 50, 7):
        read = spark.read.format("xlsx").option("bytes", size).load(str(tmp_path / "p.xlsx"))
        assert read.columns == ["name", "n"] and sorted(map(tuple, read.collect())) == [("", ""), ("", "7")]
    assert uploads.sheet_rows((tmp_path / "p.xlsx").read_bytes()) == [["name", "", "n"], [], ["", "", "7"]]


def test_a_failed_export_leaves_nothing_and_an_empty_one_a_note(spark, tmp_path):
    xlsx.register(spark)
    bad = spark.range(0, 100, 1, 3).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("xlsx").mode("append").save(str(tmp_path / "bad"))
    assert os.listdir(tmp_path) == []
    exports.export_tables({"T": spark.range(0).select("id")}, str(tmp_path / "none"))
    assert [r.note for r in spark.read.format("xlsx").load(str(tmp_path / "none/T")).collect()] == ["No rows"]
    equal = spark.createDataFrame([("same",)] * 50, "v string").coalesce(1)
    equal.write.format("xlsx").option("rows", 20).mode("overwrite").save(str(tmp_path / "equal"))
    equal.write.format("xlsx").option("rows", 20).mode("overwrite").save(str(tmp_path / "equal"))
    assert len(os.listdir(tmp_path / "equal")) == 3 and spark.read.format("xlsx").load(str(tmp_path / "equal")).count() == 50


def test_members_of_zip_files_are_passed_on_together(spark, monkeypatch):
    import io
    import zipfile

    def archive(n):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k in range(n):
                z.writestr(f"in/scan {k}.pdf", b"x" * (k % 50))
            z.writestr("notes.txt", b"no")
        return out.getvalue()

    seen = []
    made = uploads._members_batch
    monkeypatch.setattr(uploads, "_members_batch", lambda held: (seen.append((len(held), sum(len(c) for _, _, c in held))), made(held))[1])
    monkeypatch.setattr(uploads, "MANY", 100)
    monkeypatch.setattr(uploads, "BYTES", 1000)
    files = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c"]), pa.array([archive(300), archive(0), archive(7)], pa.binary())], names=["path", "content"])

    class Files:  # what members asks of a table, run here
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([files])))

    batches = uploads.members(Files())
    assert len(batches) == len(seen) < 20 and all(n <= 100 and size < 1050 for n, size in seen)
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(rows) == 307 and rows[0] == {"archive": "a", "name": "scan_0.pdf", "content": b""} and [r["archive"] for r in rows[300:]] == ["c"] * 7
    table = spark.createDataFrame([("a", bytearray(archive(300))), ("b", bytearray(archive(0)))], "path string, content binary")
    assert uploads.members(table).count() == 300


def test_imports_that_were_cut_off_or_run_again(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(0, 1000, 1, 5).select((F.col("id") * 7 % 1000).alias("o"))
    first = changes.append_import(spark, path, rows, "a", ["o"])
    assert [tuple(r) for r in first.orderBy("id").collect()] == [(k + 1, k) for k in range(1000)]
    (tmp_path / "table/batch=b").mkdir()
    (tmp_path / "table/batch=b/part-0.parquet").write_bytes((next((tmp_path / "table/batch=a").glob("*.parquet"))).read_bytes())  # without _SUCCESS
    for _ in range(2):
        both = changes.append_import(spark, path, rows.limit(30), "b", ["o"])
        assert both.count() == 1030 and both.agg(F.max("id"), F.countDistinct("id")).first()[:] == (1030, 1030)
    assert changes.append_import(spark, str(tmp_path / "none"), rows.where("o < 0"), "a", ["o"]).count() == 0


def test_short_lists_are_filters_and_long_ones_joins(spark, tmp_path):
    spark.range(5000).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    short, long = listings.in_list(table, "id", [1, 2, 3]), listings.in_list(table, "id", list(range(2000)))
    assert "PushedFilters: [In(id, [1,2,3])]" in plan(short) and "Join" not in plan(short) and short.count() == 3
    assert "LeftSemi" in plan(long) and long.count() == 2000
    assert listings.in_list(table, "id", [], 0).count() == 0 and listings.in_list(table, "id", table.where("id % 2 = 0")).count() == 2500


def test_aramex_near_misses(spark):
    none = {"from_name", "from_city", "account_number"}
    texts = {
        "footer alone": "ARAMEX\nShpr Ref: GARUDA Con Ref:",
        "short block": "ARAMEX\n60542311\n917708992856\nNAME ONE 917708992856\nCONDITIONS OF CARRIAGE\n" + "x\n" * 20,
        "legal text": "ARAMEX\nCONDITIONS OF CARRIAGE\nCity\nNowhere\nCompany\nNobody LLC\n1.50 KG 99.00 USD 01/01/2020",
        "glyphs alone": "ARAMEX █▐ █▌▐ ▐▌▌ █▌▐▌\n█ ▌",
    }
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [("none", None), ("empty", "")], "k string, text string")
    found = {r.k: r.asDict() for r in waybills.records(rows, as_of=F.lit("2026-01-01").cast("date")).collect()}
    for name in texts:
        assert found[name]["carrier"] == "Aramex" and all(found[name][c] is None for c in none), name
    assert found["legal text"]["actual_weight"] is None and found["legal text"]["to_city"] is None
    blank = {c: waybills.DEFAULTS.get(c) for c in waybills.FIELDS}
    assert len(blank) == 43 and all({c: found[k][c] for c in blank} == blank and found[k]["sanity_warnings"] == [] for k in ("none", "empty"))
    quiet = spark.createDataFrame([("To: NAME ████8 ▐▐\n▌▌8\n█ one\n a █",)], "t string").select(aramex.quiet_lines(F.col("t"))).first()[0]
    assert quiet == ["To: NAME", "█ one", "a █"]
