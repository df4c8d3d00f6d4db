"""Exports: lines of CSV and text, and xlsx workbooks and zip files of bounded size."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import listings
from .xlsx import SHEET_ROWS, register, write_workbook

# The columns of an audit export, and the most rows and lines of it.
AUDIT = ("id", "created_at", "username", "role", "action", "entity", "entity_id", "ip_address", "device", "status", "old_value", "new_value", "details")
MOST_AUDIT, MOST_LINES = 5000, 500


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace(_text(c), F.lit('"'), F.lit('""')), F.lit('"'))


def audit_csv(audit: DataFrame, columns: tuple[str, ...] = AUDIT) -> DataFrame:
    """id and line of the newest rows: all values quoted, nulls empty."""
    newest = audit.orderBy(F.desc("created_at"), F.desc("id")).limit(MOST_AUDIT)
    return newest.select("id", F.concat_ws(",", *(quoted(c) for c in columns)).alias("line"))


def audit_text(audit: DataFrame) -> DataFrame:
    """id and a sentence for each of the newest rows."""
    newest = audit.orderBy(F.desc("created_at"), F.desc("id")).limit(MOST_LINES)
    named = lambda c, other: F.coalesce(F.nullif(_text(c), F.lit("")), F.lit(other))
    number = F.when(_text("entity_id") != "", F.concat(F.lit("#"), _text("entity_id"))).otherwise("")
    parts = (F.lit("["), _text("created_at"), F.lit("] "), named("username", "system"), F.lit(" ("), named("role", "-"), F.lit(") — "), _text("action"), F.lit(" on "), named("entity", "-"), number, F.lit(" — "), _text("status"), F.lit(" — "), _text("ip_address"))
    return newest.select("id", F.concat(*parts).alias("line"))


def skipped_csv(skipped: DataFrame) -> DataFrame:
    """row and line of skipped rows(row, tracking_number, reason): row, and the others quoted."""
    return skipped.select("row", F.concat_ws(",", F.col("row").cast("string"), quoted("tracking_number"), quoted("reason")).alias("line"))


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """An xlsx file of sheets: a header and rows each, every cell a text; an empty sheet says so."""
    out = io.BytesIO()
    write_workbook(out, [(name, columns, rows) for name, (columns, rows) in sheets.items()])
    return out.getvalue()


def visible_columns() -> list[Column]:
    """The columns of a listing's export, with what stands for missing values."""
    filled = lambda c, name, other="": F.coalesce(F.nullif(_text(c), F.lit("")), F.lit(other)).alias(name)
    weight = F.coalesce(F.nullif("billing_weight", F.lit(0.0)), F.nullif("actual_weight", F.lit(0.0)))
    texts = {"from_name": "From Name", "from_city": "From City", "from_country": "From Country", "to_name": "To Name", "to_city": "To City", "to_country": "To Country", "carrier": "Carrier"}
    day = F.coalesce(F.nullif(F.col("ship_date"), F.lit("")), F.substring(F.col("created_at").cast("string"), 1, 10), F.lit(""))
    pieces = F.coalesce(F.nullif("pieces", F.lit(0)), F.lit(1)).alias("Pieces")
    return [F.col("ge_tracking_number").alias("GE Number"), *(filled(c, name) for c, name in texts.items()), filled(weight, "Weight (kg)"), pieces, filled("status", "Status"), day.alias("Date")]


def export_listing(shipments: DataFrame, path: str, text: str | None = None, rows: int = SHEET_ROWS, **wanted: str | None) -> None:
    """The shipments that a listing's search and filters leave, newest first, as workbooks: all columns but the raw text.

    wanted: as listings.filtered. Without a match there is one workbook that says so.
    """
    found = listings.filtered(listings.search(shipments, text) if text else shipments, **wanted).drop("ocr_raw_text")
    newest = found.orderBy(F.desc("created_at"), "id")
    _saved(newest, path, "Shipments", rows, "No matching shipments")


def export_tables(tables: dict[str, DataFrame], path: str, rows: int = SHEET_ROWS) -> None:
    """Each table as workbooks in a folder of its name, on a sheet of that name; an empty one has a note."""
    for name, df in tables.items():
        _saved(df, f"{path}/{name}", name, rows, "No rows")


def _saved(df: DataFrame, path: str, sheet: str, rows: int, note: str) -> None:
    register(df.sparkSession)
    texts = df.select(*(_text(df[f"`{c}`"]).alias(c) for c in df.columns))
    texts.write.format("xlsx").option("sheet", sheet).option("rows", rows).option("note", note).mode("append").save(path)


def zipped(files: DataFrame) -> DataFrame:
    """archive and content: a zip file of the members(archive, name, content) of each archive, made in one task."""

    def made(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(rows["name"].to_pylist(), rows["content"].to_pylist(), strict=True):
                z.writestr(name, content)
        return pa.table({"archive": pa.array([key[0].as_py()], pa.string()), "content": pa.array([out.getvalue()], pa.binary())})

    return files.groupBy("archive").applyInArrow(made, "archive string, content binary")
