"""Uploads: CSV and xlsx sheets as rows, column aliases, members of zip files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx

# Header names that mean a field, in order.
ALIASES = {
    "carrier": ("carrier", "courier"),
    "carrier_tracking_number": ("carrier_tracking_number", "awb", "awb_number", "tracking_number", "tracking", "trackingnumber"),
    "from_name": ("from_name", "sender", "shipper", "shippername"),
    "from_country": ("from_country", "origin_country", "origincountry"),
    "from_city": ("from_city", "origin_city", "origincity"),
    "to_name": ("to_name", "receiver", "consignee", "recipient"),
    "to_country": ("to_country", "destination_country", "destinationcountry"),
    "to_city": ("to_city", "destination_city", "destinationcity"),
    "actual_weight": ("actual_weight", "weight"),
    "pieces": ("pieces", "qty", "quantity"),
    "ship_date": ("ship_date", "shipdate", "date"),
    "contents": ("contents", "description", "desc"),
    "reference_number": ("reference_number", "reference", "ref"),
    "invoice_number": ("invoice_number", "invoice"),
    "sender_company": ("sender_company", "shipper_company", "from_company", "company_sender"),
    "receiver_company": ("receiver_company", "consignee_company", "to_company", "company_receiver"),
    "receiver_attention": ("receiver_attention", "attention", "attn", "care_of", "c_o"),
    "customs_value": ("customs_value", "customsvalue", "value_for_customs"),
    "carriage_value": ("carriage_value", "carriagevalue", "freight_value"),
    "origin_code": ("origin_code", "origincode", "origin_station"),
    "destination_code": ("destination_code", "destinationcode", "destination_station"),
    "route_code": ("route_code", "routecode", "routing_code"),
    "service_code": ("service_code", "servicecode"),
    "package_length": ("package_length", "length", "pkg_length"),
    "package_width": ("package_width", "width", "pkg_width"),
    "package_height": ("package_height", "height", "pkg_height"),
    "billing_type": ("billing_type", "billingtype", "payment_type"),
    "account_number": ("account_number", "accountnumber", "carrier_account"),
}
# Endings of the members of a zip upload that are taken.
MEMBERS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".webp")
#: Members of zip files that are passed on at once, and bytes of their content.
MANY, BYTES = 4096, 16 << 20


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header row, every value a string, blanks as ''."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def header(name: str) -> str:
    return "_".join(name.strip().lower().split())


def normalised(rows: DataFrame) -> DataFrame:
    """The fields of ALIASES: for each, the first non-blank of its columns."""
    by = {header(c): c for c in rows.columns}
    first = lambda names: F.coalesce(*(F.nullif(F.col(f"`{by[n]}`"), F.lit("")) for n in names if n in by), F.lit(None).cast("string"))
    return rows.select(*(first(names).alias(field) for field, names in ALIASES.items()))


def sheets_of(content: bytes, only_first: bool = False) -> dict[str, list[list[str]]]:
    """The cells of an xlsx file's sheets by name, as strings, in the order of the workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared, found = xlsx.SharedTexts(z), {}
        for name, file in list(xlsx.sheet_files(z).items())[: 1 if only_first else None]:
            with z.open(file) as f:
                found[name] = [xlsx.cells_of(row, shared) for _, row in xlsx.rows_between(f, 0, 1 << 62)]
        return found


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of the workbook's first sheet."""
    return next(iter(sheets_of(content, only_first=True).values()), [])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """path, row_number and cells (a map by header) of the first sheet of each file: one task for each file."""
    return xlsx_rows(spark.read.format("binaryFile").load(path).select("path", "content"))


def xlsx_rows(files: DataFrame) -> DataFrame:
    """As read_xlsx, of files(path, content)."""

    def run(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = sheet_rows(bytes(content))
                names = rows[0] if rows else []
                found = [(file, i, {n: (r[k] if k < len(r) else "") for k, n in enumerate(names) if n}) for i, r in enumerate(rows[1:], 2)]
                yield pd.DataFrame(found, columns=["path", "row_number", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, row_number int, cells map<string,string>")


def zip_members(spark: SparkSession, path: str, endings: tuple[str, ...] = MEMBERS) -> DataFrame:
    """archive, name (without folders, odd characters as _) and content of the wanted members of zip files."""
    return members(spark.read.format("binaryFile").load(path).select("path", "content"), endings)


def members(files: DataFrame, endings: tuple[str, ...] = MEMBERS) -> DataFrame:
    """As zip_members, of files(path, content). Members are passed on together, up to MANY of them or BYTES of content."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes]]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    for member in z.infolist():
                        name = re.sub(r"[^a-zA-Z0-9.\-_]", "_", posixpath.basename(member.filename.replace("\\", "/")))
                        if not member.is_dir() and name.lower().endswith(endings):
                            yield file.as_py(), name, z.read(member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = 0
        for one in found(batches):
            held.append(one)
            size += len(one[2])
            if len(held) >= MANY or size >= BYTES:
                yield _members_batch(held)
                held, size = [], 0
        if held:
            yield _members_batch(held)

    return files.select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def _members_batch(held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    archive, name, content = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(name, pa.string()), pa.array(content, pa.binary())], names=["archive", "name", "content"])


def file_kind(path) -> F.Column:
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end == "csv", "csv").when(end.isin("xlsx", "xls"), "excel").when(end == "zip", "zip").when(end == "pdf", "pdf").otherwise("unknown")


def write_csv(df: DataFrame, path: str) -> None:
    """All values quoted, quotes doubled, nulls empty."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_backup(shipments: DataFrame, events: DataFrame, month: str, path: str) -> None:
    """A JSON line for each shipment with its events, in a folder for each month of the column."""
    nested = events.groupBy("ge_tracking_number").agg(F.sort_array(F.collect_list(F.struct("event_timestamp", "id", "status", "location"))).alias("tracking_events"))
    shipments.join(nested, "ge_tracking_number", "left").withColumn("month", F.date_format(month, "yyyy-MM")).write.partitionBy("month").json(path)
