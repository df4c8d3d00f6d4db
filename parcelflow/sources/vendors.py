"""Vendors' sheets: their columns to shipments, and which rows of an import go in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clean, pieces_of, to_iso_date, to_number
from ..operators.listings import numbers

# Headers of the sheets, in the order in which they are tried. The forwarding number is what is tracked; AWBNo isn't.
COMMON = {
    "tracking_number": ("Forwading No", "Forwarding No"), "original_awb": ("AWBNo", "AWB No", "AWB"), "booking_date": ("Booking Date",), "shipper_name": ("Shipper Name",),
    "consignee_name": ("Consignee Name",), "destination_country": ("Destination Country",), "weight": ("Chargeable Weight",), "pieces": ("Total No of Items",),
    "dimensions": ("Dimensions",), "content": ("Content",), "shipper_address": ("ShipperAddress",), "shipper_city": ("ShipperCity",), "shipper_state": ("ShipperState",),
    "shipper_pin": ("Shipper_Pin",), "consignee_address": ("ConsigneeAddress",), "consignee_city": ("ConsigneeCity",), "consignee_state": ("ConsigneeState",),
    "consignee_pin": ("Consignee_Pin",), "service_name": ("ServiceName",), "currency": ("Currency_Code",), "reference_number": ("Client Reference",),
    "invoice_number": ("Invoice Number", "invno"),
}
VENDORS = {
    "ICL": COMMON | {"value": ("Shipment_Value",), "origin": (), "customer_name": (), "mode": ()},
    "World First": COMMON | {"value": ("Value",), "origin": ("Origin",), "customer_name": ("Customer Name",), "mode": ("mode",)},
}
NAMES = {"icl": "ICL", "worldfirst": "World First", "wf": "World First"}


def resolve(name: Column) -> Column:
    """The vendor of a name, letter case and blanks aside; null if there is none."""
    bare = F.regexp_replace(F.lower(name), r"\s+", "")
    return F.coalesce(*(F.when(bare == k, v) for k, v in NAMES.items()))


def mapped(rows: DataFrame, vendor: str, cells: str = "cells") -> DataFrame:
    """rows with the vendor's fields out of a map of cells by header; headers count without letter case and repeated blanks."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    rows = rows.withColumn("entries", F.transform(F.map_entries(cells), lambda e: F.struct(plain(e["key"]).alias("key"), F.trim(e["value"]).alias("value"))))
    named = lambda name: F.try_element_at(F.filter("entries", lambda e: (e["key"] == name.lower()) & (e["value"] != "")), F.lit(1))["value"]
    none = F.lit(None).cast("string")
    return rows.withColumns({f: F.coalesce(*(named(n) for n in names), none) for f, names in VENDORS[vendor].items()}).withColumn("vendor", F.lit(vendor)).drop("entries")


def shipment_columns() -> dict[str, Column]:
    """Shipments of mapped rows: pieces of the sheet, else of the dimensions, else 1; what has no column goes to carrier_specific."""
    c = lambda name: clean(F.col(name))
    pieces = F.coalesce(F.nullif(to_number(F.col("pieces")), F.lit(0.0)), pieces_of(F.col("dimensions")).cast("double"), F.lit(1.0))
    extras = F.struct("vendor", "service_name", F.col("currency").alias("currency_code"), "origin", "customer_name", "mode", F.col("reference_number").alias("client_reference"), F.lit("excel_import").alias("source"))
    return {
        "vendor": F.col("vendor"), "carrier_tracking_number": c("tracking_number"), "awb_number": c("original_awb"), "reference_number": c("reference_number"),
        "from_name": c("shipper_name"), "from_address": c("shipper_address"), "from_city": F.coalesce(c("shipper_city"), c("origin")), "from_state": c("shipper_state"),
        "from_postal": c("shipper_pin"), "from_country": F.lit("India"), "to_name": c("consignee_name"), "to_address": c("consignee_address"), "to_city": c("consignee_city"),
        "to_state": c("consignee_state"), "to_postal": c("consignee_pin"), "to_country": c("destination_country"), "pieces": pieces, "actual_weight": to_number(F.col("weight")),
        "billing_weight": to_number(F.col("weight")), "weight_unit": F.lit("kg"), "dimensions": c("dimensions"), "contents": c("content"), "declared_value": to_number(F.col("value")),
        "currency": F.coalesce(c("currency"), F.lit("INR")), "booking_date": to_iso_date(c("booking_date")), "ship_date": to_iso_date(c("booking_date")),
        "service_type": F.coalesce(c("service_name"), c("mode")), "invoice_number": c("invoice_number"), "status": F.lit("Processing"),
        "carrier_specific": F.to_json(extras, {"ignoreNullFields": "false"}),
    }


def classified(rows: DataFrame, shipments: DataFrame, order: str = "row_number") -> DataFrame:
    """rows with errors and outcome: imported, duplicate or invalid.

    A valid row is a duplicate if its number is known by a shipment, is that of an earlier valid row, or is the waybill
    number of an earlier row that is neither. Numbers are joined and windowed, not looked up row by row.
    """
    lacks = lambda c, what: F.when(F.col(c).isNull(), f"Missing {what}")
    missing = F.array_compact(F.array(lacks("carrier_tracking_number", "Tracking Number"), lacks("from_name", "Shipper Name"), lacks("to_name", "Consignee Name")))
    known = numbers(shipments).select(F.col("number").alias("carrier_tracking_number"), F.lit(True).alias("in_table")).distinct()
    rows = rows.withColumn("errors", missing).join(known, "carrier_tracking_number", "left")
    valid = F.size("errors") == 0
    nth = F.row_number().over(Window.partitionBy("carrier_tracking_number", valid).orderBy(order))
    rows = rows.withColumn("new", valid & F.col("in_table").isNull() & (nth == 1))
    brought = rows.where("new and awb_number is not null").groupBy(F.col("awb_number").alias("carrier_tracking_number")).agg(F.min(order).alias("brought_by"))
    rows = rows.join(brought, "carrier_tracking_number", "left")
    new = F.col("new") & F.coalesce(F.col("brought_by") >= F.col(order), F.lit(True))
    outcome = F.when(~valid, "invalid").when(new, "imported").otherwise("duplicate")
    repeated = F.array(F.lit("Duplicate Shipment — Tracking Number already exists"))
    return rows.withColumn("outcome", outcome).withColumn("errors", F.when(F.col("outcome") == "duplicate", repeated).otherwise(F.col("errors"))).drop("in_table", "new", "brought_by")


def summary(classified_rows: DataFrame) -> DataFrame:
    count = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return classified_rows.agg(F.count("*").alias("rows_read"), count("imported"), count("duplicate"), count("invalid"))
