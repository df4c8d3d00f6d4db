"""Waybill text to records (a text's reading is `waybill_reader`), and records completed from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.validation import missing_fields, sanity
from ..functions.values import field_score, is_blank
from . import waybill_reader
from .waybill_reader import DEFAULTS, FIELDS  # noqa: F401

SCORED = (
    "from_name", "from_address", "from_city", "from_country", "from_postal", "to_name", "to_address", "to_city", "to_country", "to_postal",
    "carrier", "carrier_tracking_number", "actual_weight", "contents",
)


def label_fields(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the fields that stand outside address blocks; columns that aren't asked for aren't computed."""
    staged = documents.withColumn("body", F.coalesce(labels.before_legal(F.col(text)), F.lit("")))
    staged = staged.withColumns({"layout": labels.layout(F.col("body")), "phones": labels.phones(F.col("body"))})
    return staged.withColumns(labels.fields(F.col("body"), F.col("layout"), F.col("phones"))).drop("body", "layout", "phones")


def records(documents: DataFrame, text: str = "text", as_of: Column | None = None) -> DataFrame:
    """documents with all FIELDS of their text, field_score and warnings; as_of, a date, adds sanity_warnings.

    A null or empty text gives the blank record.
    """
    read = F.arrow_udf(waybill_reader.read_all, waybill_reader.RECORD)
    df = documents.withColumn("waybill__read", read(F.col(text).cast("string")))
    df = df.withColumns({c: F.col("waybill__read")[c] for c in FIELDS}).drop("waybill__read")
    lacking = missing_fields(F.col("carrier_tracking_number"), F.col("to_name"), F.col("to_country"))
    checked = {"sanity_warnings": sanity(as_of, {c: F.col(c) for c in FIELDS})} if as_of is not None else {}
    return df.withColumns({"field_score": field_score([F.col(c) for c in SCORED]), "warnings": lacking, **checked})


def fill_gaps(primary: DataFrame, fallback: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """primary, with the blanks of the columns filled from fallback's row of the key."""
    other = fallback.select(key, *(F.col(c).alias(f"{c}__other") for c in columns))
    filled = {c: F.coalesce(F.when(~is_blank(F.col(c).cast("string")), F.col(c)), F.col(f"{c}__other")) for c in columns}
    return primary.join(other, key, "left").withColumns(filled).drop(*(f"{c}__other" for c in columns))


#: If a text layer gave none of these, the picture is read as well.
CRITICAL = ("carrier_tracking_number", "actual_weight", "contents")


def _lacks(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "null")


def needs_second_reading(native: DataFrame) -> Column:
    """Whether a record has none of the CRITICAL fields."""
    needed = F.lit(True)
    for c in CRITICAL:
        needed &= _lacks(c)
    return needed


def with_second_reading(native: DataFrame, pictures: DataFrame, columns: tuple[str, ...], key: str = "id") -> DataFrame:
    """native(key, columns) with the columns' gaps filled from the pictures' rows, in records that need it and no others;
    engine says where a record comes from. Documents without a text layer are those of pictures alone."""
    known = native.withColumns({"needed": needs_second_reading(native), "native": F.lit(True)})
    other = pictures.select(key, *(F.col(c).alias(f"{c}__other") for c in columns), F.lit(True).alias("read"))
    joined = known.join(other, key, "full")
    use = F.coalesce("needed", F.lit(True)) & F.col("read").isNotNull()
    filled = {c: F.when(use & _lacks(c), F.coalesce(F.col(f"{c}__other"), F.col(c))).otherwise(F.col(c)) for c in columns}
    engine = F.when(F.col("native").isNull(), "ocr").when(use, "pdf_text_layer+ocr").otherwise("pdf_text_layer")
    return joined.withColumns({**filled, "engine": engine}).select(key, *columns, "engine")
