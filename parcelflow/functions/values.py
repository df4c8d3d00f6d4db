"""Values: blanks, numbers, dates, lists, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)"
_GROUP = r"([\d.]+)\s*\*\s*([\d.]+)\s*\*\s*([\d.]+)\s*\*\s*(\d+)\s*=\s*([\d.]+)"


def clean(c: Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", "null")


def falsy_coalesce(*columns: Column) -> Column:
    """The first that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def to_number(c: Column) -> Column:
    """The number that the text begins with, commas aside; else null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), _NUMBER, 0), F.lit("")).try_cast("double")


def to_number_loose(c: Column) -> Column:
    """What is left without all but digits, points and signs, as a number."""
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def to_iso_date(c: Column) -> Column:
    """D/M/YYYY and D-M-YYYY as YYYY-MM-DD; anything else unchanged."""
    day, month, year = (F.regexp_extract(c, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", k) for k in (1, 2, 3))
    return F.when(year != "", F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))).otherwise(c)


def parse_date(c: Column) -> Column:
    """A date in one of four forms, tried in turn."""
    t = F.trim(c)
    forms = ((r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"))
    return F.coalesce(*(F.when(t.rlike(p), F.to_date(F.try_to_timestamp(t, F.lit(form)))) for p, form in forms))


def dimension_groups(c: Column) -> Column:
    """Groups written L*W*H*quantity=weight, as an array of structs."""
    parts = [F.regexp_extract_all(c, F.lit(_GROUP), F.lit(k)) for k in range(1, 6)]
    names = ("length", "width", "height", "qty", "weight")
    kinds = ("double", "double", "double", "long", "double")
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, names, strict=True))), lambda g: F.struct(*(g[n].try_cast(kind).alias(n) for n, kind in zip(names, kinds, strict=True))))


def pieces_of(c: Column) -> Column:
    """The pieces of all groups; null without a group."""
    groups = dimension_groups(c)
    return F.nullif(F.aggregate(groups, F.lit(0).cast("long"), lambda n, g: n + F.coalesce(g["qty"], F.lit(0))), F.lit(0).cast("long"))


def safe_filename(c: Column, default: str = "file") -> Column:
    name = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(default))


def is_ge_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"[\s-]", "")).rlike(r"^GE\d{7}$")


def split_list(c: Column) -> Column:
    """Parts between commas, trimmed, without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def clamp(c: Column, default: int, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(c.try_cast("int"), F.lit(default))))


def locality(*parts: Column) -> Column:
    return F.concat_ws(", ", *(clean(p) for p in parts))


def carrier_code(name: Column) -> Column:
    return F.substring(F.upper(F.regexp_replace(name, "[^A-Za-z]", "")), 1, 8)


def shipment_number(key: Column) -> Column:
    """A number from a row's key (0 or more), one to one: of seven digits for the first 9,000,000 keys, then of more."""
    seven = (F.lit(1_000_000) + F.pmod(F.pmod(key, F.lit(9_000_000)) * 7_368_787 + 12_345, F.lit(9_000_000))).cast("string")
    return F.concat(F.lit("GE"), F.when(key >= 9_000_000, F.floor(key / 9_000_000).cast("string")).otherwise(""), seven)


def field_score(columns: list[Column]) -> Column:
    """Percentage of fields that aren't blank, one decimal."""
    held = sum((F.when(is_blank(c.cast("string")), 0).otherwise(1) for c in columns), F.lit(0))
    return F.round(F.lit(100.0) * held / len(columns), 1)
