"""Validation of uploaded rows, and sanity findings of extracted records, as arrays made by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .carriers import FORMATS, compact, detect_carrier
from .values import clean, falsy_coalesce, parse_date

# Fixed values.
COUNTRIES = (
    "India", "United States", "USA", "United Kingdom", "UK", "Canada", "Australia", "Singapore", "Hong Kong", "Ireland", "Germany", "France",
    "Japan", "China", "UAE", "New Zealand", "Malaysia", "Netherlands", "Italy", "Spain", "Switzerland", "South Korea", "Thailand", "Indonesia",
    "Vietnam", "Philippines", "Sri Lanka", "Bangladesh", "Nepal", "Qatar", "Saudi Arabia", "Kuwait", "Oman", "Bahrain",
)
POSTAL = {
    "India": (r"^\d{6}$", "6 digits"), "USA": (r"^\d{5}(-\d{4})?$", "5 digits (optionally -NNNN)"), "Canada": (r"^[A-Za-z]\d[A-Za-z]\s?\d[A-Za-z]\d$", "A1A 1A1"),
    "Australia": (r"^\d{4}$", "4 digits"), "UK": (r"^[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2}$", "e.g. SW1A 1AA"), "Singapore": (r"^\d{6}$", "6 digits"),
}
PHONE_DIGITS = {"India": (10, 12), "USA": (10, 11), "Canada": (10, 11), "Australia": (9, 11), "UAE": (9, 12), "UK": (10, 12), "Singapore": (8, 10)}


def texts(*candidates: Column) -> Column:
    return F.array_compact(F.array(*(c.cast("string") for c in candidates)))


def awb_error(number: Column, hint: Column) -> Column:
    fits = F.lit(True)
    for name, pattern in FORMATS:
        fits = F.when(F.lower(hint) == name.lower(), compact(number).rlike(pattern)).otherwise(fits)
    short = F.length(F.coalesce(F.trim(number), F.lit(""))) < 6
    return F.when(short, "AWB number missing or too short").when(F.coalesce(hint, F.lit("")) != "", F.when(~fits, F.concat(F.lit("AWB does not match expected "), hint, F.lit(" format"))))


def country_warning(country: Column) -> Column:
    known = F.lower(F.trim(country)).isin(*(c.lower() for c in COUNTRIES))
    return F.when((F.coalesce(country, F.lit("")) != "") & ~known, F.concat(F.lit('"'), country, F.lit('" is not a recognized country name')))


def weight_error(weight: Column) -> Column:
    """weight: a number; null isn't looked at."""
    return F.when((weight <= 0) | (weight > 1000), "Weight out of plausible range (0–1000 kg)")


def validate(number: Column, carrier: Column, to_country: Column, weight: Column, service: Column, duplicate: Column) -> Column:
    """valid, errors, warnings and detected_carrier of an uploaded row."""
    detected = falsy_coalesce(carrier, detect_carrier(number))
    errors = texts(awb_error(number, carrier), F.when(duplicate, "Duplicate AWB / tracking number already exists in system"), weight_error(weight))
    odd = F.when((F.length(F.coalesce(F.trim(number), F.lit(""))) >= 6) & detected.isNull(), "Unrecognized AWB format — carrier could not be auto-detected")
    warnings = texts(odd, country_warning(to_country), F.when(clean(service).isNull(), "Service type not detected"))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"), warnings.alias("warnings"), detected.alias("detected_carrier"))


def merge_warnings(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def missing_fields(number: Column, name: Column, country: Column) -> Column:
    lacks = lambda c, what: F.when(F.coalesce(c, F.lit("")) == "", f"{what} not detected")
    return texts(lacks(number, "Tracking number"), lacks(name, "Receiver name"), lacks(country, "Destination country"))


def _plain(x: Column) -> Column:
    """A number as people write it: no exponent, one decimal at least."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"0+$", ""), r"\.$", ".0")


def sanity(as_of: Column, fields: dict[str, Column]) -> Column:
    """Findings of a record as an array of (field, message, severity), in the order of the checks.

    fields has those of from_/to_ name, country, postal and contact, actual_weight, billing_weight, pieces, declared_value
    and ship_date that the record has. Severity is flag (likely wrong) or warn (unusual).
    """
    field = lambda name, kind="string": fields[name].cast(kind) if name in fields else F.lit(None).cast(kind)
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    found = lambda name, severity, *message: F.struct(F.lit(name).alias("field"), F.concat(*(m if isinstance(m, Column) else F.lit(m) for m in message)).alias("message"), F.lit(severity).alias("severity"))
    checks = []
    for side in ("from", "to"):
        country, postal, odd = field(f"{side}_country"), field(f"{side}_postal"), F.lit(None)
        for name, (pattern, shape) in POSTAL.items():
            odd = F.when((country == name) & ~F.trim(postal).rlike(pattern), found(f"{side}_postal", "flag", '"', postal, f"\" doesn't look like a {name} postal code (expected {shape})")).otherwise(odd)
        checks.append(F.when(given(postal), odd))
    for side in ("from", "to"):
        country, phone, odd = field(f"{side}_country"), field(f"{side}_contact"), F.lit(None)
        digits = F.length(F.regexp_replace(phone, r"\D", ""))
        for name, (low, high) in PHONE_DIGITS.items():
            odd = F.when((country == name) & ~digits.between(low, high), found(f"{side}_contact", "warn", '"', phone, '" has ', digits.cast("string"), f" digits — unusual for a {name} phone number (expected {low}-{high})")).otherwise(odd)
        checks.append(F.when(given(phone), odd))
    actual, billing, value = (field(c, "double") for c in ("actual_weight", "billing_weight", "declared_value"))
    pieces, told = field("pieces", "long"), field("ship_date")
    day = parse_date(told)
    checks += [
        F.when(actual > 1000, found("actual_weight", "flag", _plain(actual), "kg is unusually heavy for a parcel — check for a misplaced decimal")).when(actual < 0.01, found("actual_weight", "flag", _plain(actual), "kg is implausibly light — check the unit/decimal")),
        F.when((billing > 0) & (actual / billing > 3), found("billing_weight", "warn", "Billing weight (", _plain(billing), "kg) is much lower than actual weight (", _plain(actual), "kg)")),
        F.when(pieces <= 0, found("pieces", "flag", pieces.cast("string"), " pieces isn't valid — expected a positive integer")).when(pieces > 100, found("pieces", "warn", pieces.cast("string"), " pieces is unusually high — check for a misread")),
        F.when(value <= 0, found("declared_value", "flag", "Declared value ", _plain(value), " isn't valid — expected a positive amount")).when(value > 10_000_000, found("declared_value", "warn", "Declared value ", _plain(value), " is unusually high — check for a misplaced decimal")),
        F.when(given(told) & day.isNull(), found("ship_date", "flag", '"', told, "\" doesn't look like a valid date")).when(day > F.date_add(as_of, 14), found("ship_date", "warn", '"', told, '" is more than 2 weeks in the future — check for a misread')).when(day < F.date_sub(as_of, 3650), found("ship_date", "warn", '"', told, '" is more than 10 years old — check for a misread (e.g. 2-digit year)')),
        F.when(given(field("from_name")) & (F.upper(F.trim(field("from_name"))) == F.upper(F.trim(field("to_name")))), found("to_name", "flag", "Sender and receiver names are identical — likely a mis-extraction")),
    ]
    return F.array_compact(F.array(*checks))
