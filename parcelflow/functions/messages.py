"""Texts that people read: messages of events, address boxes and cells of a waybill, and rules for passwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import clean

_DASH = "—"


def message(event: Column, context: dict[str, Column], brand: str) -> Column:
    """subject and body of an event; null for an unknown one. context holds the values that they name."""
    c = lambda name: F.coalesce(context[name].cast("string"), F.lit("")) if name in context else F.lit("")
    given = lambda name, text: F.when(c(name) != "", text).otherwise("")
    text = lambda subject, body: F.struct(F.concat(*subject).alias("subject"), F.concat(*body).alias("body"))
    w = F.lit
    texts = {
        "shipment_delivered": text(
            (w("Your shipment "), c("number"), w(" has been delivered")),
            (w("Good news! Shipment "), c("number"), w(" was delivered"), given("location", F.concat(w(" at "), c("location"))), w(" on "), F.coalesce(F.nullif(c("delivered_at"), w("")), w("today")), w(".")),
        ),
        "exception_detected": text(
            (w("Action needed: shipment "), c("number"), w(" has an exception")),
            (w("An exception was reported for shipment "), c("number"), w(": "), F.coalesce(F.nullif(c("detail"), w("")), w("please check the tracking page for details."))),
        ),
        "bulk_upload_completed": text(
            (w("Bulk upload complete — "), c("imported"), w(" imported, "), c("skipped"), w(" skipped")),
            (w("Your bulk upload job #"), c("job"), w(" finished. "), c("imported"), w(" shipment(s) were imported successfully, "), c("skipped"), w(" were skipped (see the import queue for details).")),
        ),
        "password_reset": text(
            (w(f"Your {brand} password was reset"),),
            (w("Your password was reset by an administrator. "), given("must_change", w("You will be asked to set a new password on next login."))),
        ),
    }
    return F.coalesce(*(F.when(event == name, value) for name, value in texts.items()))


def party(name: Column, company: Column, attention: Column, address: Column, city: Column, state: Column, country: Column, postal: Column, contact: Column) -> Column:
    """A party's box: lines if name and address are there, else what there is in one paragraph."""
    name, company, attention, address, city, state, country, postal, contact = (clean(c) for c in (name, company, attention, address, city, state, country, postal, contact))
    place = F.nullif(F.concat_ws(", ", city, state, postal), F.lit(""))
    phone = F.concat(F.lit("Tel: "), contact)
    lines = F.concat_ws("\n", F.when(attention != name, F.concat(F.lit("Attn: "), attention)), name, F.when(company != name, company), address, place, F.upper(country), phone)
    paragraph = F.concat_ws(" • ", name, company, attention, address, place, country, phone)
    return F.when(name.isNotNull() & address.isNotNull(), lines).otherwise(F.coalesce(F.nullif(paragraph, F.lit("")), F.lit("Details not available")))


def place_cell(code: Column, city: Column, country: Column, default_city: str | None = None, default_country: str | None = None) -> Column:
    """A station's code, else "city, country" with defaults for what is missing."""
    city, country = F.coalesce(clean(city), F.lit(default_city).cast("string")), F.coalesce(clean(country), F.lit(default_country).cast("string"))
    return F.coalesce(clean(code), F.when(city.isNotNull(), F.concat_ws(", ", city, F.coalesce(country, F.lit(_DASH)))), country, F.lit(_DASH))


def weight_cell(preferred: Column, other: Column, unit: Column) -> Column:
    weight = F.coalesce(preferred, other)
    number = F.regexp_replace(weight.cast("string"), r"\.0$", "")
    return F.coalesce(F.concat(number, F.lit(" "), F.coalesce(clean(unit), F.lit("kg"))), F.lit(_DASH))


def value_cell(value: Column, currency: Column) -> Column:
    """Currency and number with thousands apart, at most three decimals."""
    number = F.regexp_replace(F.format_number(value, 3), r"\.?0+$", "")
    return F.coalesce(F.concat(F.coalesce(clean(currency), F.lit("INR")), F.lit(" "), number), F.lit(_DASH))


def password_errors(password: Column, least: int = 10) -> Column:
    p = F.coalesce(password, F.lit(""))
    rules = ((r"[A-Z]", "an uppercase letter"), (r"[a-z]", "a lowercase letter"), (r"[0-9]", "a number"), (r"[^A-Za-z0-9]", "a symbol"))
    return F.array_compact(F.array(F.when(F.length(p) < least, f"Must be at least {least} characters"), *(F.when(~p.rlike(r), f"Must contain {what}") for r, what in rules)))


def expired(changed_at: Column, now: Column, days: int = 90) -> Column:
    """Whether a password is older than the days; one without a date isn't."""
    return F.coalesce(now > changed_at + F.make_interval(days=F.lit(days)), F.lit(False))


def without_fence(text: Column) -> Column:
    """A reply's JSON without the fence of a code block around it."""
    t = F.trim(text)
    return F.when(F.startswith(t, F.lit("```")), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"```\s*$", "")).otherwise(t)
