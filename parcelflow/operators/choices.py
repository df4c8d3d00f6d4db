"""Choices: of pages read, of events, of lines; values that go before others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_blank

# Words that tell a waybill's text from noise; the least text of its own that is used; pages looked at.
KNOWN_WORDS = (
    "kg", "tracking", "ship", "origin", "fedex", "ups", "dhl", "waybill", "from", "date", "dims", "actwgt", "trk", "billing", "desc",
    "ship date", "trk#", "ship to", "origin id", "weight", "pieces", "contents", "sender", "consignee", "recipient", "express",
)
LEAST_CHARS, LEAST_HITS, MOST_PAGES = 40, 2, 3


def known_word_hits(text: Column) -> Column:
    """How many of KNOWN_WORDS the text holds, letter case aside; 0 for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, KNOWN_WORDS)), lambda w: F.contains(low, w)))


def usable(text: Column) -> Column:
    """The text of a file itself, if it is long enough and holds known words; else null."""
    trimmed = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return F.when((trimmed >= LEAST_CHARS) & (known_word_hits(text) >= LEAST_HITS), text)


def best_page(pages: DataFrame) -> DataFrame:
    """doc, page, text and hits of the page with most known words among the first MOST_PAGES; the first of equals."""
    scored = pages.where(F.col("page") <= MOST_PAGES).withColumn("hits", known_word_hits(F.col("text")))
    best = scored.groupBy("doc").agg(F.min(F.struct((-F.col("hits")).alias("less"), "page", "text")).alias("best"))
    return best.select("doc", "best.page", "best.text", (-F.col("best.less")).alias("hits"))


def longest_page(pages: DataFrame) -> DataFrame:
    """doc, page and text of the longest page; the first of equals."""
    length = F.length(F.coalesce("text", F.lit("")))
    best = pages.groupBy("doc").agg(F.min(F.struct((-length).alias("less"), "page", "text")).alias("best"))
    return best.select("doc", "best.page", "best.text")


def caps_first(lines: Column, caps: Column) -> Column:
    """The lines whose flag in caps is set before the others, each in their order."""
    pairs = F.arrays_zip(lines.alias("line"), caps.alias("flag"))
    flagged, others = F.filter(pairs, lambda p: F.coalesce(p["flag"], F.lit(False))), F.filter(pairs, lambda p: ~F.coalesce(p["flag"], F.lit(False)))
    return F.transform(F.concat(flagged, others), lambda p: p["line"])


def told_now(shipments: DataFrame, events: DataFrame) -> DataFrame:
    """shipments with current: its own tracking_status, else that of its newest event."""
    newest = events.groupBy("ge_tracking_number").agg(F.max_by("status", F.struct("event_timestamp", "id")).alias("newest"))
    return shipments.join(newest, "ge_tracking_number", "left").withColumn("current", F.coalesce(F.nullif("tracking_status", F.lit("")), "newest")).drop("newest")


def prefer_new(old: Column, new: Column) -> Column:
    """The new value unless it is blank."""
    return F.when(~is_blank(new.cast("string")), new).otherwise(old)


def prefer_given(old: Column, new: Column) -> Column:
    """The new value unless it is null; '' does replace."""
    return F.coalesce(new, old)


def parsed_list(text: Column) -> Column:
    """The strings of a JSON list; empty for null and for what isn't one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def registered(shipments: DataFrame, found: DataFrame, provider: str) -> DataFrame:
    """shipments after registration: found(id, carrier, code) names carriers that have none and sets the code."""
    new = found.select("id", F.col("carrier").alias("found"), F.col("code").cast("string").alias("carrier_code"), F.lit(provider).alias("code_provider"))
    done = F.col("code_provider").isNotNull()
    joined = shipments.join(new, "id", "left").withColumn("carrier", F.coalesce("carrier", "found")).drop("found")
    return joined.withColumns({"tracking_registered": F.when(done, 1).otherwise(F.col("tracking_registered")), "manual_tracking": F.when(done, 0).otherwise(F.col("manual_tracking"))})
