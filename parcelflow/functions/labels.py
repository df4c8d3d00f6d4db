"""Fields of waybill text, by expressions: which carrier's layout it is, and the fields that patterns give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import let

# Carriers in the order of detection, with words (upper case) and a pattern; any of them decides.
LAYOUTS = (
    ("FedEx", ("FEDEX", "FED EX", "FEDERAL EXPRESS", "TRK#", "ACTWGT", "ACTWG T"), None),
    ("DHL", ("EXPRESS WORLDWIDE", "DHL A\\C", "DHL A/C", "WAYBILL DOC", "WAYBILL WPX"), r"(?i)WAYBILL\s+\d{2}\s+\d{4}\s+\d{4}"),
    ("UPS", ("UPS SAVER", "UPS WORLDWIDE", "UPS EXPRESS", "SHP WT:", "SHP#:"), r"(?i)TRACKING\s*#[:\s]+1Z"),
    ("Aramex", ("ARAMEX",), r"(?is)^(?=.*\*\d{8,14}\*)(?=.*(?:PPX|EXP|FORWARDER AIRWAYBILL|FORWARD AIR))"),
)
# Telephone numbers (what they begin with is looked at first, as it is cheap), currencies, services and hints of carriers without a layout of their own.
PHONE = (
    r"(?=[+(\d])(?<!\d)(\+?(?:91|971|968|966|974|973|965)[-\s]?\d{8,10}|\+?1[-\s]?[2-9]\d{9}|[6-9]\d{9}|\+?[0-9]{2,4}[-\s]\d{6,12}|\(\d{3}\)\s*\d{3}[-\s]\d{4})(?!\d)"
)
VALUES = (r"(?i)Custom\s*Val\s*:?\s*([0-9,]+\.?[0-9]*)\s*(INR|USD|GBP|EUR|AUD|CAD|SGD|AED)?", r"(?i)(?:CUSTOMS\s*VALUE|DECLARED\s*VALUE)[:\s=]+([0-9,.]+)\s*(INR|USD|GBP|EUR|AUD|CAD|SGD)?")
SERVICES = {
    "FedEx": {"INTERNATIONAL PRIORITY": "International Priority", "INTERNATIONAL ECONOMY": "International Economy", "PRIORITY OVERNIGHT": "Priority Overnight", "IP EOD": "Ip Eod"},
    "UPS": {"UPS SAVER": "UPS Saver", "UPS WORLDWIDE": "UPS Worldwide", "UPS EXPRESS": "UPS Express"},
}
HINTS = {"BLUEDART": "BlueDart", "BLUE DART": "BlueDart", "DTDC": "DTDC"}
#: Words that begin another label's line.
NEXT_LABEL = r"(?i)^(Shipper|Receiver|WAYBILL|Ref\d?\s*:|Custom|Payment|Product|FRT|Duty|DHL|INCOTERM|Features|\*)"


def layout(text: Column) -> Column:
    def of(upper: Column) -> Column:
        out = F.lit("Generic")
        for name, words, pattern in reversed(LAYOUTS):
            hit = F.lit(False)
            for w in words:
                hit |= F.contains(upper, F.lit(w))
            out = F.when(hit | text.rlike(pattern) if pattern else hit, name).otherwise(out)
        return out

    return let(F.upper(text), of)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def pieces_in_pairs(text: Column) -> Column:
    """m of the first n/m with 1 <= n <= m."""
    firsts, lasts = (F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{1,2})\s*/\s*(\d{1,2})(?!\d)"), F.lit(k)) for k in (1, 2))
    pairs = F.filter(F.zip_with(firsts, lasts, lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))), lambda p: (p["a"] >= 1) & (p["a"] <= p["b"]))
    return F.try_element_at(pairs, F.lit(1))["b"]


def phones(text: Column) -> Column:
    """Telephone numbers of 8 to 15 digits in the order of the text, without separators."""
    raw = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1))
    bare = F.transform(raw, lambda x: F.regexp_replace(x, r"[\s\-()]", ""))
    return F.filter(bare, lambda x: F.length(F.regexp_replace(x, r"\D", "")).between(8, 15))


def phones_at(text: Column) -> Column:
    """As phones, each as a struct of number and at, its first character in the text (from 0).

    What stands between the matches and the matches themselves make up the text, so their lengths give the places.
    """
    raw, between = F.regexp_extract_all(text, F.lit(PHONE), F.lit(1)), F.transform(F.split(text, PHONE, -1), F.length)
    upto = lambda lengths, k: F.aggregate(F.slice(lengths, 1, k), F.lit(0), lambda a, x: a + x)
    at = lambda k: upto(between, k + 1) + upto(F.transform(raw, F.length), k)
    found = F.transform(raw, lambda x, k: F.struct(F.regexp_replace(x, r"[\s\-()]", "").alias("number"), at(k).alias("at")))
    return F.filter(found, lambda x: F.length(F.regexp_replace(x["number"], r"\D", "")).between(8, 15))


def dimensions(text: Column) -> Column:
    """{"l", "w", "h", "unit"} as JSON: of "DIMS: LxWxH unit", else of "DWT: L,W,H"; null without either."""
    first, second = r"(?i)DIMS[:\s]+(\d+)\s*[xX×]\s*(\d+)\s*[xX×]\s*(\d+)\s*(CM|IN|MM)?", r"(?i)DWT[:\s]+(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    side = lambda pattern, k: F.regexp_extract(text, pattern, k).cast("double")
    unit = F.coalesce(F.nullif(F.lower(F.regexp_extract(text, first, 4)), F.lit("")), F.lit("cm"))
    made = lambda pattern, u: F.when(text.rlike(pattern), F.to_json(F.struct(side(pattern, 1).alias("l"), side(pattern, 2).alias("w"), side(pattern, 3).alias("h"), u.alias("unit"))))
    return F.coalesce(made(first, unit), made(second, F.lit("cm")))


def invoice(text: Column) -> Column:
    """What follows INV, if it has fewer than 30 characters."""
    number = F.nullif(F.regexp_extract(text, r"(?i)INV[:/\s]+([A-Z0-9/\-.]+)", 1), F.lit(""))
    return F.when(F.length(number) < 30, number)


def barcode(text: Column) -> Column:
    """The longest run of 8 to 14 digits between asterisks, the first of equals."""
    runs = F.regexp_extract_all(text, F.lit(r"\*(\d{8,14})\*"), F.lit(1))
    return F.aggregate(runs, F.lit(None).cast("string"), lambda best, x: F.when(best.isNull() | (F.length(x) > F.length(best)), x).otherwise(best))


def before_legal(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)CONDITIONS\s+OF\s+CARRIAGE.*", "")


def contents(text: Column, layout: Column) -> Column:
    """The first two DESC lines; of DHL's layout the line after Contents, and the next one unless it is a label."""
    lines = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)DESC\d*[:\t ]+([^\n]{3,80})"), F.lit(1)), F.trim)
    described = F.nullif(F.array_join(F.slice(F.filter(lines, lambda x: (F.length(x) > 2) & ~x.rlike(r"(?i)^DESC\d*\s*:?\s*$")), 1, 2), "; "), F.lit(""))
    own = r"(?i)Content(?:s|\s*Description)?\s*:\s*([^\n]{2,100})[^\n]*(?:\n([^\n]*)\n)?"
    parts = [F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, own, k)), ",+$", "")) for k in (1, 2)]
    named = F.nullif(F.concat_ws(" ", F.nullif(parts[0], F.lit("")), F.when(~parts[1].rlike(NEXT_LABEL), F.nullif(parts[1], F.lit("")))), F.lit(""))
    ups = F.trim(found(text, r"(?i)DESC[:\s]+([A-Z][^\n]{5,80})"))
    other = F.coalesce(described, F.trim(found(text, r"(?i)Content\s*Description[:\s]+([^\n]{3,100})")))
    return F.when(layout == "FedEx", described).when(layout == "DHL", named).when(layout == "UPS", ups).otherwise(other)


def service(text: Column, layout: Column) -> Column:
    def of(upper: Column) -> Column:
        named = lambda words: F.coalesce(*(F.when(F.contains(upper, F.lit(w)), name) for w, name in words.items()))
        kind = F.when(F.contains(upper, F.lit("DOX")), " (DOX)").when(F.contains(upper, F.lit("WPX")), " (WPX)").otherwise("")
        dhl = F.when(F.contains(upper, F.lit("EXPRESS WORLDWIDE")), F.concat(F.lit("Express Worldwide"), kind))
        return F.when(layout == "FedEx", named(SERVICES["FedEx"])).when(layout == "UPS", named(SERVICES["UPS"])).when(layout == "DHL", dhl)

    return F.when(layout.isin("FedEx", "UPS", "DHL"), let(F.upper(text), of))


def ship_date(text: Column, layout: Column) -> Column:
    """As printed: DHL's first ISO date, else the date after (SHIP) DATE."""
    short = F.coalesce(found(text, r"(?i)DATE[:\s]+(\d{1,2}\s*[A-Z]{3}\s*\d{2,4})"), found(text, r"(?i)DATE[:\s]+(\d{4}-\d{2}-\d{2})\b"))
    return F.when(layout == "DHL", F.coalesce(found(text, r"\b(\d{4}-\d{2}-\d{2})\b"), short)).otherwise(short)


def fields(text: Column, layout: Column, phones: Column) -> dict[str, Column]:
    """The fields that stand outside address blocks, by name. No number that is a telephone number is a tracking number."""
    run = lambda n: F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(rf"\b(\d{{{n}}})\b"), F.lit(1)), lambda x: ~F.array_contains(phones, x)), F.lit(1))
    spaced = lambda p: F.nullif(F.concat(*(F.regexp_extract(text, p, k) for k in (1, 2, 3))), F.lit(""))
    ups = F.upper(F.coalesce(F.regexp_replace(found(text, r"(?i)TRACKING\s*#[:\s]+(1Z[A-Z0-9\s]{14,22})\b"), r"\s+", ""), found(text, r"(?i)\b(1Z[A-Z0-9]{16})\b")))
    fedex, dhl = spaced(r"(?i)TRK\s*[#eE$sS]?\s*(\d{4})\s+(\d{4})\s+(\d{4})"), spaced(r"(?i)WAYBILL\s+(\d{2})\s+(\d{4})\s+(\d{4})")
    number = (
        F.when(layout == "FedEx", F.coalesce(fedex, found(text, r"\b(\d{12})\b")))
        .when(layout == "DHL", F.coalesce(dhl, found(text, r"\b(\d{10})\b")))
        .when(layout == "UPS", ups)
        .when(layout == "Aramex", F.coalesce(barcode(text), run(11), run(12), run(10)))
        .otherwise(F.coalesce(fedex, dhl, ups, barcode(text), run(12), run(10)))
    )
    act, shipped = (rf"(?i){w}[:\s]+([0-9]+\.?[0-9]*)\s*(KG|LB)" for w in (r"ACTW\s*S?\s*G?T", r"SHP\s*WT"))
    top = found(text, r"(?m)^([0-9]+(?:\.[0-9]+)?)\s*KG\s+[0-9]+\s+OF\s+[0-9]+")
    dhl_weight, counted = found(text, r"(?i)\b([0-9]{1,4}\.[0-9]{1,2})\s*KG\b"), found(text, r"(?i)([0-9]+\.?[0-9]*)\s*KG\s+[0-9]+/[0-9]+")
    kilos = F.when(layout == "FedEx", found(text, act)).when(layout == "UPS", F.coalesce(found(text, shipped), top)).when(layout == "DHL", dhl_weight).otherwise(F.coalesce(found(text, act), found(text, shipped), top, counted, dhl_weight)).try_cast("double")
    unit = F.when(layout == "FedEx", found(text, act, 2)).when(layout == "UPS", found(text, shipped, 2)).when(layout != "DHL", found(text, act, 2))
    value = lambda k: F.coalesce(F.when((layout == "DHL") & text.rlike(VALUES[0]), F.regexp_extract(text, VALUES[0], k)), F.when(text.rlike(VALUES[1]), F.regexp_extract(text, VALUES[1], k)))
    of = found(text, r"(?i)(\d+)\s*OF\s*(\d+)", 2).try_cast("int")
    listed = found(text, r"(?i)Pieces?\s*\n\s*(\d{1,3})\b").try_cast("int")
    hints = [F.when(F.contains(F.upper(text), F.lit(w)), name) for w, name in HINTS.items()]
    return {
        "carrier": F.when(layout != "Generic", layout).otherwise(F.coalesce(*hints)),
        "carrier_tracking_number": number,
        "ship_date": ship_date(text, layout),
        "pieces": F.coalesce(F.when(layout == "DHL", F.coalesce(pieces_in_pairs(text), listed)).otherwise(of), F.lit(1)),
        "actual_weight": kilos,
        "billing_weight": kilos,
        "weight_unit": F.lower(F.coalesce(unit, F.lit("kg"))),
        "contents": contents(text, layout),
        "service_type": service(text, layout),
        "declared_value": F.regexp_replace(value(1), ",", "").try_cast("double"),
        "currency": F.upper(F.coalesce(F.nullif(value(2), F.lit("")), F.lit("INR"))),
        "reference_number": F.when(layout == "DHL", found(text, r"(?i)Ref\s*Code\s*:\s*([A-Za-z0-9\-]{2,20})")),
    }


def confidence(ocr: Column, score: Column) -> Column:
    """Of a record: the reader's confidence and the field score, 7 to 3."""
    return F.round(0.7 * ocr + 0.3 * score, 1)


def caps_like(line: Column) -> Column:
    """At least four letters, over 85 % of them capitals."""
    n = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (n >= 4) & (F.length(F.regexp_replace(line, r"[^\p{Lu}]", "")) / F.greatest(n, F.lit(1)) > 0.85)
