"""Words and patterns of address blocks, and countries and titles as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and formats of addresses, and the names given to them, in the order in which they are tried.
COUNTRY_PATTERNS = {
    r"\bINDIA\b": "India", r"\bAUSTRALIA\b": "Australia", r"\bCANADA\b": "Canada", r"\(CA\)": "Canada", r"\bSINGAPORE\b": "Singapore", r"\(SG\)": "Singapore",
    r"HONG\s*KONG": "Hong Kong", r"\bIRELAND\b": "Ireland", r"REPUBLIC\s*OF\b": "Ireland", r"UNITED\s*STATES": "USA", r"\bUSA\b": "USA",
    r"\bUNITED\s*KINGDOM\b": "UK", r"\bUAE\b": "UAE", r"UNITED\s*ARAB": "UAE", r"\bGERMANY\b": "Germany", r"\bFRANCE\b": "France", r"\bJAPAN\b": "Japan",
    r"\bCHINA\b": "China", r"\bNEW\s*ZEALAND\b": "New Zealand", r"\bNETHERLANDS\b": "Netherlands", r"\bSWEDEN\b": "Sweden", r"\bNORWAY\b": "Norway",
    r"\bDENMARK\b": "Denmark", r"\bITALY\b": "Italy", r"\bSPAIN\b": "Spain", r"\bMALAYSIA\b": "Malaysia", r"\bTHAILAND\b": "Thailand",
    r"\bINDONESIA\b": "Indonesia", r"\bOMAN\b": "Oman", r"\bQATAR\b": "Qatar", r"\bBAHRAIN\b": "Bahrain", r"\bKUWAIT\b": "Kuwait",
    r"\bSAUDI\s*ARABIA\b": "Saudi Arabia", r"\bJORDAN\b": "Jordan", r"\bEGYPT\b": "Egypt", r"\bSRI\s*LANKA\b": "Sri Lanka", r"\bBANGLADESH\b": "Bangladesh",
    r"\bNEPAL\b": "Nepal", r"\bPAKISTAN\b": "Pakistan", r"\bPHILIPPINES\b": "Philippines", r"\bVIETNAM\b": "Vietnam", r"\bSOUTH\s*AFRICA\b": "South Africa",
    r"\bBRAZIL\b": "Brazil", r"\bMEXICO\b": "Mexico",
}
COUNTRY_CODES = {
    "IN": "India", "CA": "Canada", "US": "United States", "SG": "Singapore", "AU": "Australia", "GB": "United Kingdom", "HK": "Hong Kong", "AE": "United Arab Emirates",
    "CN": "China", "MY": "Malaysia", "DE": "Germany", "FR": "France", "JP": "Japan", "NZ": "New Zealand", "IE": "Ireland", "NL": "Netherlands", "ZA": "South Africa",
}
#: Patterns of postal codes, with the length of the second half of those that have two.
POSTAL_CODES = (
    (r"\b([A-Z]\d[A-Z])\s?(\d[A-Z]\d)\b", 3),
    (r"\b([A-Z]{1,2}\d[A-Z\d]?)\s?(\d[A-Z]{2})\b", 3),
    (r"\b([A-Z]\d{2})\s?([A-Z0-9]{4})\b", 4),
    (r"(?:^|\s)(\d{4,6})\s*[A-Z]*\s*(?:\([A-Z]{2,3}\))?\s*[a-zA-Z]{0,2}\s*$", 0),
)
CITY_STATE_POSTAL = r"^([A-Za-z][A-Za-z .]*?)-([A-Z]{2})-(\d{4,6})$"
POSTAL_CITY = r"^(\d{4,6})\s+([A-Za-z][A-Za-z\s]{1,40})$"
STREETS = r"(?i)\b(STREET|ST|AVENUE|AVE|ROAD|RD|DRIVE|DR|LANE|LN|BLVD|BOULEVARD|WAY|COURT|CT|PLACE|PL|UNIT|SUITE|STE|FLOOR|FLR|APT|BLOCK|PLOT)\b"
FORM_LABELS = r"(?i)\b(country|city|state|province|postal|zip|p\.?o\.?\s*box|address|account\s*no|reference|phone\s*number)\b"
ADDRESS_START = r"(?i)^(?:UNIT|STE|SUITE|FLOOR|FLR|APT|APARTMENT|BLDG|BLOCK|PLOT|DOOR|NO\.?|#)\b"
STATES = r"\b(TN|MH|KA|AP|TS|DL|WB|NSW|VIC|QLD|AB|ON|BC|PA|CA)\b"
STATE_WORDS = (
    "TN", "MH", "KA", "AP", "TS", "DL", "WB", "NSW", "VIC", "QLD", "AB", "ON", "BC", "PA", "CA", "ONTARIO", "QUEBEC", "ALBERTA", "MANITOBA", "SASKATCHEWAN", "DELHI",
    "VICTORIA", "QUEENSLAND", "TASMANIA", "KARNATAKA", "MAHARASHTRA", "TELANGANA", "KERALA", "GUJARAT", "PUNJAB", "RAJASTHAN",
)
STATE_NAMES = {
    "ONTARIO": "ON", "QUEBEC": "QC", "BRITISH COLUMBIA": "BC", "ALBERTA": "AB", "MANITOBA": "MB", "SASKATCHEWAN": "SK", "NOVA SCOTIA": "NS", "NEW BRUNSWICK": "NB",
    "NEWFOUNDLAND": "NL", "PRINCE EDWARD ISLAND": "PE", "NEW SOUTH WALES": "NSW", "VICTORIA": "VIC", "QUEENSLAND": "QLD", "WESTERN AUSTRALIA": "WA",
    "SOUTH AUSTRALIA": "SA", "TASMANIA": "TAS", "NORTHERN TERRITORY": "NT", "AUSTRALIAN CAPITAL TERRITORY": "ACT", "TAMIL NADU": "TN", "MAHARASHTRA": "MH",
    "KARNATAKA": "KA", "TELANGANA": "TS", "ANDHRA PRADESH": "AP", "DELHI": "DL", "WEST BENGAL": "WB",
}
LONG_STATES = (
    "Tamil Nadu", "Andhra Pradesh", "West Bengal", "Madhya Pradesh", "Uttar Pradesh", "Himachal Pradesh", "Arunachal Pradesh", "New South Wales",
    "South Australia", "Western Australia", "British Columbia", "Nova Scotia", "New Brunswick", "Northern Territory", "Prince Edward Island",
)
CITY_STATES = ("SINGAPORE", "MONACO", "HONG KONG")
METADATA = (
    r"(?im)[^\S\n]*\b(?:ACTW\s*S?\s*GT|SHIP\s*DWT|SHIP\s*DATE|DATE\s*:|TRK#|SHP\s*WT|SHP#|DWT\b|REF\s*:|REF\s*CODE|CONTACT\s*:?|DIMS\b|CAD\s*:|B?ILL\s*SENDER|EIN\s*/\s*VAT|"
    r"DESC\d*\s*:|PIECES\b|WAYBILL\b|TRACKING\s*#|FORM\b|FED\s*E?X\.?\s*$|EXPRESS\.?\s*$|\d+(?:\.\d+)?\s*(?:KG|LB)\s+\d+\s*OF\s*\d+).*$"
)
NAME_METADATA = r"(?is)\b(?:ACTW\s*S?\s*GT|SHIP\s*DATE|TRK#|SHP#|REF\s*:|CONTACT\s*:?).*$"
TITLE, PERSON = r"(?i)^(?:Mr\.|Ms\.|Mrs\.|DR\.)\s*", r"(?i)^(?:Mr|Ms|Mrs|Miss|Dr)\.?\s+\S"
ENDING_PHONE = r"[\s\-()]*\+?\d[\d\s\-()]{6,}\d\s*$"
NUMBERS_ONLY = r"^[\d+\-\s().]+$"

#: The longest word of each country's pattern: what lacks it in capitals can't match.
COUNTRY_WORDS = {p: max(re.findall("[A-Z]+", re.sub(r"\\[bs]", " ", p)), key=len) for p in COUNTRY_PATTERNS}
BLANKS = " \t\n\x0b\f\r"
LONG_STATE = r"(?i)\s+(" + "|".join(sorted(LONG_STATES, key=len, reverse=True)) + ")$"
COUNTRY_NAMES = [c.upper() for c in dict.fromkeys(COUNTRY_PATTERNS.values())]


def let(value: Column, f) -> Column:
    """f of value, which is computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def title(c: Column) -> Column:
    """Every run of letters with a capital at its start only (initcap looks at blanks alone)."""
    plain = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[A-Za-z]+$"), plain(x)).otherwise(F.initcap(x))), "")


def country(block: Column) -> Column:
    """By the order of the patterns, not of the text."""
    hit = lambda upper, p: F.contains(upper, F.lit(COUNTRY_WORDS[p])) & block.rlike("(?i)" + p)
    return let(F.upper(block), lambda upper: F.coalesce(*(F.when(hit(upper, p), name) for p, name in COUNTRY_PATTERNS.items())))
