"""Words and patterns of Aramex waybills: the thermal label, the classic form, and the grid, flat and scattered texts of others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import addresses as a

# Stations, cities and countries of the Gulf's, states that end a line, and words of the forms.
STATIONS = (
    "MAA", "BOM", "DEL", "HYD", "BLR", "CCU", "AMD", "COK", "CJB", "AUH", "DXB", "SHJ", "MCT", "DOH", "BAH", "KWI", "RUH", "JED", "LHR", "CDG", "AMS", "FRA",
    "SIN", "HKG", "SYD", "MEL", "YYZ", "YVR", "YUL", "JFK", "ORD", "LAX", "DFW", "PHL", "NRT", "ICN", "KUL", "BKK", "CGK", "MNL", "CMB", "DAC", "KTM",
)
GULF_CITIES = {"AUH": "Abu Dhabi", "DXB": "Dubai", "SHJ": "Sharjah", "MCT": "Muscat", "DOH": "Doha", "BAH": "Manama", "KWI": "Kuwait City", "RUH": "Riyadh", "JED": "Jeddah"}
GULF_COUNTRIES = {
    "AUH": "United Arab Emirates", "DXB": "United Arab Emirates", "SHJ": "United Arab Emirates", "MCT": "Oman", "DOH": "Qatar", "BAH": "Bahrain", "KWI": "Kuwait",
    "RUH": "Saudi Arabia", "JED": "Saudi Arabia",
}
ENDING_STATES = (
    "Tamil Nadu", "Andhra Pradesh", "West Bengal", "Madhya Pradesh", "Uttar Pradesh", "Himachal Pradesh", "Arunachal Pradesh", "New South Wales",
    "South Australia", "Western Australia", "British Columbia", "Nova Scotia", "New Brunswick", "Northern Territory", "Prince Edward Island",
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois",
    "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri",
    "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma",
    "Oregon", "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington",
    "West Virginia", "Wisconsin", "Wyoming", "Ontario", "Quebec", "Alberta", "Manitoba", "Saskatchewan", "Victoria", "Queensland", "Tasmania",
    "Karnataka", "Maharashtra", "Telangana", "Kerala", "Gujarat", "Punjab", "Rajasthan", "Delhi",
)
COMPANY = r"(?i)\b(LLC|LTD|PLC|INC|PTE|CORP|CO\.?|COMPANY|ENTERPRISES|INDUSTRIES|TRADING)\b"
LETTERHEAD = (
    r"(?i)^(a[qg]?ramex|forwarder|air\s*way\s*bill|ar[wv]ay\s*sel|\d*\s*from\s*\(?\s*shipper\s*\)?|shipper'?s?\s*account\s*no\.?|shipper'?s?\s*ref\.?|shipment\s*no\.?)\s*[:.]?\s*$"
)
NOT_CONTENTS = (
    r"(?i)custms?\s*value|customs\s*value|currency|description\s*of\s*goods|harmonized?\s*code|country\s*of\s*manufacture|^remarks$|^weight$|no\s*charges|cost\s*of\s*goods|bill\s*(shipper|receiver)|account"
)
VALUE = r"(?i)(\d+\.\d{2})\s+(INR|USD|GBP|EUR|AED|OMR|QAR|SAR|SGD|AUD|CAD)"
NO_STATION = ("EXP", "STD", "PPX", "DOM", "NSR", "CVG", "INT")
GLYPHS = "█▌▐▄▀▁▂▃▅▆▇■□▪▫"
FOOTER = r"(?i)Shpr\s*Ref\s*:\s*GARUDA"
BARCODE_LINE, NAME_LINE, PLACE_LINE = r"^\*\d{8,14}\*$", r"^[A-Za-z][A-Za-z .'\-]{1,60}$", r"^[A-Za-z][A-Za-z .'\-]{1,40}$"
ATTENTION = r"(?i)KIND\s*ATTN"
GRID = {
    "from": {"name": r"(?im)From\s*\(Your\s*Name\)[^\n]*\n([^\n]+)"},
    "to": {"name": r"(?im)To\s*\(Receiver\s*Name\)[^\n]*\n([^\n]+)", "company": r"(?im)^Company\s*\n([^\n]+)"},
    "both": {
        "address": r"(?im)Street\s*Address[^\n]*\n([^\n]+)", "city": r"(?im)^City\s*\n([^\n]+)", "state": r"(?im)State/Province\s*\n([^\n]+)",
        "country": r"(?im)^Country\s*\n([^\n]+)", "postal": r"(?im)ZIP/Postal\s*Code\s*\n([^\n]+)",
    },
}
SECTIONS = {
    "from": r"(?is)(?:1\s*FROM|FROM\s*\(SHIPPER\))(.*?)(?=2\s*TO\s*\(RECEIVER\)|TO\s*\(RECEIVER\))",
    "to": r"(?is)(?:2\s*TO\s*\(RECEIVER\)|TO\s*\(RECEIVER\))(.*?)(?=3\s*SHIPPER|SHIPPER'S\s*SIGNATURE|CONDITIONS\s*OF|\z)",
}
KNOWN_TOWNS, MERGED_TOWN = r"(?i)^(akkur|tamil|bangalore|mumbai|delhi|chennai)", r"(?is)City\s+State/Province.*?\n\s*([\w\s\(\)]+?)\s{2,}([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)"
SCATTERED = {"city": r"(?i)\bCity\b\s*\n+\s*([A-Za-z][A-Za-z\s\(\)\.]+)", "country": r"(?i)\bCountry\b\s*\n+\s*([A-Za-z][A-Za-z\s]+)", "company": r"(?i)\bCompany\b\s*\n+\s*([A-Za-z][^\n]+)"}

SERVICE_LINE = r"(?i)^\s*(EXP|STD|PPX|DOM)(\s+(EXP|STD|PPX|DOM))?\s*$"
ENDING_STATE = r"(?i)\s+(" + "|".join(sorted(ENDING_STATES, key=len, reverse=True)) + ")$"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), a.strip), lambda x: x != "")


def quiet_lines(text: Column) -> Column:
    """Lines without the words that a barcode's picture leaves: those with two of its glyphs or more."""
    word = rf"(?<![^ \n])[^ \n]*[{GLYPHS}][^ \n]*[{GLYPHS}][^ \n]*(?![^ \n])"
    return lines_of(F.regexp_replace(F.regexp_replace(text, word, ""), r" {2,}", " "))
