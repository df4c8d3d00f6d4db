"""Waybill text to its record in plain Python, text by text: layout, blocks, names and addresses, places, fields.

Each step depends on what the one before has found, and most patterns can't match most texts. So a word that a pattern
needs is looked for in the text's capitals first. Lines and parties recur from text to text, so what is known of the last
ones is remembered. Patterns mean what they mean to Spark (`_java`).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import groupby

import pyarrow as pa

from ..functions import addresses as a
from ..functions import aramex as ax
from ..functions import labels

#: A record's fields with their types, in order; then those that a blank record has.
FIELDS = {
    "from_name": "string", "from_address": "string", "from_contact": "string", "from_city": "string", "from_state": "string", "from_country": "string", "from_postal": "string",
    "to_name": "string", "to_address": "string", "to_contact": "string", "to_city": "string", "to_state": "string", "to_country": "string", "to_postal": "string",
    "carrier": "string", "carrier_tracking_number": "string", "ship_date": "string", "pieces": "int", "actual_weight": "double", "billing_weight": "double", "weight_unit": "string",
    "dimensions": "string", "contents": "string", "service_type": "string", "declared_value": "double", "currency": "string", "invoice_number": "string",
    "sender_company": "string", "receiver_company": "string", "receiver_attention": "string", "reference_number": "string", "customs_value": "double", "carriage_value": "double",
    "origin_code": "string", "destination_code": "string", "package_length": "double", "package_width": "double", "package_height": "double", "service_code": "string",
    "route_code": "string", "billing_type": "string", "account_number": "string", "carrier_specific": "string",
}
DEFAULTS = {"pieces": 1, "weight_unit": "kg", "currency": "INR"}

_REMEMBERED, _PARTIES = 1 << 14, 1 << 12  # lines, parties
_BREAKS = r"\n\r\x85\u2028\u2029"
_ENDS = {True: rf"(?:(?!(?<=\r)\n)(?=[{_BREAKS}]|\Z))", False: rf"(?:(?!(?<=\r)\n)(?=(?:\r\n|[{_BREAKS}])?\Z))"}
_STARTS = {True: rf"(?:(?<![^{_BREAKS}])(?!(?<=\r)\n)(?!\Z))", False: r"\A"}


def _java(pattern: str) -> re.Pattern:
    """The pattern as Java reads it: classes and cases of ASCII, boundaries beside any letter, and its ends of lines."""
    flags = re.match(r"\(\?([ims]+)\)", pattern)
    on, body = (flags[1], pattern[flags.end() :]) if flags else ("", pattern)
    out, inside, i = [], False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            pair = body[i : i + 2]
            out.append({r"\b": r"(?u:\b)", r"\z": r"\Z"}.get(pair, pair) if not inside else pair)
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "." and "s" not in on:
            c = f"[^{_BREAKS}]"
        elif c in "^$":
            c = (_STARTS if c == "^" else _ENDS)["m" in on]
        out.append(c)
        i += 1
    return re.compile("".join(out), re.ASCII | (re.I if "i" in on else 0) | (re.S if "s" in on else 0))


class _Rule:
    """A pattern with a word in capitals that each match holds: back characters after its start, or anywhere (null)."""

    def __init__(self, pattern: str, word: str, back: int | None = 0):
        self.pattern, self.word, self.back = _java(pattern), word, back


class _Text:
    """A text with its capitals, in which words are looked for before patterns."""

    def __init__(self, text: str):
        self.text, self.upper, self.lines = text, text.upper(), text.split("\n")
        self.even = len(self.text) == len(self.upper)

    def start(self, rule: _Rule) -> int:
        """Where the first match can begin; negative if there is none."""
        at = self.upper.find(rule.word)
        return at if at <= 0 else max(0, at - rule.back) if self.even and rule.back is not None else 0

    def search(self, rule: _Rule) -> re.Match | None:
        return rule.pattern.search(self.text, self.start(rule)) if rule.word in self.upper else None

    def found(self, rule: _Rule, group: int = 1) -> str | None:
        match = rule.pattern.search(self.text, self.start(rule)) if rule.word in self.upper else None
        return (match[group] or None) if match else None


def _group(match: re.Match | None, group: int = 1) -> str | None:
    return (match[group] or None) if match else None


def _strip(text: str | None) -> str | None:
    return None if text is None else text.strip(a.BLANKS)


def _at(lines: list | None, n: int | None):
    """The nth line, from 1; null where there is none."""
    return lines[n - 1] if lines is not None and n is not None and 1 <= n <= len(lines) else None


def _first(lines: list[str], pattern: re.Pattern, initials: str) -> int | None:
    """The place of the first line that matches, from 1; null without one. initials: the letters that it can begin with."""
    for i, x in enumerate(lines, 1):
        if x and x[0] in initials and pattern.search(x):
            return i
    return None


def _double(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def _int(text: str | None) -> int | None:
    digits = None if text is None else text.lstrip("0") or "0"
    return int(digits) if digits and len(digits) <= 10 and int(digits) < 1 << 31 else None


def _lines_of(text: str | None) -> list[str] | None:
    return None if text is None else [y for y in (x.strip(a.BLANKS) for x in text.split("\n")) if y]


def _title(text: str | None) -> str | None:
    """Every run of letters with a capital at its start only."""
    if text is None or text.isascii():
        return text and text.title()
    runs = ((letters, "".join(run)) for letters, run in groupby(text, str.isalpha))
    return "".join(run[:1].title() + run[1:].lower() if letters else run for letters, run in runs)


def _is_word(c: str) -> bool:
    return c == "_" or c.isalnum()


_LONG_RUN = re.compile(r"\d{10,}", re.ASCII)


def _numbers(text: str) -> list[str]:
    """Runs of 10 to 12 digits that stand alone, in the order of the text."""
    alone = lambda m: (m.start() == 0 or not _is_word(text[m.start() - 1])) and (m.end() == len(text) or not _is_word(text[m.end()]))
    return [m[0] for m in _LONG_RUN.finditer(text) if len(m[0]) <= 12 and alone(m)]


_BARCODE = re.compile(r"\*(\d{8,14})\*", re.ASCII)


def _barcode(text: str) -> str | None:
    """The longest run of digits between asterisks, the first of equals."""
    return max(_BARCODE.findall(text), key=len, default=None) if "*" in text else None


_PHONE, _LONG, _AREA = _java(labels.PHONE.removeprefix(r"(?=[+(\d])")), re.compile(r"\d{6,}", re.ASCII), re.compile(r"\(\d{3}\)", re.ASCII)
_PREFIX = re.compile(r"(?<!\d)\d{1,4}[-\s]\Z", re.ASCII)
_SEPARATORS = re.compile(r"[\s\-()]", re.ASCII)


def _phone_starts(text: str) -> list[int]:
    """Where telephone numbers may begin: at a run of six digits or more, or a short one beside it, or at an area in brackets."""
    out = []
    for m in _LONG.finditer(text):
        start = m.start()
        if start and text[start - 1] in "- \t\n\x0b\f\r":
            prefix = _PREFIX.search(text[max(0, start - 6) : start])
            if prefix:
                at = max(0, start - 6) + prefix.start()
                out += (at - 1, at) if at and text[at - 1] == "+" else (at,)
        out += (start - 1, start) if start and text[start - 1] == "+" else (start,)
    if "(" in text:
        out = sorted({*out, *(m.start() for m in _AREA.finditer(text))})
    return out


def _phones_at(text: str) -> list[tuple[str, int]]:
    """Telephone numbers of 8 to 15 digits without separators, and where they stand."""
    out, upto = [], 0
    for at in _phone_starts(text):
        hit = _PHONE.match(text, at) if at >= upto else None
        if hit:
            number, upto = hit[1] if hit[1].isdigit() else _SEPARATORS.sub("", hit[1]), hit.end()
            if 8 <= len(number.lstrip("+")) <= 15:
                out.append((number, at))
    return out


def _phones(text: str | None) -> list[str]:
    return [number for number, _ in _phones_at(text)] if text else []


_LEGAL = _Rule(r"(?is)CONDITIONS\s+OF\s+CARRIAGE", "CONDITIONS")
_LAYOUT_PATTERNS = {name: _Rule(pattern, {"DHL": "WAYBILL", "UPS": "TRACKING"}[name]) for name, _, pattern in labels.LAYOUTS if name in ("DHL", "UPS")}
_FORWARDED = _Rule(r"(?i)FORWARDER AIRWAYBILL|FORWARD AIR", "FORWARD")


def _layout(text: _Text) -> str:
    for name, words, _ in labels.LAYOUTS:
        for w in words:
            if w in text.upper:
                return name
        if name in _LAYOUT_PATTERNS and text.search(_LAYOUT_PATTERNS[name]):
            return name
        if name == "Aramex" and "*" in text.text and _BARCODE.search(text.text):
            if "PPX" in text.upper or "EXP" in text.upper or text.search(_FORWARDED):
                return name
    return "Generic"


# Blocks: for each kind the start, the words of which a line that ends it begins with one, that line, and most lines.
_TO_END = (("ACTWGT", "TRK#", "DIMS", "DESC", "FROM", "REF"), r"ACTWGT|TRK#|DIMS\b|DESC\d|FROM\s|REF\s*:", 8)
_BLOCKS = {
    "ORIGIN": (_Rule(r"(?i)ORIGIN\s*ID[:\s]*\S*\s*", "ORIGIN"), ("SHIP", "TO", "TRK#", "REF"), r"SHIP\s*DATE|TO\s+[A-Z]|TRK#|REF\s*:", 7),
    "From": (_Rule(r"(?i)From\s*:\s*", "FROM"), ("TO", "RECEIVER"), r"(?:To|Receiver)\s*:", 8),
    "Shipper": (_Rule(r"(?i)Shipper\s*:\s*", "SHIPPER"), ("RECEIVER",), r"Receiver\s*:", 8),
    "TO": (_Rule(r"(?i)(?:^|\n)TO\s+", "TO", None), *_TO_END),
    "TO joined": (_Rule(r"(?i)(?:^|\n)TO(?=[A-Z]{2,})", "TO", None), *_TO_END),
    "To": (_Rule(r"(?i)(?:^|\n)To\s*:\s*", "TO", None), ("ORIGIN", "HKGO", "SINO", "CVGH"), r"Origin\s*:|HKGO|SINO|CVGH", 7),
    "Receiver": (
        _Rule(r"(?i)Receiver\s*:\s*", "RECEIVER"), ("SHIPPER", "WAYBILL", "TRK#", "TRACKING", "SINO", "HKGO", "CVGH", "PRODUCT", "PAYER", "SHIPMENT"),
        r"Shipper\s*:|WAYBILL|TRK#|TRACKING|SINO|HKGO|CVGH|Product\s*Details|Payer\s*Details|Shipment\s*Details", 9,
    ),
    "SHIP TO": (_Rule(r"(?i)SHIP\s*TO:\s*", "SHIP"), ("BILLING", "REFERENCE", "TRACKING"), r"BILLING|Reference\s*No|TRACKING\s*#", 8),
}
_BLOCK_ENDS = {kind: (words, _java(rf"(?im)^\s*(?:{end})")) for kind, (_, words, end, _) in _BLOCKS.items()}
_TRIED = {
    "FedEx": (("ORIGIN",), ("TO", "TO joined")),
    "DHL": (("From", "Shipper"), ("To", "Receiver")),
    "UPS": (("top",), ("SHIP TO",)),
    "Generic": (("From", "Shipper", "ORIGIN", "top"), ("To", "Receiver", "TO", "TO joined", "SHIP TO")),
}
_SENDER_ENDS, _WEIGHT_LINE = _Rule(r"(?i)SHIP\s*TO:", "SHIP"), _java(r"(?im)^\s*[0-9.]+\s*(KG|LB|OF).*$")
_ACCOUNT_FIRST, _VISIBLE = _java(r"^\s*\d{6,14}\s*\n"), re.compile(r"\S", re.ASCII)
_METADATA = _java(a.METADATA)
_METADATA_WORDS = "ACTW SHIP DATE TRK# SHP DWT REF CONTACT DIMS CAD ILL EIN DESC PIECES WAYBILL TRACKING FORM FED EXPRESS OF".split()


def _block(text: _Text, kind: str) -> tuple[str, int] | None:
    """A kind's block and its most lines; null if there is none."""
    if kind == "top":  # all above SHIP TO
        ends = text.search(_SENDER_ENDS)
        if not ends:
            return None
        block, most = _WEIGHT_LINE.sub("", text.text[: ends.start()]), 10
    else:
        start, words, _, most = _BLOCKS[kind]
        begins = text.search(start)
        if not begins:
            return None
        block, (words, ends) = text.text[begins.end() :], _BLOCK_ENDS[kind]
        capitals = text.upper[begins.end() :] if text.even else text.upper
        if any(w in capitals for w in words):
            end = ends.search(block)
            block = block[: end.start()] if end else block
        if not _VISIBLE.search(block):
            return None
    if kind == "ORIGIN":  # an account number may come first
        block = _ACCOUNT_FIRST.sub("", block, 1)
    return (block, most) if len(_strip(block)) > (5 if kind == "From" else 0) else None


def _block_lines(text: _Text, layout: str, side: int) -> list[str] | None:
    """The first lines of the side's block that aren't blank, cut at label words."""
    found = next((b for b in (_block(text, kind) for kind in _TRIED[layout][side]) if b), None)
    if not found:
        return None
    block, most = found
    capitals = block.upper()
    for w in _METADATA_WORDS:
        if w in capitals:
            block = _METADATA.sub("", block)
            break
    return _lines_of(block)[:most] or None


_COUNTRIES = [(a.COUNTRY_WORDS[p], _java("(?i)" + p), name) for p, name in a.COUNTRY_PATTERNS.items()]


def _hits(text: str) -> list[tuple[str, re.Pattern, str]]:
    """The countries whose word is in the text."""
    upper = text.upper()
    return [c for c in _COUNTRIES if c[0] in upper]


def _country(text: str, among: list) -> str | None:
    """By the order of the patterns, not of the text."""
    upper = text.upper()
    return next((name for word, pattern, name in among if word in upper and pattern.search(text)), None)


@lru_cache(_REMEMBERED)
def _country_of(line: str | None) -> str | None:
    return _country(line, _COUNTRIES) if line else None


_CONTACT, _TITLE, _NAME_METADATA, _ENDING_PHONE = _java(r"(?i)^Contact\s*:"), _java(a.TITLE), _java(a.NAME_METADATA), _java(a.ENDING_PHONE)
_NUMBERS_ONLY, _ADDRESS_START, _PERSON = _java(a.NUMBERS_ONLY), _java(a.ADDRESS_START), _java(a.PERSON)
_DIGITS = frozenset("0123456789")
_DIGIT, _BRACKETS = re.compile(r"\d", re.ASCII), _java(r"^[() ]+|[() ]+$")
_POSTAL = [(_java(p), half) for p, half in a.POSTAL_CODES]
_CITY_STATE_POSTAL, _POSTAL_CITY, _STREETS, _FORM_LABELS = _java(a.CITY_STATE_POSTAL), _java(a.POSTAL_CITY), _java(a.STREETS), _java(a.FORM_LABELS)
_EDGES, _BEHIND_EDGES, _TWO_WORDS, _COMMAS = _java(r"^[ ,.]+|[ ,.]+$"), _java(r"^[ ,.-]+|[ ,.-]+$"), _java(r"[^,\s][,\s]+[^,\s]"), re.compile(r"[,\s]+", re.ASCII)
_CITY_BEHIND, _LONG_STATE, _POSTAL_DIGITS = _java(r"^[A-Za-z][A-Za-z\s]{1,40}$"), _java(a.LONG_STATE), re.compile(r"\d{4,6}", re.ASCII)
_HONG_KONG, _ENDING_DASH, _CANADIAN, _STATES = _java(r"(?i)HONG\s*KONG"), _java(r"[\-\s]+$"), _java(r"^[A-Z]\d[A-Z]"), _java(a.STATES)
_SPACES, _NO_LETTERS = re.compile(r"\s+", re.ASCII), re.compile(r"[^A-Z0-9]")


def _person_or_company(line: str) -> str:
    """A name without title, label words and a telephone number at its end."""
    bare = _TITLE.sub("", line)
    label = _NAME_METADATA.search(bare)
    return _strip(_ENDING_PHONE.sub("", _strip(bare[: label.start()] if label else bare)))


def _fixed_form(digits: list[str]) -> tuple | None:
    """postal, city and state of the first line of the form CITY-ST-POSTAL, else POSTAL CITY; null without one.

    digits: the lines that have any.
    """
    for x in digits:
        m = _CITY_STATE_POSTAL.search(x)
        if m:
            return m[3], _title(_strip(m[1])), m[2]
    for x in digits:
        m = _POSTAL_CITY.search(x) if x[0] in "0123456789" else None
        if m and not _STREETS.search(m[2]) and not _FORM_LABELS.search(m[2]):
            return m[1], _title(_strip(m[2])), None
    return None


def _candidates(lines: list[str], forms: list[int | None], local: list[bool]) -> tuple | None:
    """postal, city and state beside the first code of which a state, country or city-state stands, else beside the first.

    What stands before the code is city and state; a lone word there is the state, and the city a line above. A city may
    also follow the code. forms: the first postal format of each line.
    """
    form, found = min((f for f in forms if f is not None), default=None), []
    for i in (i for i, f in enumerate(forms) if f is not None and f == form):
        x, (pattern, half) = lines[i], _POSTAL[form]
        m = pattern.search(x)
        bare = _SPACES.sub("", m[0])
        code = f"{bare[: len(bare) - half]} {bare[len(bare) - half :]}" if half else _POSTAL_DIGITS.search(bare)[0]
        before, behind = _EDGES.sub("", x[: m.start()]), _BEHIND_EDGES.sub("", x[m.end() :])
        words = [w for w in _COMMAS.split(before) if w]
        above = None
        if not _TWO_WORDS.search(before):
            can_be = lambda k: not (local[k] or _STREETS.search(lines[k]) or _NUMBERS_ONLY.search(lines[k]) or _FORM_LABELS.search(lines[k]))
            above = next((lines[k] for k in range(i - 1, -1, -1) if can_be(k)), None)
        n, head = len(words), words[0].upper() if words else None
        if n == 0 and _CITY_BEHIND.search(behind) and not _STREETS.search(behind) and not _FORM_LABELS.search(behind):
            one = (code, _title(behind), None, True)
        elif n >= 1 and head in a.CITY_STATES and (n > 1 or head in a.COUNTRY_NAMES):
            one = (code, words[0], None, True)
        elif n >= 2:
            one = (code, " ".join(words[:-1]), words[-1], words[-1].upper() in a.STATE_WORDS)
        elif n == 1:
            long = _group(_LONG_STATE.search(above)) if above is not None else None
            state = _title(long) if long else words[0] if head not in a.COUNTRY_NAMES else None
            one = (code, None if above is None else _LONG_STATE.sub("", above), state, head in a.COUNTRY_NAMES)
        else:
            one = (code, None, None, False)
        if one[3]:
            return one[:3]
        found.append(one[:3])
    return found[0] if found else None


@lru_cache(_REMEMBERED)
def _line(x: str) -> tuple:
    """Of a line: whether it counts, whether a name can be in it, its digits, its first postal format, and whether that or
    another form makes it a locality."""
    digits = _DIGIT.search(x) is not None
    form = next((k for k, (p, _) in enumerate(_POSTAL) if p.search(x)), None) if digits else None
    starts = not (_NUMBERS_ONLY.search(x) or _ADDRESS_START.search(x) or x[:1] in "0123456789")
    return len(x) > 1 and not _CONTACT.search(x), starts, digits, form, form is not None or (digits and _CITY_STATE_POSTAL.search(x) is not None)


def _letters(text: str) -> str:
    return _NO_LETTERS.sub("", text.upper())


@lru_cache(_PARTIES)
def _party(side: str, lines: tuple[str, ...], layout: str) -> dict:
    """A side's name, address, country, postal, city and state, and the receiver's attention."""
    own = [x for x in lines if _line(x)[0]]
    known = [_line(x) for x in own]
    at = next((i for i, k in enumerate(known, 1) if k[1]), 0)
    name = _person_or_company(own[at - 1]) or None if at else None
    upper = None if name is None else name.upper()
    skip = next((i for i in range(at, len(own)) if upper is None or _TITLE.sub("", own[i]).upper() != upper), len(own))
    made = {f"{side}_name": name}
    if side == "to":  # a person under the name
        following = own[skip] if skip < len(own) else None
        if name is not None and following is not None and _PERSON.search(following):
            made["receiver_attention"], skip = following, skip + 1
    block = "\n".join(lines)
    hits = _hits(block)
    named = _country(block, hits)
    local = [k[4] or (bool(hits) and _country(x, hits) is not None) for x, k in zip(own, known)]
    code, city, state = _fixed_form([x for x, k in zip(own, known) if k[2]]) or _candidates(own, [k[3] for k in known], local) or (None, None, None)
    if not city and named == "Hong Kong":
        k = next((i for i, x in enumerate(own) if _HONG_KONG.search(x)), 0)
        above = _ENDING_DASH.sub("", own[k - 1]) if k else None
        city = above if above and not _STREETS.search(above) else None
    city = _title(city or None)
    ends = next((i for i, x in enumerate(local[skip : skip + 8], 1) if x), 0)
    kept = own[skip : skip + (min(ends - 1, 5) if ends else 5)]
    if city is not None:
        kept = [x for x in kept if _letters(x) != _letters(city)]
    coded = a.COUNTRY_CODES.get(_BRACKETS.sub("", lines[-1]).upper()) if layout == "FedEx" else None
    made[f"{side}_country"], made[f"{side}_address"], made[f"{side}_city"] = named or coded, ", ".join(kept) or None, city
    made[f"{side}_postal"] = _SPACES.sub("", code) if code and _CANADIAN.search(code) else code
    made[f"{side}_state"] = a.STATE_NAMES.get(state.upper(), state) if state is not None else _group(_STATES.search(block))
    return made


_TRK, _WAYBILL = _Rule(r"(?i)TRK\s*[#eE$sS]?\s*(\d{4})\s+(\d{4})\s+(\d{4})", "TRK"), _Rule(r"(?i)WAYBILL\s+(\d{2})\s+(\d{4})\s+(\d{4})", "WAYBILL")
_UPS, _UPS_ALONE = _Rule(r"(?i)TRACKING\s*#[:\s]+(1Z[A-Z0-9\s]{14,22})\b", "TRACKING"), _Rule(r"(?i)\b(1Z[A-Z0-9]{16})\b", "1Z")
_ACT, _SHIPPED = (_Rule(rf"(?i){w}[:\s]+([0-9]+\.?[0-9]*)\s*(KG|LB)", word) for w, word in ((r"ACTW\s*S?\s*G?T", "ACTW"), (r"SHP\s*WT", "SHP")))
_TOP = _Rule(r"(?m)^([0-9]+(?:\.[0-9]+)?)\s*KG\s+[0-9]+\s+OF\s+[0-9]+", "KG", None)
_KILOS, _COUNTED = _Rule(r"(?i)([0-9](?<=\b[0-9])[0-9]{0,3}\.[0-9]{1,2})\s*KG\b", "KG", None), _Rule(r"(?i)([0-9][0-9]*\.?[0-9]*)\s*KG\s+[0-9]+/[0-9]+", "KG", None)
_DHL_VALUE, _VALUE = _Rule(labels.VALUES[0], "CUSTOM"), _Rule(labels.VALUES[1], "VALUE", None)
_OF, _LISTED, _PAIRS = _java(r"OF\s*(\d+)"), _Rule(r"(?i)Pieces?\s*\n\s*(\d{1,3})\b", "PIECE"), _java(r"(?<!\d)(\d{1,2})\s*/\s*(\d{1,2})(?!\d)")
_DATES = _Rule(r"(?i)DATE[:\s]+(\d{1,2}\s*[A-Z]{3}\s*\d{2,4})", "DATE"), _Rule(r"(?i)DATE[:\s]+(\d{4}-\d{2}-\d{2})\b", "DATE")
_ISO_DATE, _REFERENCE = _Rule(r"(\d(?<=\b\d)\d{3}-\d{2}-\d{2})\b", "-", None), _Rule(r"(?i)Ref\s*Code\s*:\s*([A-Za-z0-9\-]{2,20})", "REF")
_DESC, _DESC_ALONE = _java(r"(?i)DESC\d*[:\t ]+([^\n]{3,80})"), _java(r"(?i)^DESC\d*\s*:?\s*$")
_CONTENT = _Rule(r"(?i)Content(?:s|\s*Description)?\s*:\s*([^\n]{2,100})[^\n]*(?:\n([^\n]*)\n)?", "CONTENT")
_UPS_DESC, _CONTENT_DESCRIPTION = _Rule(r"(?i)DESC[:\s]+([A-Z][^\n]{5,80})", "DESC"), _Rule(r"(?i)Content\s*Description[:\s]+([^\n]{3,100})", "CONTENT")
_ENDING_COMMA, _NEXT_LABEL, _NO_NUMBER = _java(",+$"), _java(labels.NEXT_LABEL), re.compile(r"[^\d+]", re.ASCII)
_SHIPPER_CONTACT = _Rule(r"(?is)Shipper\s*:.*?Contact:\s*\n?\s*([+\d][\d\s\-]{7,15})", "SHIPPER")


def _of(text: _Text) -> str | None:
    """The second number of the first two with OF between them."""
    for m in _OF.finditer(text.upper) if "OF" in text.upper else ():
        if text.upper[: m.start()].rstrip(a.BLANKS)[-1:] in _DIGITS:
            return m[1]
    return None


def _trim(text: str | None) -> str | None:
    return None if text is None else text.strip(" ")


def _number(body: _Text, layout: str, phones: list[str]) -> str | None:
    """No number that is a telephone number is a tracking number, but for those of FedEx and DHL."""
    spaced = lambda rule: "".join(m.groups()) if (m := body.search(rule)) else None
    alone = lambda n: next((x for x in _numbers(body.text) if len(x) == n), None)

    def ups() -> str | None:
        spread = body.found(_UPS)
        found = _SPACES.sub("", spread) if spread else body.found(_UPS_ALONE)
        return found.upper() if found else None

    if layout == "FedEx":
        return spaced(_TRK) or alone(12)
    if layout == "DHL":
        return spaced(_WAYBILL) or alone(10)
    if layout == "UPS":
        return ups()
    known = set(phones)
    run = lambda n: next((x for x in _numbers(body.text) if len(x) == n and x not in known), None)
    return spaced(_TRK) or spaced(_WAYBILL) or ups() or _barcode(body.text) or run(12) or run(10)


def _contents(body: _Text, layout: str) -> str | None:
    """The first two DESC lines; of DHL's layout the line after Contents, and the next one unless it is a label."""
    if layout == "DHL":
        m = body.search(_CONTENT)
        parts = [_ENDING_COMMA.sub("", _trim((m and m[k]) or "")).strip(" ") for k in (1, 2)]
        return " ".join(x for x in (parts[0], "" if _NEXT_LABEL.search(parts[1]) else parts[1]) if x) or None
    if layout == "UPS":
        return _trim(body.found(_UPS_DESC))
    lines = [x.strip(" ") for x in _DESC.findall(body.text)] if "DESC" in body.upper else []
    described = "; ".join([x for x in lines if len(x) > 2 and not _DESC_ALONE.search(x)][:2]) or None
    return described if layout == "FedEx" or described else _trim(body.found(_CONTENT_DESCRIPTION))


def _service(body: _Text, layout: str) -> str | None:
    if layout in labels.SERVICES:
        return next((name for w, name in labels.SERVICES[layout].items() if w in body.upper), None)
    if layout == "DHL" and "EXPRESS WORLDWIDE" in body.upper:
        return "Express Worldwide" + (" (DOX)" if "DOX" in body.upper else " (WPX)" if "WPX" in body.upper else "")
    return None


def _fields(body: _Text, layout: str, phones: list[str], lines: dict[str, list[str] | None]) -> dict:
    """The fields that stand outside address blocks, of any layout but Aramex."""
    found = body.found
    if layout == "FedEx":
        kilos = found(_ACT)
    elif layout == "UPS":
        kilos = found(_SHIPPED) or found(_TOP)
    elif layout == "DHL":
        kilos = found(_KILOS)
    else:
        kilos = found(_ACT) or found(_SHIPPED) or found(_TOP) or found(_COUNTED) or found(_KILOS)
    unit = None if layout == "DHL" else found(_SHIPPED if layout == "UPS" else _ACT, 2)
    value = (body.search(_DHL_VALUE) if layout == "DHL" else None) or body.search(_VALUE)
    if layout == "DHL":
        pairs = ((int(x), int(y)) for x, y in _PAIRS.findall(body.text)) if "/" in body.text else ()
        pieces = next((y for x, y in pairs if 1 <= x <= y), None)
        pieces = _int(found(_LISTED)) if pieces is None else pieces
    else:
        pieces = _int(_of(body))
    dated = (found(_ISO_DATE) if layout == "DHL" else None) or found(_DATES[0]) or found(_DATES[1])
    nth = lambda k: phones[k] if len(phones) > k else None
    contacts = [nth(0), nth(1)]
    if layout == "FedEx":  # those of a block where it has been found
        own = [None if x is None else (_phones("\n".join(x)) or [None])[0] for x in (lines["from"], lines["to"])]
        contacts = [nth(0) if lines["from"] is None else own[0], (phones[-1] if phones else None) if lines["to"] is None else own[1]]
    elif layout == "DHL":
        shipper = _NO_NUMBER.sub("", found(_SHIPPER_CONTACT) or "")
        contacts[0] = shipper if len(shipper) >= 8 else contacts[0]
    return {
        "carrier": layout if layout != "Generic" else next((name for w, name in labels.HINTS.items() if w in body.upper), None),
        "carrier_tracking_number": _number(body, layout, phones),
        "ship_date": dated,
        "pieces": 1 if pieces is None else pieces,
        "actual_weight": _double(kilos),
        "billing_weight": _double(kilos),
        "weight_unit": (unit or "kg").lower(),
        "contents": _contents(body, layout),
        "service_type": _service(body, layout),
        "declared_value": _double((value[1] or "").replace(",", "")) if value else None,
        "currency": ((value and value[2]) or "INR").upper(),
        "reference_number": found(_REFERENCE) if layout == "DHL" else None,
        "from_contact": contacts[0],
        "to_contact": contacts[1],
    }


# Aramex texts.
_FOOTER, _TWO_BLANKS = _Rule(ax.FOOTER, "SHPR"), re.compile("  +")
_LOUD = re.compile("(?<![^ \n])[^ \nG]*[G][^ \nG]*[G][^ \n]*".replace("G", ax.GLYPHS))
_AX_VALUE, _SERVICE_LINE = _java(ax.VALUE.replace(r"(\d+\.", r"(\d\d*\.")), _java(ax.SERVICE_LINE)
_DESCRIPTION, _GOODS_WORDS = _Rule(r"(?i)Description\s+of\s+Goods[^:]*:\s*([^\n]{3,80})", "DESCRIPTION"), ("GOODS", "COMMODITY", "CONTENT")
_GOODS = _java(r"(?i)(?<!COST OF )(?:GOODS|COMMODITY|CONTENT)[:\s]+([A-Z][^\n]{3,80})")
_DIGITS_ONLY, _NOT_CONTENTS, _TWO_CODES, _COMPANY = _java(r"^[\d.\s]+$"), _java(ax.NOT_CONTENTS), _java(r"^[A-Z]{3}\s+[A-Z]{3}$"), _java(ax.COMPANY)
_PHONE_LINE, _CODE, _APART = _java(r"^\+?\d[\d\s\-]{6,}$"), _java(r"([A-Z](?<=\b[A-Z])[A-Z]{2})\b"), _java(r"[A-Z]{3}[^A-Z](?:.*[^A-Z])?[A-Z]{3}")
_ORIGIN, _DESTINATION = (_Rule(rf"(?i)\b{w}\.?\s*STN\s+([A-Z]{{3}})\b", w) for w in ("ORG", "DEST"))
_STATIONS = frozenset(ax.STATIONS)
_AX_KILOS, _AMOUNT = _Rule(r"(?i)(\d\d*\.\d+)\s*KG", "KG", None), _Rule(r"(\d(?<=\b\d)\d*\.\d{2})\b", ".", None)
_CURRENCIES = "INR USD GBP EUR AED OMR QAR SAR SGD AUD CAD".split()
_CURRENCY, _CENTS, _CENTS_ALONE = _java(rf"(?i)\b({'|'.join(_CURRENCIES)})\b"), _java(rf"(?i)\.\d{{2}}\s+(?:{'|'.join(_CURRENCIES)})"), _java(r"\.\d{2}\b")
_SLASHED, _SLASHES = _java(r"\b\d{2}/\d{2}/\d{4}\b"), _java(r"/\d{2}/\d{4}")
_WORDS, _PIECES = {w: _java(rf"{w}(?<=\b{w})\b") for w in ("EXP", "PPX")}, _Rule(r"(?i)No\.\s*of\s*Pieces\s+(\d+)", "NO.")


@lru_cache(_REMEMBERED)
def _quiet(line: str) -> str:
    """A line without the words that a barcode's picture leaves: those with two of its glyphs or more."""
    return _strip(_TWO_BLANKS.sub(" ", line if line.isascii() else _LOUD.sub("", line)))


@lru_cache(_REMEMBERED)
def _is_service(line: str) -> bool:
    return _SERVICE_LINE.search(line) is not None


@lru_cache(_REMEMBERED)
def _is_contents(line: str) -> bool:
    return len(line) >= 3 and not (_DIGITS_ONLY.search(line) or _NOT_CONTENTS.search(line) or _TWO_CODES.search(line) or _COMPANY.search(line))


def _goods(body: _Text, value: re.Match | None) -> str | None:
    """What follows the label, if it is no other label; else the line nearest to the value, above before below; else the
    nearest of three lines above the service codes."""
    starts = [at for at in map(body.upper.find, _GOODS_WORDS) if at >= 0]
    second = _GOODS.search(body.text, min(starts) if body.even else 0) if starts else None
    for m in (body.search(_DESCRIPTION), second):
        told = _strip(m[1]) if m else ""
        if told and told.upper() != "N/A" and not _NOT_CONTENTS.search(told):
            return told
    lines = body.lines
    if value:
        at = body.text.count("\n", 0, value.start()) + 1
        for k in (at - 1, at + 1, at - 2, at + 2, at - 3, at + 3, at - 4, at + 4):
            line = _strip(_at(lines, k))
            if line is not None and _is_contents(line) and not _PHONE_LINE.search(line):
                return line
    codes = next((i for i, x in enumerate(map(_is_service, lines), 1) if x), 0)
    for k in (1, 2, 3) if codes else ():
        line = _strip(_at(lines, codes - k))
        if line is not None and _is_contents(line) and "PROD" not in line.upper() and "SERVICE" not in line.upper():
            return line
    return None


@lru_cache(_REMEMBERED)
def _pair(line: str) -> tuple[str, str] | None:
    """The two codes of stations in a line without a third code."""
    codes = _CODE.findall(line)
    return (codes[0], codes[1]) if len(codes) == 2 and _STATIONS.issuperset(codes) and _APART.search(line) else None


def _pair_of_stations(text: _Text) -> tuple[str | None, str | None]:
    """Those of the first line with a pair, else of the labels."""
    pair = next(filter(None, map(_pair, text.lines)), None)
    if pair:
        return pair
    if "STN" not in text.upper:
        return None, None
    told = ((text.found(rule) or "").upper() for rule in (_ORIGIN, _DESTINATION))
    origin, destination = (c if c in _STATIONS else None for c in told)
    return origin, destination


def _common(text: _Text, body: _Text) -> dict:
    """What patterns give in any Aramex text; body is the text before its legal part."""
    money = [at for c in _CURRENCIES if (at := body.upper.find(c)) >= 0]
    value = _AX_VALUE.search(body.text) if money and _CENTS.search(body.text) else None
    origin, destination = _pair_of_stations(text)
    exp, ppx = (w in text.upper and pattern.search(text.upper) is not None for w, pattern in _WORDS.items())
    number = _barcode(text.text)
    if number is None:
        long = [x for x in _numbers(text.text) if len(x) == 11]
        known = set(_phones(text.text)) if long else ()
        number = next((x for x in long if x not in known), None)
    currency = value[2] if value else _group(_CURRENCY.search(body.text, min(money) if body.even else 0)) if money else None
    amount = value[1] if value else body.found(_AMOUNT) if _CENTS_ALONE.search(body.text) else None
    weight = _double(body.found(_AX_KILOS))
    slashes = (m.start() for m in _SLASHES.finditer(body.text)) if "/" in body.text else ()
    dated = next((m for at in slashes if at > 1 and (m := _SLASHED.match(body.text, at - 2))), None)
    return {
        "carrier_tracking_number": number,
        "actual_weight": weight,
        "billing_weight": weight,
        "ship_date": dated[0] if dated else text.found(_DATES[0]),
        "contents": _goods(body, value),
        "declared_value": _double(amount),
        "currency": currency.upper() if currency else None,
        "service_type": "Express" if exp else None,
        "billing_type": "Prepaid" if ppx else None,
        "pieces": _int(text.found(_PIECES) or _of(text)),
        "origin_code": origin,
        "destination_code": destination,
    }


_BARCODE_LINE, _ACCOUNT_LINE, _TO_LINE, _TO_LABEL, _NAME_LINE, _PLACE_LINE = (_java(p) for p in (ax.BARCODE_LINE, r"(?i)^Account\s*:\s*\d+$", r"(?i)^To\s*:\s*\S", r"(?i)^To\s*:\s*", ax.NAME_LINE, ax.PLACE_LINE))
_DASHED, _PICKUP, _THREE = _java(r"^[A-Za-z][A-Za-z\s]*-$"), _java(r"^Destination\s*:\s*Pickup\s*Date\s*:\s*(\d{1,2}/\d{1,2}/\d{4})"), _java("^[A-Z]{3}$")
_WEIGHTS = _Rule(r"(?is)Weight\s*:\s*([\d.]+)\s*KG.*?Chargeable\s*:\s*([\d.]+)\s*KG", "WEIGHT")
_DESCRIBED = _Rule(r"(?i)Description\s*:\s*([^\n]*?)\s*Custom\s*Value\s*:\s*([\d,]+\.?\d*)\s*([A-Z]{3})?\s*\n\s*([^\n]*)", "DESCRIPTION")
_NO_GOODS, _TOWN = _java(r"(?i)^(Cash|From|Account|Pieces|To|Tel|Mob)\b"), _java(r"^([A-Za-z][A-Za-z\s]*?)\s+([A-Za-z][A-Za-z\s]*)$")
_LABEL_PIECES, _ACCOUNT, _EDGE, _DASH = _Rule(r"(?i)Pieces\s*:\s*(\d+)", "PIECES"), _Rule(r"(?i)Account\s*:\s*(\d+)", "ACCOUNT"), _java(r"[-, ]+$"), _java("-$")
_TELEPHONES = (
    (_Rule(r"(?i)Account\s*:", "ACCOUNT"), ("TEL",), _java(r"(?i)Tel\s*:\s*(\+?\d[\d\s]{6,15})")),
    (_Rule(r"(?i)To\s*:", "TO"), ("TEL", "MOB"), _java(r"(?i)(?:Tel|Mob)\s*:\s*(\+?\d[\d\s]{6,15})")),
)


def _telephone(text: _Text, label: _Rule, words: tuple[str, ...], pattern: re.Pattern) -> str | None:
    """The number of the first of the words after the label."""
    begins = text.search(label)
    starts = [at for w in words if (at := text.upper.find(w, begins.end() if text.even else 0)) >= 0] if begins else ()
    number = _group(pattern.search(text.text, min(starts) if text.even else begins.end())) if starts else None
    return _SPACES.sub("", number) if number else None


def _thermal(text: _Text) -> dict | None:
    """The label whose footer names the shipper's reference: label and value rows, in lines without a barcode's glyphs;
    null if nothing is found."""
    if not text.search(_FOOTER):
        return None
    lines = list(filter(None, map(_quiet, text.lines)))
    code, account, to = _first(lines, _BARCODE_LINE, "*"), _first(lines, _ACCOUNT_LINE, "Aa"), _first(lines, _TO_LINE, "Tt")
    line = lambda n, k: None if n is None else _at(lines, n + k)
    fits = lambda x, pattern: x if x is not None and pattern.search(x) else None
    sender = fits(line(account, 1), _NAME_LINE)
    receiver = None if to is None else _strip(_TO_LABEL.sub("", lines[to - 1]))
    address = None if account is None else account + 2 + (sender is not None and line(account, 2) == sender)
    below, dash, kept = [], None, 0
    if to is not None:
        begin = to + 1 + (line(to, 1) == receiver)
        below = lines[begin - 1 : begin + 3]
        dash = next((i for i, x in enumerate(below, 1) if "-" in x and _DASHED.search(x)), None)
        kept = min(3 if dash is None else dash - 1, 3, len(below))
    pickup = _group(_PICKUP.search(line(code, 1) or ""))
    weights, goods = text.search(_WEIGHTS), text.search(_DESCRIBED)
    contents = None
    if goods:
        first, second = _strip(goods[1]), _strip(goods[4])
        contents = _strip(f"{first} {second}" if second and not _NO_GOODS.search(second) else first) or None
    town = _TOWN.search(line(address, 1) or "") if sender is not None else None
    from_country = _country_of(town[2]) if town else None
    made = {
        "origin_code": fits(line(code, -1), _THREE),
        "destination_code": fits(line(code, 2), _THREE) if pickup else None,
        "ship_date": pickup,
        "actual_weight": _double(_group(weights, 1)),
        "billing_weight": _double(_group(weights, 2)),
        "contents": contents,
        "declared_value": _double(goods[2].replace(",", "")) if goods else None,
        "currency": _group(goods, 3),
        "pieces": _int(text.found(_LABEL_PIECES)),
        "account_number": text.found(_ACCOUNT),
        "from_name": sender,
        "from_address": _strip(_EDGE.sub("", _at(lines, address))) if sender is not None and _at(lines, address) is not None else None,
        "from_city": _strip(town[1]) if from_country else None,
        "from_country": from_country,
        "from_contact": _telephone(text, *_TELEPHONES[0]),
        "to_name": receiver or None,
        "to_address": " ".join(below[:kept]) or None,
        "to_city": _strip(_DASH.sub("", below[dash - 1])) if dash else None,
        "to_country": _country_of(_at(lines, begin + kept + 1)) if to is not None else None,
        "to_contact": _telephone(text, *_TELEPHONES[1]),
    }
    seen = ("origin_code", "ship_date", "actual_weight", "declared_value", "pieces", "account_number", "from_name", "to_name")
    return made if any(made[c] is not None for c in seen) else None


_SHORT_NUMBER, _WITH_PHONE, _WITH_CODE, _TWO_PHONES = (_java(p) for p in (r"^(\d{5,12})$", r"^(.+?)\s+(\+?\d{7,15})$", r"^(.+?)\s+([\w\-]{3,10})$", r"^(\+?\d{7,15})\s+\+?\d{7,15}$"))
_ENDING_STATE, _LAST_WORD, _LINE_DASH, _DAY = _java(ax.ENDING_STATE), _java(r"(?s)^(.*) (\S+)$"), _java(r"-\s*$"), _java(r"^\d{2}/\d{2}/\d{4}$")
_STATE_NAMES = {s.lower(): s for s in ax.ENDING_STATES}
_PAIR, _PIECES_WEIGHTS, _MONEY = _java(r"^([A-Z]{3})\s+([A-Z]{3})$"), _java(r"(?i)^(\d{1,3})\s+([\d.]+)\s*KG\s+([\d.]+)\s*KG$"), _java(r"^([\d,]+\.\d{2})\s+([A-Z]{3})$")


@lru_cache(_REMEMBERED)
def _town_and_state(line: str) -> tuple[str, str | None]:
    """A line's town and the state that ends it: one of the known names, else the last word."""
    m = _ENDING_STATE.search(line)
    last = _LAST_WORD.search(line)
    if m:
        return _strip(_ENDING_STATE.sub("", line)), _STATE_NAMES[m[1].lower()]
    return (_strip(last[1]), last[2]) if last else (_strip(line), None)


def _classic(text: _Text, body: _Text, contents: str | None) -> dict | None:
    """The form in two blocks of lines by position: one at the top, which must begin with an account number and, two
    lines on, a name with its telephone number; the other after the barcode, wherever that stands. Null if nothing is found.

    contents: what is known of them already.
    """
    lines = [y for y in map(_strip, text.lines) if y]
    top = lines if text is body else [y for y in map(_strip, body.lines) if y]
    code = _first(lines, _BARCODE_LINE, "*")
    signed, sender = (_SHORT_NUMBER.search(top[0]), _WITH_PHONE.search(top[2])) if len(top) >= 15 else (None, None)
    low = lambda k: None if code is None else _at(lines, code + k)
    of = lambda k, pattern: pattern.search(low(k) or "")
    pair, weights, value = of(1, _PAIR), of(2, _PIECES_WEIGHTS), of(4, _MONEY)
    real = pair and pair[1] not in ax.NO_STATION and pair[2] not in ax.NO_STATION
    made = {
        "origin_code": pair[1] if real else None,
        "destination_code": pair[2] if real else None,
        "pieces": _int(_group(weights, 1)),
        "actual_weight": _double(_group(weights, 2)),
        "billing_weight": _double(_group(weights, 3)),
        "contents": low(3) if contents is None and low(3) is not None and not _NOT_CONTENTS.search(low(3)) else None,
        "declared_value": _double(value[1].replace(",", "")) if value else None,
        "currency": _group(value, 2),
    }
    if signed and sender:
        fits = lambda k, pattern: top[k] if pattern.search(top[k]) else None
        undashed = lambda k: _strip(_LINE_DASH.sub("", top[k])) or None
        short, long = fits(7, _NAME_LINE), fits(9, _NAME_LINE)
        made |= {"account_number": signed[1], "from_name": _strip(sender[1]), "from_contact": sender[2]}
        made |= {"from_address": undashed(4), "to_name": long if long is not None and len(long) > len(short or "") else short, "to_address": undashed(10)}
        made["from_city"], made["from_state"] = _town_and_state(top[5])
        made |= {"to_state": fits(11, _PLACE_LINE), "to_city": fits(12, _PLACE_LINE), "ship_date": fits(14, _DAY), "to_contact": _group(_TWO_PHONES.search(top[8]))}
        for side, k in (("from", 6), ("to", 13)):
            m = _WITH_CODE.search(top[k])
            made[f"{side}_country"] = (_country_of(m[1]) or _strip(m[1])) if m else None
            made[f"{side}_postal"] = _group(m, 2)
    return made if any(made.get(c) is not None for c in ("account_number", "origin_code", "pieces", "contents", "declared_value")) else None


_SECTIONS = {side: _Rule(pattern, "(RECEIVER)", None) for side, pattern in ax.SECTIONS.items()}
_GRID_WORDS = {"company": "COMPANY", "address": "STREET", "city": "CITY", "state": "STATE/PROVINCE", "country": "COUNTRY", "postal": "ZIP"}
_GRID = {side: {n: _Rule(p, _GRID_WORDS.get(n, side.upper())) for n, p in (ax.GRID[side] | ax.GRID["both"]).items()} for side in ("from", "to")}
_KNOWN_TOWNS, _MERGED_TOWN = _java(ax.KNOWN_TOWNS), _java(ax.MERGED_TOWN)
_UPPER_ENDS, _ONE_X, _LETTERHEAD = _java(r"(?i)KIND\s*ATTN|\*\d{8,14}\*|\d\s*TO\s*\(RECEIVER\)"), _java(r"(?i)^X$"), _java(ax.LETTERHEAD)
_NOTE, _NOTED = _Rule(r"(?is)Shipper\s*:\s*(.*?)(?=\nReceiver\s*:|\z)", "SHIPPER"), _Rule(r"(?i)(KIND\s*ATTN[^\n]*\n(?:(?!CONDITIONS\s*OF|SHIPPER|ARAMEX\s+will)[^\n]+\n){0,8})", "KIND")
_ATTENTION, _BELOW = _Rule(ax.ATTENTION, "KIND"), _java(r"(?is)\*\d{8,14}\*\s*\n(.*?)(?=\n[A-Z]{3}\s+[A-Z]{3}|\z)")
_SCATTERED, _WIDE = {k: _Rule(p, k.upper()) for k, p in ax.SCATTERED.items()}, _java(r"\s{2,}.*$")


def _caps_like(line: str) -> bool:
    """At least four letters, over 85 % of them capitals."""
    n = sum(map(str.isalpha, line))
    capitals = sum(map(str.isupper, line)) if line.isascii() else sum(unicodedata.category(c) == "Lu" for c in line)
    return n >= 4 and capitals / n > 0.85


@lru_cache(_REMEMBERED)
def _is_senders(line: str) -> bool:
    return not (_DIGITS_ONLY.search(line) or _ONE_X.search(line) or _LETTERHEAD.search(line))


@lru_cache(_REMEMBERED)
def _is_low(line: str) -> bool:
    return not _caps_like(line)


@lru_cache(_REMEMBERED)
def _is_company(line: str) -> bool:
    return _COMPANY.search(line) is not None and not _NUMBERS_ONLY.search(line)


def _side_lines(text: _Text, body: _Text, side: str) -> list[str] | None:
    """A side's lines: the values of the grid's labels if they name a town or country, else those of the flat form."""
    section = _Text(text.found(_SECTIONS[side]) or "")
    read = {n: _strip(section.found(rule)) or None for n, rule in _GRID[side].items()}
    grid, placed = [x for x in read.values() if x is not None], read["city"] is not None or read["country"] is not None
    if side == "from":  # town and state may stand side by side, merged with the next column
        if "STATE/PROVINCE" in section.upper and not any(_KNOWN_TOWNS.search(x) for x in grid):
            merged = _MERGED_TOWN.search(section.text)
            if merged:
                grid, placed = [*grid, _strip(merged[1]), _strip(merged[2])], True
    if placed:
        return grid
    if side == "to":
        return (_lines_of(text.found(_NOTED)) or [])[:8] if text.found(_NOTED) else None
    ends = _UPPER_ENDS.search(body.text)
    above = _lines_of(body.text[: ends.start()]) if ends else []
    above = [x for x in above if _is_senders(x)]
    if above:
        return sorted(above, key=_is_low)[:14]
    return (_lines_of(text.found(_NOTE)) or [])[:5] or None


_COMPANIES = {"from": "sender_company", "to": "receiver_company"}


@lru_cache(_REMEMBERED)
def _value(found: str) -> str:
    """The first line of what stands under a label, up to a gap."""
    return _strip(_WIDE.sub("", _strip(found).split("\n")[0]))


def _scattered(body: _Text, anchor: int) -> dict[str, str | None]:
    """from_ and to_ city, country and company: the first value under such a label on each side of the anchor."""
    out = {}
    for key, rule in _SCATTERED.items():
        at = body.start(rule)
        for m in rule.pattern.finditer(body.text, at) if at >= 0 else ():
            side = "to" if m.start() > anchor else "from"
            value = _value(m[1])
            if len(value) >= 2:
                out.setdefault(_COMPANIES[side] if key == "company" else f"{side}_{key}", value)
    return out


def _countries_below(text: _Text) -> tuple[str | None, str | None]:
    """The countries of the two lines under the barcode, up to a line of two codes."""
    block = _lines_of(_group(_BELOW.search(text.text)) if "*" in text.text else None) or []
    return (_country_of(block[0]), _country_of(block[1])) if len(block) >= 2 else (None, None)


def _aramex(text: _Text, body: _Text) -> dict:
    """The record of Aramex texts: patterns first, then the kind's own reading, blocks, scattered labels, codes."""
    common, thermal = _common(text, body), _thermal(text)
    own = thermal or _classic(text, body, common["contents"])
    below = _countries_below(text)
    layers = [{"from_country": below[0], "to_country": below[1], "pieces": common.pop("pieces"), "currency": common.pop("currency")}]
    if not own:
        kind = body.search(_ATTENTION)
        anchor = kind.start() if kind else len(body.text) // 2
        first_at: dict[str, int] = {}
        for number, at in _phones_at(body.text):  # a number counts where it first stands
            first_at.setdefault(number, at)
        contacts: dict[str, str] = {}
        for number, at in first_at.items():
            contacts.setdefault("from_contact" if at < anchor else "to_contact", number)
        layers += [_scattered(body, anchor), contacts]
        for side in ("from", "to"):
            lines = _side_lines(text, body, side)
            if lines is None:
                continue
            k = next((i for i, x in enumerate(lines) if i > 0 and _is_company(x)), None)
            if k is not None:
                layers.append({_COMPANIES[side]: lines[k]})
                lines = lines[:k] + lines[k + 1 :]
            layers += [_party(side, tuple(lines), "Aramex")] if lines else []
            told = _phones("\n".join(lines))
            layers += [{f"{side}_contact": told[0]}] if told else []
    elif not thermal and own["declared_value"] is not None:
        common["declared_value"] = None
    origin, destination = (common[c] if common[c] is not None or not own else own[c] for c in ("origin_code", "destination_code"))
    exp, ppx = common["service_type"] is not None, common["billing_type"] is not None
    route = "null" if origin is None or destination is None else f'"{origin} {destination}"'
    made = {
        **DEFAULTS,
        "carrier": "Aramex",
        "to_city": ax.GULF_CITIES.get(destination),
        "to_country": ax.GULF_COUNTRIES.get(destination),
        "carrier_specific": f'{{"aramex": {{"ppx": {str(ppx).lower()}, "exp": {str(exp).lower()}, "route": {route}}}}}',
    }
    for layer in (*layers, own or {}, common):  # the last one that knows a field decides
        for c, value in layer.items():
            if value is not None:
                made[c] = value
    return made


#: Numbers such as ½, which bound words for Java but not for Python, and signs of private use in their place.
_FRACTIONS = {c: chr(0xF0000 + ord(c)) for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_FRACTION = re.compile(f"[{''.join(c for c in _FRACTIONS if ord(c) < 0x10000)}]")
_STAND_INS, _BACK = str.maketrans(_FRACTIONS), str.maketrans({v: k for k, v in _FRACTIONS.items()})


def read(text: str | None) -> dict:
    """The record of a text, by field; fields that it lacks may be missing. A null or empty text gives the blank record."""
    if not text:
        return DEFAULTS
    near = text.isascii() or len(text.encode("utf-16-le", "replace")) == 2 * len(text)
    if near and (text.isascii() or not _FRACTION.search(text)):
        return _record(text)
    return {c: v.translate(_BACK) if isinstance(v, str) else v for c, v in _record(text.translate(_STAND_INS)).items()}


def _record(text: str) -> dict:
    whole = _Text(text)
    legal = whole.search(_LEGAL)
    body, layout = _Text(text[: legal.start()]) if legal else whole, _layout(whole)
    if layout == "Aramex":
        return _aramex(whole, body)
    lines = {side: _block_lines(body, layout, k) for k, side in enumerate(("from", "to"))}
    made = _fields(body, layout, _phones(body.text), lines)
    for side, own in lines.items():
        if own:
            made.update(_party(side, tuple(own), layout))
    return made


_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
RECORD = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())


def read_all(texts: pa.Array) -> pa.Array:
    """Records as structs of all FIELDS."""
    found = [read(None if t is None else t.decode("utf-8", "replace")) for t in texts.cast(pa.binary()).to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r.get(name) for r in found], _TYPES[kind]) for name, kind in FIELDS.items()], names=list(FIELDS))
