"""Value detectors as column expressions.

Every detector is a pattern for candidates plus a test each candidate must
pass (a checksum, a digit count). ``find`` lists the values found in a text,
``mask`` replaces them in place and leaves the rest of the text as it is.
Typographic spaces count as spaces and full-width digits as digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

# The detector names, in the order they run, and the defaults.
DETECTOR_NAMES = ("email", "iban", "card", "be_niss", "fr_nir", "nl_bsn", "us_ssn", "phone", "phone_loose")
DEFAULT_DETECTORS = ("email", "phone", "iban", "card")

# IBAN lengths by country, from the public ISO 13616 registry.
IBAN_LENGTHS = {
    15: "NO",
    16: "BE",
    18: "DK FI FK FO GL NL SD",
    19: "MK SI",
    20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV",
    22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST",
    26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA",
    30: "JO KW MU YE",
    31: "MT SC",
    32: "LC",
    33: "RU",
}

WIDE_DIGITS = "０１２３４５６７８９"
BLANKS = "\u0020\u00a0\u202f\u2009"
D = "[0-9０-９]"
SP = f"[{BLANKS}]"
SEP = f"[{BLANKS}.\\-/()]"
MAIL = r"\p{L}\p{N}._%+\-"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once: body may use it many times without repeating its work."""
    return F.transform(F.array(value), body)[0]


# Stands for a match while a text is cut; a text that holds it is cut the slow way.
MARK = "\ue001"


def split_at(text: Column, pattern: str) -> Column:
    """split(text, pattern, -1). Java compiles a split pattern anew for every text, a replace pattern once."""
    marked = F.split(F.regexp_replace(text, pattern, MARK), MARK, -1)
    return F.when(F.contains(text, F.lit(MARK)), F.split(text, pattern, -1)).otherwise(marked)


def digits_of(c: Column) -> Column:
    """The decimal digits of a candidate, full-width ones folded."""
    return F.regexp_replace(F.translate(c, WIDE_DIGITS, "0123456789"), "[^0-9]", "")


def _alnum_of(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.translate(c, WIDE_DIGITS, "0123456789"), "[^0-9A-Za-z]", ""))


def _number(c: Column) -> Column:
    return c.cast("bigint")


def partial_mask(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 1), F.lit("***("), F.char_length(c).cast("string"), F.lit(")"))


_G = f"[{BLANKS}\\-]"
CARD_GROUPS = rf"{D}{{13,19}}|{D}{{4}}(?:{_G}{D}{{4}}){{3}}(?:{_G}{D}{{1,3}})?|{D}{{4}}{_G}{D}{{6}}{_G}{D}{{4,5}}"

# ---- tests of candidates ----


def iban_ok(m: Column) -> Column:
    """ISO 13616: the country and check digits move to the end, mod 97 is 1."""

    def remainder(s: Column) -> Column:
        rotated = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))
        return F.aggregate(
            F.split(rotated, ""),
            F.lit(0),
            lambda acc, ch: F.when(
                ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97
            ).otherwise((acc * 100 + F.ascii(ch) - 55) % 97),
        )

    return let(_alnum_of(m), lambda s: remainder(s) == 1)


def luhn_ok(m: Column) -> Column:
    return let(digits_of(m), lambda d: F.char_length(d).between(13, 19) & F.call_function("luhn_check", d))


def niss_ok(m: Column) -> Column:
    """Belgian national number: 97 minus the first nine digits mod 97 (2 before them from 2000 on)."""

    def test(d: Column) -> Column:
        head, key = _number(F.substring(d, 1, 9)), _number(F.substring(d, 10, 2))
        month = _number(F.substring(d, 3, 2))
        day = _number(F.substring(d, 5, 2))
        return (
            (month <= 12)
            & (day <= 31)
            & ((97 - head % 97 == key) | (97 - (head + F.lit(2_000_000_000)) % 97 == key))
        )

    return let(digits_of(m), test)


def nir_ok(m: Column) -> Column:
    """French social security number; Corsica counts as 19 and 18."""

    def test(s: Column) -> Column:
        n = F.replace(F.replace(F.substring(s, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
        return 97 - _number(n) % 97 == _number(F.substring(s, 14, 2))

    return let(_alnum_of(m), test)


def bsn_ok(m: Column) -> Column:
    """Dutch citizen number: weights 9 to 2, the last digit counts -1, mod 11 is 0."""

    def test(d: Column) -> Column:
        total = F.aggregate(
            F.transform(F.split(d, ""), lambda ch, i: (F.ascii(ch) - 48) * F.when(i < 8, 9 - i).otherwise(-1)),
            F.lit(0),
            lambda acc, x: acc + x,
        )
        return (d != "000000000") & (total % 11 == 0)

    return let(digits_of(m), test)


# ---- detectors ----


@dataclass(frozen=True)
class Detector:
    name: str
    pattern: str
    # A cheap test a text must pass before the pattern is tried on it.
    hint: str
    ok: Callable[[Column], Column] | None = None
    # Can match digits alone, so it also reads numeric columns.
    digits: bool = True
    # Where in a candidate the value ends, when a shorter start may hold it.
    shorten: bool = False


def _iban_pattern() -> str:
    arms = []
    for length, countries in IBAN_LENGTHS.items():
        names = "|".join(countries.split())
        arms.append(f"(?:{names}){D}{{2}}(?:{SP}?[0-9A-Za-z０-９]){{{length - 4}}}")
    # Two letters and two digits first: the countries are tried at few places.
    return rf"(?<![\p{{L}}\p{{N}}])(?=[A-Za-z]{{2}}{D}{{2}})(?i:{'|'.join(arms)})(?![\p{{L}}\p{{N}}])"


_EDGE = r"(?<![\p{L}\p{N}])"
_END = r"(?![\p{L}\p{N}])"

DETECTORS = {
    d.name: d
    for d in (
        Detector(
            "email",
            # The start of a run of address characters, or right after a match:
            # each run is read once, whatever its length.
            rf"(?:(?<![{MAIL}])|\G)[{MAIL}]++@[\p{{L}}\p{{N}}.\-]+\.\p{{L}}{{2,}}",
            "@",
            digits=False,
        ),
        Detector("iban", _iban_pattern(), rf"[A-Za-z]{{2}}{D}{{2}}{SP}?[0-9A-Za-z０-９]", iban_ok),
        Detector("card", rf"(?<!{D}){D}(?:[{BLANKS}\-]?{D}){{12,18}}(?!{D})", rf"{D}(?:[{BLANKS}\-]?{D}){{12}}", luhn_ok, shorten=True),
        Detector(
            "be_niss",
            rf"{_EDGE}{D}{{2}}[.{BLANKS}]?{D}{{2}}[.{BLANKS}]?{D}{{2}}[-{BLANKS}]?{D}{{3}}[.{BLANKS}]?{D}{{2}}{_END}",
            rf"{D}{{2}}[.{BLANKS}]?{D}{{2}}",
            niss_ok,
        ),
        Detector(
            "fr_nir",
            rf"{_EDGE}[12１２]{SP}?{D}{{2}}{SP}?{D}{{2}}{SP}?(?:2[ABab]|{D}{{2}}){SP}?{D}{{3}}{SP}?{D}{{3}}{SP}?{D}{{2}}{_END}",
            rf"{D}{{3}}{SP}?{D}{{3}}{SP}?{D}{{2}}",
            nir_ok,
        ),
        Detector("nl_bsn", rf"{_EDGE}{D}{{3}}[.{BLANKS}]?{D}{{3}}[.{BLANKS}]?{D}{{3}}{_END}", rf"{D}{{3}}[.{BLANKS}]?{D}{{3}}", bsn_ok),
        Detector("us_ssn", rf"{_EDGE}(?!000|666|9){D}{{3}}-(?!00){D}{{2}}-(?!0000){D}{{4}}{_END}", rf"{D}{{3}}-{D}{{2}}-{D}{{4}}"),
        Detector(
            "phone",
            # + and 8 to 15 digits, 00 and 10 to 17 digits in all, or a trunk 0
            # and 9 to 11 digits in all whose first group has at least two.
            rf"(?<![\p{{L}}\p{{N}}+])(?:\+{SEP}?{D}(?:{SEP}{{0,2}}{D}){{7,14}}"
            rf"|00(?:{SEP}{{0,2}}{D}){{8,15}}"
            rf"|\(?0[1-9１-９](?:{SEP}{{0,2}}{D}){{7,9}})(?!{D})",
            rf"{D}(?:{SEP}{{0,2}}{D}){{7}}",
        ),
        Detector(
            "phone_loose",
            # 9 to 11 digits in two groups or more, the first of 2 to 4; no ISO date.
            rf"(?<![\p{{L}}\p{{N}}+])(?!{D}{{4}}-{D}{{2}}-{D}{{2}})\(?[1-9１-９](?:"
            rf"{D}{SEP}{{1,2}}{D}(?:{SEP}{{0,2}}{D}){{6,8}}"
            rf"|{D}{{2}}{SEP}{{1,2}}{D}(?:{SEP}{{0,2}}{D}){{5,7}}"
            rf"|{D}{{3}}{SEP}{{1,2}}{D}(?:{SEP}{{0,2}}{D}){{4,6}})(?!{D})",
            rf"{D}{{2}}{SEP}{{1,2}}{D}",
        ),
    )
}


def detectors(names) -> list[Detector]:
    """The named detectors, each once, in their fixed order."""
    unknown = set(names) - set(DETECTOR_NAMES)
    if unknown:
        raise ValueError(f"unknown detector: want one of {', '.join(DETECTOR_NAMES)}")
    return [DETECTORS[n] for n in DETECTOR_NAMES if n in set(names)]


def _may_hold(d: Detector, text: Column) -> Column:
    return F.contains(text, F.lit(d.hint)) if d.name == "email" else F.rlike(text, F.lit(d.hint))


def _value_in(d: Detector, m: Column) -> Column:
    """The part of candidate m that is a value, or null."""
    if d.ok is None:
        return m
    if not d.shorten:
        return F.when(d.ok(m), m)
    # A card may be followed by a date, a code or an address: what is grouped as cards
    # are comes first, the whole or without its last groups, since one in ten longer runs
    # passes the check digit by chance. Only then any grouping of the whole.
    cut = lambda c: F.regexp_extract(c, rf"^(.*{D})[{BLANKS}\-]{D}+$", 1)
    usual = lambda c: F.regexp_extract(c, rf"^(?:{CARD_GROUPS})$", 0)
    tries = F.array(usual(m), usual(cut(m)), usual(cut(cut(m))), m)
    return F.get(F.filter(tries, d.ok), F.lit(0))


def _find(d: Detector, text: Column) -> Column:
    values = F.transform(F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0)), lambda m: _value_in(d, m))
    found = F.filter(values, lambda v: v.isNotNull())
    return F.when(_may_hold(d, text), found).otherwise(F.array().cast("array<string>"))


def _mask_candidate(d: Detector, m: Column) -> Column:
    if d.ok is None:
        return partial_mask(m)
    if not d.shorten:
        return F.when(d.ok(m), partial_mask(m)).otherwise(m)
    return let(
        _value_in(d, m),
        lambda v: F.when(
            v.isNotNull(), F.concat(partial_mask(v), F.substr(m, F.char_length(v) + 1))
        ).otherwise(m),
    )


def _mask(d: Detector, text: Column) -> Column:
    """Cut the text at the candidates, mask the real ones, put it together again."""
    gaps = split_at(text, d.pattern)
    candidates = F.regexp_extract_all(text, F.lit(d.pattern), F.lit(0))
    whole = F.array_join(
        F.zip_with(
            gaps,
            F.transform(candidates, lambda m: _mask_candidate(d, m)),
            lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))),
        ),
        "",
    )
    return F.when(_may_hold(d, text) & F.rlike(text, F.lit(d.pattern)), whole).otherwise(text)


def find(name: str, c: Column) -> Column:
    """The values detector ``name`` finds in a text column, as array<string>."""
    return let(c, lambda t: F.when(t.isNotNull(), _find(DETECTORS[name], t)))


def mask(name: str, c: Column) -> Column:
    """c with the values detector ``name`` finds masked inside the text."""
    return let(c, lambda t: _mask(DETECTORS[name], t))


def mask_all(c: Column, names=DEFAULT_DETECTORS) -> Column:
    """The chain of detectors over a text column."""
    out = c
    for d in detectors(names):
        out = let(out, partial(_mask, d))
    return out


def detects(c: Column, names=DEFAULT_DETECTORS) -> Column:
    """Whether some detector would mask something in c."""

    def test(t: Column) -> Column:
        hit = F.lit(False)
        for d in detectors(names):
            hit = hit | (F.size(_find(d, t)) > 0)
        return hit

    return let(c, lambda t: F.when(t.isNotNull(), test(t)).otherwise(F.lit(False)))


def integral_text(c: Column, floating: bool) -> Column:
    """A number as the digit detectors read it: integers, and whole floats under 1e19."""
    if not floating:
        return c.cast("string")
    whole = (F.abs(c) < 1e19) & (F.floor(c) == c)
    return F.when(whole & ~F.isnan(c), c.cast("decimal(20,0)").cast("string"))


def mask_number(c: Column, names, floating: bool = False) -> Column:
    """A numeric column as text, values the digit detectors recognise masked."""
    digit = [d.name for d in detectors(names) if d.digits]
    shown = c.cast("string")
    if not digit:
        return shown
    return let(
        integral_text(c, floating),
        lambda t: F.when(t.isNotNull() & detects(t, digit), mask_all(t, digit)).otherwise(shown),
    )


# One function pair per detector, for callers that want just one kind.
def _pair(name: str):
    return (lambda c: find(name, c)), (lambda c: mask(name, c))


find_email, mask_emails = _pair("email")
find_phone, mask_phones = _pair("phone")
find_phone_loose, mask_phones_loose = _pair("phone_loose")
find_iban, mask_ibans = _pair("iban")
find_card, mask_cards = _pair("card")
find_be_niss, mask_be_nisses = _pair("be_niss")
find_fr_nir, mask_fr_nirs = _pair("fr_nir")
find_nl_bsn, mask_nl_bsns = _pair("nl_bsn")
find_us_ssn, mask_us_ssns = _pair("us_ssn")
