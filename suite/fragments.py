"""Pieces of oracle SQL for DuckDB: detectors and masks as its list functions write them."""

from __future__ import annotations

BL = "   "
BLANK = "[ \\x{A0}\\x{202F}\\x{2009}]"
DIG = "[0-9０-９]"
SEPS = "[ \\x{A0}\\x{202F}\\x{2009}.\\-/()]"


def partial(x: str) -> str:
    return f"(substr({x}, 1, 1) || '***(' || cast(length({x}) as varchar) || ')')"


def digits(x: str) -> str:
    return f"regexp_replace(translate({x}, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g')"


def luhn(x: str) -> str:
    """Luhn over the digits of x."""
    d = digits(x)
    total = (
        f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"case when i % 2 = 1 then cast(substr({d}, length({d}) - i + 1, 1) as int) "
        f"when cast(substr({d}, length({d}) - i + 1, 1) as int) > 4 then cast(substr({d}, length({d}) - i + 1, 1) as int) * 2 - 9 "
        f"else cast(substr({d}, length({d}) - i + 1, 1) as int) * 2 end))"
    )
    return f"({total} % 10 = 0)"


PATTERNS = {
    "email": "[\\p{L}\\p{N}._%+\\-]+@[\\p{L}\\p{N}.\\-]+\\.\\p{L}{2,}",
    # A run of digits first: without look-ahead the spaced form would run on into the next number.
    "card": f"\\b[0-9]{{13,19}}\\b|{DIG}(?:[ \\x{{A0}}\\x{{202F}}\\x{{2009}}\\-]?{DIG}){{12,18}}",
    "iban": f"BE{DIG}{{2}}(?:{BLANK}?[0-9A-Za-z]){{12}}",
    "phone": f"(?:\\+{SEPS}?{DIG}(?:{SEPS}{{0,2}}{DIG}){{7,14}}|\\b00(?:{SEPS}{{0,2}}{DIG}){{8,15}}|\\b0[1-9](?:{SEPS}{{0,2}}{DIG}){{7,9}}\\b)",
    "be_niss": f"\\b{DIG}{{2}}[. ]?{DIG}{{2}}[. ]?{DIG}{{2}}[- ]?{DIG}{{3}}[. ]?{DIG}{{2}}\\b",
    "fr_nir": "\\b[12][0-9]{14}\\b",
    "nl_bsn": "\\b[0-9]{3}[. ]?[0-9]{3}[. ]?[0-9]{3}\\b",
    "us_ssn": "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b",
}
TESTS = {
    "email": lambda m: "true",
    "card": luhn,
    # The check digits were derived as 98 minus the rest, the country letters as 1114.
    "iban": lambda m: f"(98 - cast(substr(replace({m}, ' ', ''), 5) || '111400' as hugeint) % 97 = cast(substr({m}, 3, 2) as int))",
    "phone": lambda m: "true",
    "be_niss": lambda m: (
        f"(cast(substr({digits(m)}, 3, 2) as int) <= 12 and cast(substr({digits(m)}, 5, 2) as int) <= 31 and "
        f"(97 - cast(substr({digits(m)}, 1, 9) as bigint) % 97 = cast(substr({digits(m)}, 10, 2) as int) or "
        f"97 - cast('2' || substr({digits(m)}, 1, 9) as bigint) % 97 = cast(substr({digits(m)}, 10, 2) as int)))"
    ),
    "fr_nir": lambda m: f"(97 - cast(substr({m}, 1, 13) as bigint) % 97 = cast(substr({m}, 14, 2) as int))",
    "nl_bsn": lambda m: (
        f"(list_sum(list_transform(range(1, 9), lambda i: cast(substr({digits(m)}, i, 1) as int) * (10 - i))) "
        f"- cast(substr({digits(m)}, 9, 1) as int)) % 11 = 0 and {digits(m)} <> '000000000'"
    ),
    "us_ssn": lambda m: f"(substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) <> '9' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000')",
}


def found(kind: str, text: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{PATTERNS[kind]}'), lambda m: {TESTS[kind]('m')})"


def masked(kind: str, text: str) -> str:
    p = PATTERNS[kind]
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({text}, '{p}'), regexp_extract_all({text}, '{p}')), "
        f"lambda z: z[1] || coalesce(case when {TESTS[kind]('z[2]')} then {partial('z[2]')} else z[2] end, '')), '')"
    )
