"""Logged SQL text as arrays of tokens, cut by one regular expression.

Nothing here parses a statement: a token pattern, a normalised form with one
space between tokens, and the same form with nested parentheses folded, are
what the log analyses test with plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.detectors import let
from maskwright.functions.vocabulary import KNOWN_FUNCTIONS, SHAPE_KEYWORDS

# ---- anonymised shapes ----

MAX_SHAPE = 300
CUT = "…"
PUNCT = r"()\[\]{},.;+\-*/%<>=!~^&|:@?#$\\"
_W0 = r"[A-Za-z_[^\x00-\x7F]]"
_W = r"[A-Za-z0-9_$[^\x00-\x7F]]"
_SQ = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+(?:'|\\?\z)"
_DQ = r'"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+(?:"|\\?\z)'
SHAPE_TOKEN = "(?s)" + "|".join(
    [
        r"(?:--|#)[^\n]*+(?:\n|\z)",
        r"/\*.*?(?:\*/|\z)",
        _SQ,
        _DQ,
        r"`[^`]*+(?:``[^`]*+)*+(?:`|\z)",
        r"\[[^\[\]\n]*+\]",
        r"\$[0-9]++",
        r"(\$[A-Za-z0-9_]*+\$).*?(?:\1|\z)",
        r"(?:[0-9]|\.[0-9])(?:[A-Za-z0-9_$.[^\x00-\x7F]]|(?<=[eE])[+\-])*+",
        r"[EXBNUexbnu][A-Za-z0-9_$]?" + _SQ,
        _W0 + _W + "*+",
        r"[^\x00-\x20\x7f]",
    ]
)
# The markers of a shape.
MARKERS = ("id", "`id`", '"id"', "[id]", "'?'", "N", "$N", "$$?$$", "--…", "/*…*/", CUT)


def _marker(tok: Column, following: Column) -> Column:
    first, word = F.substring(tok, 1, 1), F.upper(tok)
    starts = lambda p: F.rlike(tok, F.lit(p))
    return (
        F.when(starts(r"^(?:--|#)"), F.lit("--…"))
        .when(starts(r"^/\*"), F.lit("/*…*/"))
        .when(starts(r"^(?:'|[EXBNUexbnu][A-Za-z0-9_$]?')"), F.lit("'?'"))
        .when(first == '"', F.lit('"id"'))
        .when(first == "`", F.lit("`id`"))
        .when(starts(r"^\[."), F.lit("[id]"))
        .when(starts(r"^\$[0-9]"), F.lit("$N"))
        .when(starts(r"^\$."), F.lit("$$?$$"))
        .when(starts(r"^\.?[0-9]"), F.lit("N"))
        .when(word.isin(SHAPE_KEYWORDS), word)
        .when(word.isin(KNOWN_FUNCTIONS) & (following == "("), word)
        .when(starts(f"^[{PUNCT}]$"), tok)
        .otherwise(F.lit("id"))
    )


def statement_shape(sql: Column) -> Column:
    """A statement with its literals, identifiers and comments replaced by markers, at most 300 bytes."""
    # Every token takes two bytes at least, so no more than these can show.
    most = MAX_SHAPE // 2 + 2

    def shape(tokens: Column) -> Column:
        marks = F.transform(
            F.slice(tokens, 1, most),
            lambda t, i: _marker(t, F.coalesce(F.get(tokens, i + 1), F.lit(""))),
        )
        start = F.struct(F.lit(0).alias("size"), F.lit("").alias("text"), F.lit(False).alias("cut"))

        def step(acc: Column, mark: Column) -> Column:
            size = acc["size"] + F.octet_length(mark) + 1
            longer = F.concat(acc["text"], F.lit(" "), mark)
            full = F.concat(acc["text"], F.lit(" " + CUT))
            return (
                F.when(acc["cut"], acc)
                .when(size > MAX_SHAPE, F.struct(acc["size"].alias("size"), full.alias("text"), F.lit(True).alias("cut")))
                .otherwise(F.struct(size.alias("size"), longer.alias("text"), F.lit(False).alias("cut")))
            )

        return F.aggregate(marks, start, step, lambda acc: F.substr(acc["text"], F.lit(2)))

    return let(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(SHAPE_TOKEN), F.lit(0)), shape)


def export_token(tok: Column) -> Column:
    """A refusal token as an export may hold it: punctuation, a keyword, a known function, or ``id``."""
    word = F.upper(tok)
    return (
        F.when(tok.isNull() | tok.isin("", "-"), F.lit("-"))
        .when(F.rlike(tok, F.lit(f"^[{PUNCT}]+$")), tok)
        .when(word.isin(SHAPE_KEYWORDS) | word.isin(KNOWN_FUNCTIONS), word)
        .otherwise(F.lit("id"))
    )


def in_vocabulary(tok: Column) -> Column:
    """Whether a token of a shape belongs to the closed vocabulary."""
    return (
        tok.isin(*MARKERS)
        | tok.isin(SHAPE_KEYWORDS)
        | tok.isin(KNOWN_FUNCTIONS)
        | F.rlike(tok, F.lit(f"^[{PUNCT}]+$"))
    )


# ---- tokens per dialect ----

DIALECTS = ("mysql", "postgres", "sqlite")
FOLDED = "\ue000"


def dialect_of(engine: Column) -> Column:
    return F.when(engine.isin("mariadb", "mysql"), F.lit("mysql")).when(engine.isin("postgres", "sqlite"), engine)


def _closed(q: str) -> str:
    """A quoted token; then the start of one a backslash spoils; then a lone quote."""
    body = rf"{q}[^{q}\\]*+(?:{q}{q}[^{q}\\]*+)*+"
    return rf"{body}{q}|{body}\\|{q}"


_NUMBER = rf"(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++){_W}*+"
_PG_NUMBER = r"(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][0-9]++)?[A-Za-z0-9_[^\x00-\x7F]]*+"
_OTHER = r"[^ \t\n\r\f\x0B]"
TOKEN = {
    "mysql": "(?s)" + "|".join(
        [r"\\", r"--|/\*|\*/|#|:=", _closed("'"), _closed('"'), _closed("`"), _NUMBER, rf"[A-Za-z_$[^\x00-\x7F]]{_W}*+", _OTHER]
    ),
    "postgres": "(?s)" + "|".join(
        [
            r"\\",
            r"--|/\*|\*/|:=",
            rf'@(?={_W}|")' + r"(?:[^\s]|\z)",
            r"\$[0-9]",
            r"(\$(?:[A-Za-z_][A-Za-z0-9_]*+)?\$).*?\1",
            r"\$(?:[A-Za-z_][A-Za-z0-9_]*+)?\$|\$",
            _closed("'"),
            _closed('"'),
            r"[eE]'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'|[eE]'",
            r"(?<=[Uu])&[\"']",
            _PG_NUMBER,
            rf"{_W0}{_W}*+",
            _OTHER,
        ]
    ),
    "sqlite": "(?s)" + "|".join(
        [
            r"\\",
            rf":{_W}",
            r"--|/\*|\*/|#|:=",
            _closed("'"),
            _closed('"'),
            _closed("`"),
            r"\[[^\]]*+\]|\[",
            _NUMBER,
            rf"{_W0}{_W}*+",
            _OTHER,
        ]
    ),
}
# What a token of the pattern above must not be: a comment, a variable, a
# parameter, a backslash, an escape; and a quote that never closes.
BAD_TOKEN = {
    "mysql": r"^(?:--|/\*|\*/|#|:=|\?|@)$|(?s:^\\$|^['\"`].*\\$)",
    "postgres": r"^(?:--|/\*|\*/|:=|@[^\s]|\$[0-9]|\$|&[\"'])$|(?s:^\\$|^['\"].*\\$)",
    "sqlite": r"^(?:--|/\*|\*/|#|:=|\?|@|\$|:.)$|(?s:^\\$|^['\"`].*\\$)",
}
OPEN_TOKEN = {
    "mysql": r"^['\"`]$",
    "postgres": r"^(?:['\"]|[eE]'|\$(?:[A-Za-z_][A-Za-z0-9_]*)?\$)$",
    "sqlite": r"^['\"`\[]$",
}
_STRING = {"mysql": r"^['\"]", "postgres": r"^(?:'|[eE]'|\$)", "sqlite": r"^'"}
_QUOTED_NAME = {"mysql": r"^`", "postgres": r"^\"", "sqlite": r"^[\"`\[]."}


def per_dialect(dialect: Column, build) -> Column:
    out = None
    for d in DIALECTS:
        out = F.when(dialect == d, build(d)) if out is None else out.when(dialect == d, build(d))
    return out


def trimmed(sql: Column) -> Column:
    """A statement without outer blanks and one closing semicolon."""
    blanks, among = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", F.lit(" \t\n\r\f\x0B")
    once = F.regexp_replace(sql, blanks, "")
    whole = F.regexp_replace(F.regexp_replace(once, r";$", ""), blanks, "")
    # The same without a pattern, where the text is ASCII and has no semicolon.
    plain = (F.octet_length(sql) == F.char_length(sql)) & ~F.contains(sql, F.lit(";"))
    return F.when(plain, F.trim(sql, among)).otherwise(whole)


def tokens(sql: Column, dialect: Column) -> Column:
    return per_dialect(dialect, lambda d: F.regexp_extract_all(sql, F.lit(TOKEN[d]), F.lit(0)))


def _account_sign(toks: Column, t: Column, i: Column) -> Column:
    """The @ of 'user'@'host'."""
    quote = r"^['\"`].*['\"`]$"
    before = F.coalesce(F.get(toks, i - 1), F.lit(""))
    after = F.coalesce(F.get(toks, i + 1), F.lit(""))
    return (t == "@") & F.rlike(before, F.lit(quote)) & F.rlike(after, F.lit(quote))


def lexical_problem(toks: Column, dialect: Column) -> Column:
    """The refusal code of the first token no statement may hold, or null."""

    def problem(d: str) -> Column:
        def code(t: Column, i: Column) -> Column:
            bad = F.rlike(t, F.lit(BAD_TOKEN[d]))
            if d == "mysql":
                bad = bad & ~_account_sign(toks, t, i)
            return F.when(bad, F.lit("E_FORBIDDEN_TOKEN")).when(
                F.rlike(t, F.lit(OPEN_TOKEN[d])), F.lit("E_UNSUPPORTED_SYNTAX")
            )

        return F.get(F.filter(F.transform(toks, code), lambda c: c.isNotNull()), F.lit(0))

    return per_dialect(dialect, problem)


def is_string(t: Column, dialect: str) -> Column:
    return F.rlike(t, F.lit(_STRING[dialect]))


def is_quoted_name(t: Column, dialect: str) -> Column:
    return F.rlike(t, F.lit(_QUOTED_NAME[dialect]))


def is_number(t: Column) -> Column:
    return F.rlike(t, F.lit(r"^\.?[0-9]"))


def _plain(t: Column, d: str) -> Column:
    """A token of the normalised form: strings closed, names folded, never a blank inside."""
    inner = F.upper(F.lower(F.substr(t, F.lit(2), F.char_length(t) - 2)))
    name = F.concat(F.lit('"'), F.regexp_replace(inner, rf"[\s(){FOLDED}]", "_"), F.lit('"'))
    string = is_string(t, d) & ~F.startswith(t, F.lit('"'))
    quoted = is_quoted_name(t, d) | F.startswith(t, F.lit('"'))
    return F.when(string, F.lit("'?'")).when(quoted, name).otherwise(F.upper(F.lower(t)))


def normalised(toks: Column, dialect: Column) -> Column:
    """The tokens joined by one space: words upper-cased, strings as '?', quoted names as "NAME"."""
    return per_dialect(dialect, lambda d: F.array_join(F.transform(toks, lambda t: _plain(t, d)), " "))


def top_level(norm: Column) -> Column:
    """The normalised form with every parenthesised group folded into one mark.

    Each pass folds the innermost groups, so there are as many as the nesting
    is deep; a parenthesis left over is unbalanced.
    """

    def deeper(a: Column, c: Column) -> Column:
        now = F.when(c == "(", a["now"] + 1).when(c == ")", F.greatest(a["now"] - 1, F.lit(0))).otherwise(a["now"])
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    depth = F.aggregate(F.split(F.regexp_replace(norm, "[^()]", ""), ""), start, deeper, lambda a: a["most"])
    passes = let(depth, lambda d: F.when(d > 0, F.sequence(F.lit(1), d)).otherwise(F.array().cast("array<int>")))
    folded = F.aggregate(passes, norm, lambda text, _: F.regexp_replace(text, r"\([^()]*\)", FOLDED))
    return F.when(F.contains(norm, F.lit("(")), folded).otherwise(norm)


def literal_text(t: Column) -> Column:
    """The value of a string token without its quotes, or a number as written."""
    body = F.regexp_extract(t, r"(?s)^(?:[eEnN]?'(.*)'|\"(.*)\"|(\$\w*\$)(.*)\3)$", 1)
    dq = F.regexp_extract(t, r'(?s)^"(.*)"$', 1)
    dollar = F.regexp_extract(t, r"(?s)^(\$\w*\$)(.*)\1$", 2)
    return (
        F.when(F.startswith(t, F.lit("$")), dollar)
        .when(F.startswith(t, F.lit('"')), F.replace(dq, F.lit('""'), F.lit('"')))
        .when(is_number(t), t)
        .otherwise(F.replace(body, F.lit("''"), F.lit("'")))
    )
