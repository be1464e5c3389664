"""Value text: how a cell of any type shows in a report, escaped and capped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.detectors import let

# Control and format characters that may hide or reorder text.
UNSAFE = "[\\x00-\\x1f\\x7f-\\x9f\\u061c\\u200b-\\u200f\\u2028-\\u202e\\u2060-\\u2064\\u2066-\\u2069\\ufeff]"


def value_text(c: Column, dtype: T.DataType) -> Column:
    """The text of a cell: NULL, <bytes:N>, ISO 8601 times, NaN and Infinity, exact integers."""
    if isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("<bytes:"), F.octet_length(c).cast("string"), F.lit(">"))
    elif isinstance(dtype, T.TimestampType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    elif isinstance(dtype, T.TimestampNTZType):
        text = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        size = F.abs(c)
        # Plain digits where Spark would write an exponent.
        plain = F.regexp_replace(c.cast("decimal(32,12)").cast("string"), r"\.?0+$", "")
        text = F.when((F.floor(c) == c) & (size < 1e15), c.cast("bigint").cast("string"))
        text = text.when((size >= 1e7) & (size < 1e15), plain).otherwise(c.cast("string"))
        text = F.when(F.isnan(c), F.lit("NaN")).when(
            F.abs(c) == float("inf"), F.when(c > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))
        ).otherwise(text)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def _escape_char(ch: Column) -> Column:
    code = F.ascii(ch)
    short = F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(code)), 2, "0"))
    wide = F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))
    return F.when(~F.rlike(ch, F.lit(UNSAFE)), ch).when(code < 256, short).otherwise(wide)


def escape(c: Column) -> Column:
    """Backslash, tab, newline, carriage return, control and bidirectional characters escaped."""
    text = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return let(
        F.make_valid_utf8(text),
        lambda t: F.when(
            F.rlike(t, F.lit(UNSAFE)), F.array_join(F.transform(F.split(t, ""), _escape_char), "")
        ).otherwise(t),
    )


def cap_chars(c: Column, n: int) -> Column:
    """Longer texts: n-1 characters and an ellipsis; exactly n stay."""
    return let(
        c, lambda t: F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n - 1), F.lit("…"))).otherwise(t)
    )
