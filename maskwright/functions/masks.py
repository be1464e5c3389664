"""Whole-cell masks and cell caps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import detectors as det
from maskwright.functions.detectors import let, partial_mask

# The mask modes, the redacted cell and the cell cap.
MODES = ("redact", "partial", "email")
REDACTED = "<redacted>"
MAX_CELL_BYTES = 64 * 1024
CUT_MARK = "…"
VALUE_CHARS = "0-9A-Za-z@._%+\\-/() "
CUT_TAIL = 64


def mask_redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(REDACTED))


def mask_partial(c: Column) -> Column:
    """First character and length."""
    return let(c.cast("string"), partial_mask)


def mask_email(c: Column) -> Column:
    """First character and domain; a text that is no address is masked partially."""
    return let(
        c.cast("string"),
        lambda t: F.when(
            F.rlike(t, F.lit(r"^[^@\s]+@[^@\s]+\z")),
            F.concat(F.substring(t, 1, 1), F.lit("***@"), F.substring_index(t, "@", -1)),
        ).otherwise(partial_mask(t)),
    )


def mask_binary(c: Column) -> Column:
    """A binary cell under partial or email: its size alone."""
    return F.concat(F.lit("<masked bytes:"), F.octet_length(c).cast("string"), F.lit(">"))


def mask_value(c: Column, mode: str, dtype: T.DataType | None = None) -> Column:
    """Mask a cell whole in a mode; null stays null."""
    if mode not in MODES:
        raise ValueError("unknown mode (want redact, partial or email)")
    if mode == "redact":
        return mask_redact(c)
    if isinstance(dtype, T.BinaryType):
        return mask_binary(c)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return mask_partial(F.to_json(c))
    return mask_partial(c) if mode == "partial" else mask_email(c)


def holds_text(dtype: T.DataType) -> bool:
    """Whether the type has a text leaf the detectors read."""
    if isinstance(dtype, T.StringType):
        return True
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_text(dtype.keyType) or holds_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return any(holds_text(f.dataType) for f in dtype.fields)
    return False


def mask_nested(c: Column, dtype: T.DataType, names=det.DEFAULT_DETECTORS) -> Column:
    """The detectors over every text leaf of an array, a map or a struct."""
    if not holds_text(dtype):
        return c
    if isinstance(dtype, T.StringType):
        return det.mask_all(c, names)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: mask_nested(x, dtype.elementType, names))
    if isinstance(dtype, T.MapType):
        # Two keys may mask to one text: entries stay a list, so none is lost.
        entries = T.ArrayType(
            T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)])
        )
        return mask_nested(F.map_entries(c), entries, names)
    fields = [mask_nested(c.getField(f.name), f.dataType, names).alias(f.name) for f in dtype.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def cap_text(c: Column, max_bytes: int = MAX_CELL_BYTES) -> Column:
    """Cut a longer text at a character boundary, back over a value the cut may split."""
    keep = max_bytes - len(CUT_MARK.encode())

    def cut(t: Column) -> Column:
        # A character the cut tears in two shows as replacement characters.
        head = F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, keep).cast("string"))
        whole = F.regexp_replace(head, "\ufffd+\\z", "")
        return F.concat(F.regexp_replace(whole, f"[{VALUE_CHARS}]{{1,{CUT_TAIL}}}\\z", ""), F.lit(CUT_MARK))

    return let(c, lambda t: F.when(F.octet_length(t) > max_bytes, cut(t)).otherwise(t))


def cap_binary(c: Column, max_bytes: int = MAX_CELL_BYTES) -> Column:
    return F.when(F.octet_length(c) > max_bytes, F.substring(c, 1, max_bytes)).otherwise(c)


def cap_cells(df: DataFrame, max_bytes: int = MAX_CELL_BYTES) -> DataFrame:
    """Cap every text and binary cell; ``cut_cells`` counts the cells cut in a row."""
    cols, cuts = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(cap_text(c, max_bytes).alias(f.name))
            cuts.append(F.coalesce((F.octet_length(c) > max_bytes).cast("int"), F.lit(0)))
        elif isinstance(f.dataType, T.BinaryType):
            cols.append(cap_binary(c, max_bytes).alias(f.name))
            cuts.append(F.coalesce((F.octet_length(c) > max_bytes).cast("int"), F.lit(0)))
        else:
            cols.append(c)
    total = F.lit(0)
    for x in cuts:
        total = total + x
    return df.select(*cols, total.alias("cut_cells"))
