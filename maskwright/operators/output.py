"""What leaves the cluster: row, cell and byte caps, value text, notes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.masks import MAX_CELL_BYTES
from maskwright.functions.render import cap_chars, escape, value_text


@dataclass(frozen=True)
class Limits:
    """The limits of a profile. The defaults of both kinds of profile."""

    max_rows: int = 200
    max_cell_chars: int = 200
    max_output_bytes: int = 65_536
    k_anonymity: int = 5
    explain_rows_warn: int = 100_000
    explain_rows_refuse: int = 1_000_000
    explain_cost_refuse: float = 0.0
    idle_timeout: str = "20 minutes"
    max_session: str = "4 hours"
    tickets_per_window: int = 30
    ticket_window: str = "5 minutes"
    plan_ttl: str = "10 minutes"

    @classmethod
    def production(cls) -> Limits:
        return cls(
            k_anonymity=10,
            explain_rows_warn=20_000,
            explain_rows_refuse=200_000,
            idle_timeout="10 minutes",
            max_session="2 hours",
        )


def cap_rows(df: DataFrame, n: int, order: Sequence[str | Column] = ()) -> DataFrame:
    """The first n rows, numbered; ``truncated`` tells whether more exist. Reads no more than n + 1."""
    head = (df.orderBy(*order) if order else df).limit(n + 1)
    # n + 1 rows at most reach this one partition.
    whole = Window.partitionBy(F.lit(0))
    place = whole.orderBy(*order) if order else whole.orderBy(F.monotonically_increasing_id())
    numbered = head.withColumn("row_no", F.row_number().over(place)).withColumn(
        "truncated", F.count(F.lit(1)).over(whole) > n
    )
    return numbered.where(F.col("row_no") <= n)


def render_cells(df: DataFrame) -> DataFrame:
    """Every cell as its text."""
    return df.select(*[value_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def escape_cells(df: DataFrame) -> DataFrame:
    return df.select(*[escape(F.col(f"`{c}`")).alias(c) for c in df.columns])


def cap_cell_chars(df: DataFrame, n: int) -> DataFrame:
    """Text cells cut to n characters; ``cut_cells`` counts them per row."""
    cut = F.lit(0)
    for c in df.columns:
        cut = cut + F.coalesce((F.char_length(F.col(f"`{c}`")) > n).cast("int"), F.lit(0))
    return df.select(*[cap_chars(F.col(f"`{c}`"), n).alias(c) for c in df.columns], cut.alias("cut_cells"))


def cut_note(df: DataFrame, max_chars: int) -> DataFrame:
    """One row: how many cells were cut, in words (null when none)."""
    n = F.coalesce(F.sum("cut_cells"), F.lit(0))
    cells = F.when(n == 1, F.lit(" cell")).otherwise(F.lit(" cells"))
    note = F.concat(
        F.lit("["),
        n.cast("string"),
        cells,
        F.lit(f" shown in part, up to the … (limits: {max_chars} characters, {MAX_CELL_BYTES} bytes)]"),
    )
    return df.agg(n.cast("bigint").alias("cut_cells"), F.when(n > 0, note).alias("note"))


def cap_bytes(lines: DataFrame, n: int, line: str = "line", order: str = "row_no") -> DataFrame:
    """Rows kept while the running size of their lines fits in n bytes."""
    return measured(lines, line, order).where(F.col("running_bytes") <= n)


def measured(lines: DataFrame, line: str = "line", order: str = "row_no") -> DataFrame:
    """lines with the running size in bytes and the number of all rows.

    For row-capped input: ``cap_rows`` comes first, so one partition holds it.
    """
    size = (F.octet_length(line) + 1).cast("bigint")
    running = F.sum(size).over(
        Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    total = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return lines.withColumn("running_bytes", running).withColumn("total_rows", total)


def governed_lines(df: DataFrame, limits: Limits, fmt: str = "tsv", order: Sequence[str | Column] = ()) -> DataFrame:
    """Row, cell and byte caps applied in order: row_no, line, cut_cells, truncated, total_rows."""
    return measured_lines(df, limits, fmt, order).where(F.col("running_bytes") <= limits.max_output_bytes)


def measured_lines(df: DataFrame, limits: Limits, fmt: str = "tsv", order: Sequence[str | Column] = ()) -> DataFrame:
    """The lines within the row and cell caps, those over the byte cap among them."""
    if fmt not in ("tsv", "json"):
        raise ValueError("format: want tsv or json")
    names = df.columns
    capped = cap_rows(df, limits.max_rows, order)
    long, shown = F.lit(0), []
    for f in df.schema.fields:
        text = escape(value_text(F.col(f"`{f.name}`"), f.dataType)) if fmt == "tsv" else F.make_valid_utf8(
            value_text(F.col(f"`{f.name}`"), f.dataType)
        )
        if fmt == "json":
            text = F.when(F.col(f"`{f.name}`").isNotNull(), text)
        shown.append(text.alias(f.name))
    text = capped.select("row_no", "truncated", *shown)
    for c in names:
        long = long + F.coalesce((F.char_length(F.col(f"`{c}`")) > limits.max_cell_chars).cast("int"), F.lit(0))
    cells = [cap_chars(F.col(f"`{c}`"), limits.max_cell_chars).alias(c) for c in names]
    line = F.concat_ws("\t", *cells) if fmt == "tsv" else F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    lines = text.select("row_no", "truncated", long.alias("cut_cells"), line.alias("line"))
    return measured(lines)
