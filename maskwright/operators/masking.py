"""Masking of tables and logged text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions import detectors as det
from maskwright.functions.detectors import let
from maskwright.functions.masks import holds_text, mask_nested, mask_value
from maskwright.operators.rules import RuleSet
from maskwright.session import cut_lineage


def protect_column(c: Column, dtype: T.DataType, mode: str | None, names, numbers: bool) -> Column:
    """One output column: its rule's mask, else the detectors over what can hold a value."""
    if mode:
        return mask_value(c, mode, dtype)
    if holds_text(dtype):
        return mask_nested(c, dtype, names)
    if numbers and isinstance(dtype, (T.IntegralType, T.FractionalType)):
        return det.mask_number(c, names, isinstance(dtype, T.FractionalType))
    return c


def mask_table(
    df: DataFrame, db: str, table: str, rules: RuleSet, names=det.DEFAULT_DETECTORS, numbers: tuple[str, ...] = ()
) -> DataFrame:
    """The protected form of a table, in one projection.

    Columns under a rule are masked whole, every other text goes through the
    detectors. A number column becomes text when masked, so the digit
    detectors run on the columns named in ``numbers`` only
    (``numeric_columns_hit`` finds the ones that need it).
    """
    modes = {f.name: rules.mode(db, table, f.name) for f in df.schema.fields}
    return _protect(df, modes, names, numbers)


# The text columns of a wide table that share one expression.
SHARED = 8


def _protect(df: DataFrame, modes: dict[str, str | None], names, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Every column under its mode or the detectors.

    The plan of a wide table stays small: its texts go through the detectors
    in arrays of a few columns each. Reading one column of the result reads at
    most its neighbours in the array; a narrow table reads that column alone.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not modes[f.name]]
    place: dict[str, Column] = {}
    if len(texts) > SHARED and list(names):
        runs = [texts[i : i + SHARED] for i in range(0, len(texts), SHARED)]
        masked = {}
        for i, run in enumerate(runs):
            cells = F.array(*[F.col(f"`{c}`") for c in run])
            masked[f"_masked{i}"] = F.transform(cells, lambda t: det.mask_all(t, names))
            place |= {c: F.col(f"_masked{i}")[j] for j, c in enumerate(run)}
        fields = df.schema.fields
        df = df.withColumns(masked)
    else:
        fields = df.schema.fields
    return df.select(
        *[
            place[f.name].alias(f.name)
            if f.name in place
            else protect_column(F.col(f"`{f.name}`"), f.dataType, modes[f.name], names, f.name in numbers).alias(f.name)
            for f in fields
        ]
    )


def numeric_columns_hit(df: DataFrame, names=det.DEFAULT_DETECTORS) -> tuple[str, ...]:
    """The numeric columns in which a digit detector finds a value. One pass."""
    digit = [d.name for d in det.detectors(names) if d.digits]
    aggs = [
        F.bool_or(
            F.coalesce(
                det.detects(det.integral_text(F.col(f"`{f.name}`"), isinstance(f.dataType, T.FractionalType)), digit),
                F.lit(False),
            )
        ).alias(f.name)
        for f in df.schema.fields
        if isinstance(f.dataType, (T.IntegralType, T.FractionalType))
    ]
    if not aggs or not digit:
        return ()
    row = df.agg(*aggs).first().asDict()
    return tuple(c for c, hit in row.items() if hit)


def mask_by_label(df: DataFrame, rules: RuleSet, names=det.DEFAULT_DETECTORS) -> DataFrame:
    """Masks by column label alone, for frames whose columns have no known origin."""
    return _protect(df, {f.name: rules.mode_by_name(f.name) for f in df.schema.fields}, names)


# Server text that may sit between two quoted names, and the
# phrases servers quote themselves.
ERROR_GAPS = (" in ", " for column ", " for key ", " at row ", " of ", " and ", ", ", " to ", " on ", ".")
ERROR_PHRASES = (
    "field list",
    "where clause",
    "on clause",
    "order clause",
    "group statement",
    "having clause",
    "from clause",
)
VALUE_REDACTED = '"<value redacted>"'
_QUOTES = "[\"'`]"
_QUOTED = "(?s)\"[^\"]*\"|'[^']*'|`[^`]*`"
_SPAN = f"(?s){_QUOTES}.*{_QUOTES}"


def redact_message(msg: Column, sql: Column, names=det.DEFAULT_DETECTORS) -> Column:
    """The message with its quoted stretch blanked, and the detectors over what remains.

    The stretch stays if nothing in it can be a value of a row: each quotation
    occurs in the statement or is a fixed phrase, with fixed words between.
    With one lone quote, all after it is blanked.
    """
    statement = F.lower(F.coalesce(sql, F.lit("")))

    def harmless(span: Column) -> Column:
        parts = F.regexp_extract_all(span, F.lit(_QUOTED), F.lit(0))
        gaps = F.split(span, _QUOTED, -1)
        body = lambda p: F.lower(F.substr(p, F.lit(2), F.char_length(p) - 2))
        known = F.forall(parts, lambda p: body(p).isin(*ERROR_PHRASES) | F.contains(statement, body(p)))
        ends = (gaps[0] == "") & (F.element_at(gaps, -1) == "")
        inner = F.forall(F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 2, F.lit(0))), lambda g: g.isin(*ERROR_GAPS))
        return known & ends & inner

    def redact(m: Column) -> Column:
        count = F.char_length(F.regexp_replace(m, "[^\"'`]", ""))
        lone = F.concat(F.regexp_extract(m, f"(?s)^(.*?){_QUOTES}", 1), F.lit(VALUE_REDACTED))
        span = F.regexp_extract(m, f"({_SPAN})", 1)
        whole = F.regexp_replace(m, _SPAN, VALUE_REDACTED)
        return F.when(count == 0, m).when(count == 1, lone).when(let(span, harmless), m).otherwise(whole)

    return det.mask_all(let(msg, redact), names)


def redact_errors(df: DataFrame, msg: str = "error", sql: str = "sql", names=det.DEFAULT_DETECTORS) -> DataFrame:
    return df.withColumn(msg, redact_message(F.col(msg), F.col(sql), names))


def leak_variants(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Each seeded value in the forms a leak may take: plain, lower, reversed, hex, base64."""
    c = F.col(seed)
    forms = F.array(
        F.struct(F.lit("plain").alias("form"), c.alias("needle")),
        F.struct(F.lit("lower").alias("form"), F.lower(c).alias("needle")),
        F.struct(F.lit("reversed").alias("form"), F.reverse(c).alias("needle")),
        F.struct(F.lit("hex").alias("form"), F.lower(F.hex(F.encode(c, "UTF-8"))).alias("needle")),
        F.struct(F.lit("base64").alias("form"), F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "=+$", "").alias("needle")),
    )
    return seeds.select(c.alias("seed"), F.inline(forms)).distinct()


# Characters of a gram; a shorter seeded value is one gram by itself.
LEAK_GRAM = 6
# Characters of a cell that are cut into grams at a time.
LEAK_STRETCH = 256
# A gram that is the rarest of more needles than this is met together with a second one.
LEAK_SHARED = 64


def _grams(text: Column, n: int) -> Column:
    """Hashes of the distinct pieces of n characters; linear in the text, which is cut into overlapping stretches first."""
    stretches = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{LEAK_STRETCH + n - 1}}})).{{1,{LEAK_STRETCH}}}"), F.lit(1))
    starts = lambda x: F.when(F.char_length(x) >= n, F.sequence(F.lit(1), F.char_length(x) - n + 1)).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(stretches, lambda x: F.transform(starts(x), lambda i: F.xxhash64(F.lit(n), F.substr(x, i, F.lit(n)))))
    return F.array_distinct(F.flatten(pieces))


def _leak_candidates(cells: DataFrame, words: DataFrame) -> DataFrame:
    """(cell_id, needle_id) of all pairs in which the needle may be in the cell.

    A needle that holds a gram no cell has is in none. Any other needle meets
    the cells that hold its rarest gram, by how many needles and cells share
    it; where that one is shared by many needles, cells must hold the second
    rarest too. Grams are many times the text they are of, which Spark's
    estimate of their size does not tell: they meet by shuffles.
    """
    size = F.least(F.char_length("needle"), F.lit(LEAK_GRAM))
    # At most as many as a gram has characters.
    sizes = sorted(r[0] for r in words.select(size).distinct().collect())
    if not sizes:
        return cells.crossJoin(words).select("cell_id", "needle_id").limit(0)
    own = F.coalesce(*[F.when(size == n, _grams(F.col("needle"), n)) for n in sizes])
    all_sizes = F.concat(*[_grams(F.col("cell"), n) for n in sizes])
    # Made anew where it is read: kept, it would be many times the cells.
    of_cells = cells.select("cell_id", F.explode(all_sizes).alias("gram"))
    seen = cut_lineage(of_cells.groupBy("gram").agg(F.count("*").alias("cells")))
    # A few grams of each needle first, which most needles do not get past.
    likely = words.select("needle_id", own.alias("own"))
    for part in (0.2, 0.4, 0.6, 0.8):
        likely = likely.withColumn("gram", F.get("own", (F.size("own") * part).cast("int"))).join(seen.hint("merge"), "gram", "left_semi")
    of_needles = cut_lineage(likely.select("needle_id", F.explode("own").alias("gram")).join(seen.hint("merge"), "gram", "left"))
    shared = of_needles.groupBy("gram").agg(F.count("*").alias("needles"))
    weighed = of_needles.join(shared.hint("merge"), "gram").select("needle_id", F.struct((F.col("cells") * F.col("needles")).alias("weight"), "gram").alias("key"))
    ranked = weighed.groupBy("needle_id").agg(
        F.every(F.col("key.weight").isNotNull()).alias("possible"), F.min("key").alias("first"), F.slice(F.array_sort(F.collect_list("key")), 2, 1).alias("rest")
    )
    chosen = cut_lineage(ranked.where("possible").select("needle_id", F.col("first.gram").alias("gram"), F.get("rest", F.lit(0))["gram"].alias("second")))
    crowded = chosen.where("second is not null").groupBy("gram").count().where(F.col("count") > LEAK_SHARED).select("gram", F.lit(True).alias("crowded"))
    chosen = cut_lineage(chosen.join(crowded.hint("merge"), "gram", "left").withColumn("crowded", F.coalesce(F.col("crowded") & F.col("second").isNotNull(), F.lit(False))))
    alone = of_cells.join(chosen.where("not crowded").hint("merge"), "gram").select("cell_id", "needle_id")
    pairs = chosen.where("crowded").select(F.col("gram").alias("first"), "second", "needle_id")
    if pairs.isEmpty():
        return alone
    both = of_cells.join(pairs.select(F.col("first").alias("gram")).distinct().hint("merge"), "gram").select("cell_id", F.col("gram").alias("first"))
    both = both.join(of_cells.withColumnRenamed("gram", "second").hint("merge"), "cell_id").join(pairs.hint("merge"), ["first", "second"])
    return alone.union(both.select("cell_id", "needle_id"))


def leak_counts(df: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """column, form, seed, cells: in how many cells each seeded value is found in which form. Case is ignored.

    Equal cells are searched once. Null cells and empty seeds hold nothing.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return seeds.select(F.lit("").alias("column"), F.lit("").alias("form"), F.lit("").alias("seed"), F.lit(0).cast("long").alias("cells")).limit(0)
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.col(f"`{c}`")).alias("cell")) for c in text])))
    counted = cut_lineage(cells.where("cell is not null").groupBy("column", "cell").agg(F.count("*").alias("n")).withColumn("cell_id", F.monotonically_increasing_id()))
    needles = leak_variants(seeds, seed).select(F.lower("needle").alias("needle"), "seed", "form").where("needle <> ''")
    words = cut_lineage(needles.select("needle").distinct().withColumn("needle_id", F.monotonically_increasing_id()))
    met = _leak_candidates(counted, words).join(words.hint("merge"), "needle_id").join(counted.hint("merge"), "cell_id").where(F.contains("cell", "needle"))
    return met.select("column", "n", "needle").join(needles.hint("merge"), "needle").groupBy("column", "form", "seed").agg(F.sum("n").alias("cells"))


def leak_hits(df: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """One row per cell and seed form found in it: column, seed, form. Case is ignored."""
    hits = leak_counts(df, seeds, seed)
    return hits.select("column", "seed", "form", F.explode(F.sequence(F.lit(1).cast("long"), F.col("cells")))).drop("col")


def leak_scan(df: DataFrame, seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """Seeded values found in a published dataset, per column and form: cells hit, seeds found."""
    return leak_counts(df, seeds, seed).groupBy("column", "form").agg(F.sum("cells").alias("cells"), F.count("seed").alias("seeds"))
