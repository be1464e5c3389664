"""Window functions over partitions too large for one task.

Spark sorts a window partition in one task. Here the rows of hot keys are
cut into segments along the order by a range shuffle, as many as their number
asks for, each segment is ranked or added up on its own, and what came before
a segment is added from a small table of segment totals. Rows that tie stay in
one segment, so the results are exact. The rows of all other keys go through
Spark's own window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.session import cut_lineage

HOT_ROWS = 1_000_000
MAX_SEGMENTS = 10_000
LEAST_ROWS = 20_000
# Up to so many hot keys are sent to every task: a join by a hot key would be one task's.
FEW_KEYS = 10_000

RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
RUNNING = ("sum", "count", "min", "max")


def _check_order(df: DataFrame, column: str) -> None:
    """A wrong order column fails whatever the data."""
    if not isinstance(df.schema[column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError("the first order column of a hot partition is a number, a date or a time")


def _segment(hot: DataFrame, rows: int, keys: Sequence[str], order: Column, hot_rows: int) -> DataFrame:
    """The rows of hot keys with ``_seg``, which grows along the order: the ranges a range shuffle cuts them into."""
    n = min(MAX_SEGMENTS, math.ceil(rows / hot_rows))
    cores = 4 * hot.sparkSession.sparkContext.defaultParallelism
    # Beyond a few for each core, a segment of few rows costs more than it saves.
    n = max(2, min(n, max(cores, math.ceil(rows / LEAST_ROWS))))
    return hot.repartitionByRange(n, *keys, order).withColumn("_seg", F.spark_partition_id())


def hot_windows(
    df: DataFrame,
    functions: dict[str, tuple[str, str | int | None]],
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """df with ranking functions and running sums, counts, minima or maxima up to the current row.

    ``functions`` maps a new column to a function and its argument: the column
    added up, or the buckets of ntile. ``order`` holds (column, descending)
    pairs; the first column is a number, a date or a time.
    """
    for fn, _ in functions.values():
        if fn not in RANKS + RUNNING:
            raise ValueError(f"{fn}: want one of {', '.join(RANKS + RUNNING)}")
    sort = [F.col(c).desc() if down else F.col(c).asc() for c, down in order]
    inside = Window.partitionBy(*keys, "_seg").orderBy(*sort)
    # Null keys are never among the hot ones: no equality finds them.
    sizes = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows))
    usual = Window.partitionBy(*keys).orderBy(*sort)
    plain = [_plain(fn, arg, usual).alias(n) for n, (fn, arg) in functions.items()]
    _check_order(df, order[0][0])
    many, rows = sizes.agg(F.count("*"), F.sum("_n")).first()
    if not many:
        return df.select(*df.columns, *plain)
    named = sizes.select(*keys)
    named = F.broadcast(named) if many <= FEW_KEYS else named.hint("merge")
    hot = df.join(named, list(keys), "left_semi")
    cold = df.join(named, list(keys), "left_anti").select(*df.columns, *plain)
    local = _segment(hot, rows, keys, sort[0], hot_rows).withColumn("_rn", F.row_number().over(inside))
    for i, (fn, arg) in enumerate(functions.values()):
        if fn not in ("row_number", "ntile"):
            local = local.withColumn(f"_x{i}", _inside(fn, arg, inside))
    # The rows of hot keys are read twice from here on, and by whatever follows.
    local = cut_lineage(local)
    totals = [_total(fn, arg, f"_x{i}").alias(f"_t{i}") for i, (fn, arg) in enumerate(functions.values())]
    parts = local.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_rows"), *totals)
    before = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carries = [
        F.call_function(fn if fn in ("min", "max") else "sum", F.col(f"_t{i}")).over(before).alias(f"_c{i}")
        for i, (fn, _) in enumerate(functions.values())
    ]
    parts = parts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_seg").alias("_place"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_all"),
        *carries,
    )
    # Null keys are a partition too.
    same = F.col("_seg") == F.col("_place")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = [_whole(fn, arg, i).alias(n) for i, (n, (fn, arg)) in enumerate(functions.items())]
    ranked = local.join(parts, same).select(*df.columns, *out)
    return ranked.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in cold.schema]).unionByName(cold)


def _plain(fn: str, arg: str | int | None, w) -> Column:
    """The function by Spark's own window."""
    if fn in RANKS:
        return F.call_function(fn, *([F.lit(int(arg))] if fn == "ntile" else [])).over(w)
    return F.call_function(fn, _value(arg)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _value(arg: str | int | None) -> Column:
    return F.col(arg) if isinstance(arg, str) and arg != "*" else F.lit(1)


def _inside(fn: str, arg: str | int | None, w) -> Column:
    """The function within a segment."""
    if fn in ("rank", "percent_rank"):
        return F.rank().over(w)
    if fn == "dense_rank":
        return F.dense_rank().over(w)
    if fn == "cume_dist":
        return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))
    return F.call_function(fn, _value(arg)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def _total(fn: str, arg: str | int | None, local: str) -> Column:
    """What a segment adds to the ones after it."""
    if fn == "dense_rank":
        return F.max(local)
    return F.call_function(fn, _value(arg)) if fn in RUNNING else F.count(F.lit(1))


def _whole(fn: str, arg: str | int | None, i: int) -> Column:
    """The function over the whole partition."""
    x, carry, zero = F.col(f"_x{i}"), F.col(f"_c{i}"), F.lit(0)
    rn, prior, count = F.col("_rn") + F.col("_before"), F.col("_before"), F.col("_all")
    if fn == "row_number":
        return rn.cast("int")
    if fn == "rank":
        return (x + prior).cast("int")
    if fn == "dense_rank":
        return (x + F.coalesce(carry, zero)).cast("int")
    if fn == "percent_rank":
        return F.when(count > 1, (x + prior - 1) / (count - 1)).otherwise(F.lit(0.0))
    if fn == "cume_dist":
        return (x + prior) / count
    if fn == "ntile":
        # The first buckets hold one row more when the rows do not divide evenly.
        size, extra = F.floor(count / int(arg)), count % int(arg)
        large = extra * (size + 1)
        return F.when(rn <= large, F.ceil(rn / (size + 1))).otherwise(extra + F.ceil((rn - large) / size)).cast("int")
    if fn == "count":
        return x + F.coalesce(carry, zero)
    if fn == "sum":
        return F.coalesce(x + carry, x, carry)
    return F.least(x, carry) if fn == "min" else F.greatest(x, carry)
