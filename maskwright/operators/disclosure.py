"""Disclosure control: k-anonymity counts as Spark jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def k_rows(df: DataFrame) -> DataFrame:
    """The rows a filtered, aggregated or DISTINCT query covers, before its projection."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def k_min_group(df: DataFrame, keys: Sequence[str | Column], having: Column | str | None = None, aggs: Sequence[Column] = ()) -> DataFrame:
    """The smallest group left after HAVING; null when no group is."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *aggs)
    if having is not None:
        groups = groups.where(having)
    return groups.agg(F.min("_k").alias("n"))


def _named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def k_values(base: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Subjects per filter value in the column's own table; an absent value counts 0, a null counts the nulls."""
    spark = base.sparkSession
    dtype = base.schema[column].dataType.simpleString()
    wanted = spark.createDataFrame([(None if v is None else str(v),) for v in dict.fromkeys(values)], "value string").select(
        F.col("value").cast(dtype).alias("value")
    )
    c = _named(column)
    kept = c.isin([v for v in dict.fromkeys(values) if v is not None])
    counts = base.where(kept | c.isNull() if None in values else kept).groupBy(c.alias("seen")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, F.col("value").eqNullSafe(F.col("seen")), "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def k_subjects(base: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """The least subject count over the values of a filter; None counts the nulls."""
    if values is None:
        return base.where(_named(column).isNull()).agg(F.count(F.lit(1)).alias("n"))
    return k_values(base, column, values).agg(F.min("n").alias("n"))


def k_report(checks: Sequence[tuple[str, DataFrame, bool]], k: int) -> DataFrame | None:
    """One row per check: its name, its count, whether it is under k, and the warning.

    A check is (name, frame with one row ``n``, grouped). A grouped check
    without a group says nothing; any other missing count is unknown.
    """
    if k <= 1 or not checks:
        return None
    rows = None
    for name, frame, grouped in checks:
        n = F.col("n")
        low = F.concat(F.lit(f"{name}: covers "), n.cast("string"), F.lit(f" rows, under k = {k}"))
        warning = F.when(n < k, low)
        if not grouped:
            warning = warning.when(n.isNull(), F.lit(f"{name}: the count is unknown"))
        row = frame.select(
            F.lit(name).alias("check"),
            n.cast("bigint").alias("n"),
            F.coalesce(n < k, F.lit(not grouped)).alias("under_k"),
            warning.alias("warning"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


def k_profile(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """The equivalence classes over the quasi-identifiers that hold fewer than k rows."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def group_by_flagged(df: DataFrame, keys: Sequence[str], k: int, aggs: Sequence[Column] = ()) -> DataFrame:
    """Groups with their size, those under k flagged."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), *aggs)
        .withColumn("under_k", F.col("n") < k)
    )
