"""Catalogue sources: column inventory, table descriptions, value samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators.rules import RuleSet

INVENTORY_SCHEMA = "db string, table string, column string, type string, view boolean, generated boolean, type_loose boolean"
SAMPLE_ROWS = 20
SAMPLE_CHARS = 256


def column_inventory(spark: SparkSession, tables: dict[str, DataFrame], db: str, views: tuple[str, ...] = ()) -> DataFrame:
    """One row per column of every table, from the schemas alone."""
    rows = [
        (db, table, f.name, f.dataType.simpleString(), table in views, False, False)
        for table, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)


def catalog_inventory(spark: SparkSession, db: str | None = None) -> DataFrame:
    """The inventory of a database of the session catalogue."""
    db = db or spark.catalog.currentDatabase()
    rows = []
    for t in spark.catalog.listTables(db):
        view = t.tableType in ("VIEW", "TEMPORARY")
        name = t.name if t.isTemporary else f"`{db}`.`{t.name}`"
        for c in spark.catalog.listColumns(name):
            rows.append((db, t.name, c.name, c.dataType, view, False, False))
    return spark.createDataFrame(rows, INVENTORY_SCHEMA)


def _cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) of the given columns, without nulls."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).where("value is not null")


def sample_columns(df: DataFrame, cols: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """At most n values per column, the same ones on every run: (column, value).

    Whole values are ordered; what is shown of one is cut to SAMPLE_CHARS.
    """
    cells = _cells(df, cols)
    order = Window.partitionBy("column").orderBy(F.xxhash64("value"), "value")
    # Spark keeps n rows per column in each map task before the shuffle
    # (WindowGroupLimit), so no column travels whole.
    kept = cells.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return kept.select("column", F.substring("value", 1, SAMPLE_CHARS).alias("value"))


def describe_table(df: DataFrame, db: str, table: str, rules: RuleSet = RuleSet()) -> DataFrame:
    """Per column: type, nullability, row and null counts, and the mask it is under. One pass."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(df.schema.fields):
        aggs.append(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}"))
    items = [
        F.struct(
            F.lit(db).alias("db"),
            F.lit(table).alias("table"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
            F.col("_rows").alias("row_count"),
            F.col(f"_n{i}").alias("null_count"),
            F.lit(rules.mode(db, table, f.name)).cast(T.StringType()).alias("mode"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*items)))
