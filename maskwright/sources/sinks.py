"""Sinks: protected copies of tables, capped exports, rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import detectors as det
from maskwright.operators.masking import mask_table
from maskwright.operators.output import Limits, measured_lines
from maskwright.operators.rules import RULE_SCHEMA, valid_pattern
from maskwright.session import cut_lineage


def publish_masked(df, db, table, rules, path, names=det.DEFAULT_DETECTORS, partition_by=(), mode="errorifexists"):
    """Write the protected copy of a table as parquet."""
    out = mask_table(df, db, table, rules, names).write.mode(mode)
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


BATCH = "batch"


def store_batch(df: DataFrame, name: str, batch: str) -> None:
    """Store df in a catalogue table as the batch of that label.

    The table is partitioned by ``batch``, and a batch is replaced whole: the
    same write again, after a lost driver say, leaves no doubles, an empty one
    leaves no rows, and other batches stay. The first write makes the table.
    Columns meet by name, in any case; one that the table lacks or that df
    lacks, and one of another type, fails the write before anything is stored.
    """
    spark = df.sparkSession
    if BATCH in [c.lower() for c in df.columns]:
        raise ValueError(f"store_batch: {BATCH} is the column of the label")
    if not spark.catalog.tableExists(name):
        empty = df.withColumn(BATCH, F.lit(batch)).limit(0)
        empty.write.format("parquet").partitionBy(BATCH).saveAsTable(name)
    target = spark.table(name).schema
    if [c.name for c in spark.catalog.listColumns(name) if c.isPartition] != [BATCH]:
        raise ValueError(f"store_batch: {name} is not partitioned by {BATCH} alone")
    have = {f.name.lower(): f for f in df.schema.fields}
    want = {f.name.lower(): f for f in target.fields if f.name != BATCH}
    if len(have) != len(df.columns) or have.keys() != want.keys():
        raise ValueError(f"store_batch: columns differ: {', '.join(sorted(have.keys() ^ want.keys()))[:200]}")
    for key, field in want.items():
        if have[key].dataType.simpleString() != field.dataType.simpleString():
            raise ValueError(f"store_batch: {field.name} is {field.dataType.simpleString()}, not {have[key].dataType.simpleString()}")
    rows = df.select(*[F.col(f"`{have[key].name}`") for key in want])
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = :label) SELECT * FROM {{rows}}", args={"label": batch}, rows=rows)


def publish_masked_table(df, db, table, rules, name, batch, names=det.DEFAULT_DETECTORS) -> None:
    """Store the protected copy of a table as a batch of a catalogue table."""
    store_batch(mask_table(df, db, table, rules, names), name, batch)


def export_capped(df: DataFrame, path: str, limits: Limits = Limits(), fmt: str = "tsv", order=(), mode: str = "errorifexists") -> None:
    """Write a governed result as text within its caps, with header and closing lines."""
    # At most max_rows lines, worked out once: body and closing lines speak of the same rows.
    lines = cut_lineage(measured_lines(df, limits, fmt, order))
    fits = F.col("running_bytes") <= limits.max_output_bytes
    body = lines.where(fits).select(F.col("row_no").alias("ord"), "line")
    shown, total = F.count_if(fits), F.count(F.lit(1))
    cut = F.when(
        shown < total,
        F.concat_ws("", F.lit(f"[output cut at {limits.max_output_bytes} bytes: "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" rows shown]")),
    )
    more = F.when(F.coalesce(F.bool_or("truncated"), F.lit(False)), F.lit(" — more rows exist beyond the row cap")).otherwise(F.lit(""))
    count = F.concat(F.lit("("), shown.cast("string"), F.lit(" rows)"), more)
    if fmt == "tsv":
        spark = df.sparkSession
        head = spark.createDataFrame([(0, "\t".join(df.columns))], "ord int, line string")
        foot = lines.agg(cut.alias("a"), count.alias("b")).select(
            F.inline(F.array(F.struct(F.lit(2**30).alias("ord"), F.col("a").alias("line")), F.struct(F.lit(2**30 + 1).alias("ord"), F.col("b").alias("line"))))
        )
        body = head.unionByName(body).unionByName(foot.where("line is not null"))
    # A capped export is one small file: its rows were limited above.
    body.coalesce(1).sortWithinPartitions("ord").select("line").write.mode(mode).text(path)


def save_rules(rules: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a rule table: valid rows only, each once, sorted."""
    canonical_rules(rules).write.mode(mode).json(path)


def canonical_rules(rules: DataFrame) -> DataFrame:
    return valid_rules(rules).where("valid").select("kind", "pattern", "mode").distinct().orderBy("kind", "pattern", "mode")


def valid_rules(rules: DataFrame) -> DataFrame:
    """The rule table with ``valid`` and ``problem``."""
    mode = F.coalesce("mode", F.lit("redact"))
    problem = (
        F.when(~F.coalesce(valid_pattern(F.col("pattern")), F.lit(False)), F.lit("pattern"))
        .when(~F.coalesce(F.col("kind").isin("mask", "allow"), F.lit(False)), F.lit("kind"))
        .when(~mode.isin("redact", "partial", "email"), F.lit("mode"))
        .when((F.col("kind") == "allow") & (mode != "redact"), F.lit("an allow rule has no mode"))
    )
    return rules.select("kind", "pattern", mode.alias("mode"), problem.isNull().alias("valid"), problem.alias("problem"))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON lines; an invalid row fails the read."""
    checked = valid_rules(spark.read.schema(RULE_SCHEMA).json(path))
    bad = checked.where(~F.col("valid")).limit(1).collect()
    if bad:
        raise ValueError(f"rule table: invalid {bad[0]['problem']}")
    return checked.select("kind", "pattern", "mode").distinct()
