"""The audit log: JSON lines read in batch or as a stream, and numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


MAX_LINE = 4 * 1024 * 1024
EVENT_SCHEMA = """
ts timestamp, event string, profile string, engine string, host string, db string, db_user string, class string,
sql string, verdict string, decision string, error string, code string,
span struct<line:int, col:int, token:string>, rows bigint, affected bigint, duration_ms bigint, truncated boolean,
unmasked boolean, warnings array<string>, intent string, reason string, approval string, peer_uid int,
peer_user string, scope string, profiles array<string>, allow_loosen boolean, ticket string, facade string,
hub_sig string, grant string, auto_rule string, decided_by string, grant_scope string, statements_used bigint,
bytes_used bigint, managed string, prev_hash string
"""


def parse_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines as typed events, with ``skipped`` for what is no audit record. Blank lines are dropped."""
    schema = f"{EVENT_SCHEMA.strip()}, _corrupt string"
    readable = F.when(F.octet_length(line) <= MAX_LINE, F.col(line))
    parsed = (
        lines.where(F.rlike(F.col(line), F.lit(r"\S")))
        .select(F.from_json(readable, schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
        .select("e.*")
    )
    bad = F.col("event").isNull() | (F.col("event") == "") | F.col("_corrupt").isNotNull()
    return parsed.withColumn("skipped", bad).drop("_corrupt")


def read_audit(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of a log, and one row with the number of lines skipped."""
    parsed = parse_events(spark.read.text(path))
    return parsed.where(~F.col("skipped")).drop("skipped"), parsed.agg(F.count_if("skipped").alias("skipped"))


def stream_audit(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The events of a growing log folder as a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_events(lines).where(~F.col("skipped")).drop("skipped")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of a log with its file and its place in it: file, seq, line.

    A file is read in blocks; lines are counted per block, and only the block
    totals are added up in order. A line's place in its block is how far its
    id is from the block's first, whatever task reads the block.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return raw.join(blocks, ["file", "block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("seq"), "line"
    )
