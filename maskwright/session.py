"""Session helpers: shared work folders, lineage cuts, recommended settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def recommended_conf() -> dict[str, str]:
    """Settings the jobs of this package are designed for."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # AQE broadcasts a shuffled side only after it has measured it, and splits
        # skewed sort-merge partitions. Joins carry hints where Spark's estimate
        # before that is far too small, or where a side was counted.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it.

    Only a local session may fall back to a temporary folder of the machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="maskwright-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def run_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared one, for a table or a stream checkpoint."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder; it survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def hold(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the folder that all executors share: computed once, and no lineage behind it.

    A checkpoint hands on what Spark knows of the columns, and a loop of them
    derives more from it in each round. A table brings its size and no more.
    """
    spark = df.sparkSession
    path = run_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, most: int = 16, per_core: int = 1) -> DataFrame:
    """Rows of few large splits (one file, a compressed log) dealt out to idle cores.

    For work that costs far more per row than the shuffle. A table with
    enough splits stays as it is, and no split is cut into more than ``most``.
    ``per_core``: tasks per core, where rows cost so much that one task each would run for long.
    """
    have = df.rdd.getNumPartitions()
    want = min(df.sparkSession.sparkContext.defaultParallelism * per_core, have * most)
    return df if have >= want else df.repartition(want)
