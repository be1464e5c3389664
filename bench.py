"""Time the headline queries: one JSON line on stdout.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.functions.detectors import mask_all
from maskwright.session import spread
from suite import QUERIES, load, table

HEADLINE = [
    "flagship_documents",
    "b5_scan_content",
    "b8_resolve_modes",
    "c1_email_documents",
    "c5_card_documents",
    "d5_mask_table",
    "d5_mask_lineitem",
    "d9_redact_errors",
    "d13_leak_scan",
    "e6_join_inner",
    "e6_join_pii",
    "e14_group_pii",
    "e20_string_agg",
    "e25_distinct_on",
    "e26_ranking",
    "e26_ranking_hot",
    "e33_recursive",
    "f2_k_min_group",
    "f3_k_subjects",
    "f5_k_profile",
    "h3_statement_shape",
    "h5_top_shapes",
    "h8_classify_log",
    "h12_fingerprint",
    "h14_weigh_plans",
    "h18_propagate",
    "h21_grant_coverage",
    "h22_grant_ledger",
    "h25_verify_chain",
    "i2_refusals_windowed",
]


def mask_documents(spark, sf):
    """The default chain of detectors over every text."""
    return spread(table(spark, sf, "documents")).select("doc_id", mask_all(F.col("text")).alias("text"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # One file may be small: split it so that every core reads.
        .config("spark.sql.files.maxPartitionBytes", str(4 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    load()
    jobs = {"chain_documents": mask_documents, **{n: QUERIES[n] for n in HEADLINE}}
    wanted = sys.argv[1:]
    # Once untimed: the JVM and the file cache start cold.
    table(spark, sf, "lineitem").write.format("noop").mode("overwrite").save()
    mask_documents(spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in jobs.items():
        if wanted and name not in wanted:
            continue
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    chars = table(spark, sf, "documents").selectExpr("sum(char_length(text)) c").first()["c"]
    line = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}
    if "chain_documents" in times:
        line["detector_chars_per_sec"] = int(chars / times["chain_documents"])
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
