"""Exact duplicates by sorting contents.

Sampled splitters range-partition the normalised texts (A-Z lowered, nothing
else), each partition is sorted outside memory, and equal texts lie next to
each other. A text is compared in full with its neighbour.

Order: the first characters, a hash of the whole text, the whole text, the
identifier. The splitters see the short parts of it only, as their sample
goes through the driver; they cut between identifiers too, so thousands of
copies of one text spread over many tasks. Runs that go on in the next
partition are tied together afterwards, again by comparing the two texts.

Nulls: a null text is empty, a null identifier comes after all others and is
kept only if its group has no other. Of repeated rows (same identifier and
text) one is kept. An empty table gives an empty result. Other columns never
clash: they travel in one struct.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import as_doc, ascii_lower, hold, quoted, whole_text


# Characters that a splitter compares before the hash.
SPLIT_ON = 16


def _marker(digest: bool):
    """Number the runs of equal texts of a sorted partition; its first and last text go along, for its neighbours."""

    def mark(batches):
        part, run, before, behind, opened = TaskContext.get().partitionId(), -1, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if behind is not None:
                yield _marked(*behind, None)
            norm = batch.column("norm")
            head = pa.concat_arrays([pa.array([before is None or norm[0].as_py() != before]), pc.not_equal(norm[1:], norm[:-1])])
            runs = pc.add(pc.cumulative_sum(head.cast(pa.int64())), run)
            shas = None
            if digest:  # once a run
                starts = pc.indices_nonzero(head)
                new = [hashlib.sha256(t.as_buffer()).hexdigest() for t in norm.take(starts)]
                at = pc.subtract(runs, run)  # 0 is the run that goes on
                shas = pa.array([shas_before if opened else None, *new]).take(at)
                shas_before = shas[-1].as_py()
            first = None if opened else norm[0].as_py()
            behind, opened = (batch, head, runs, shas, part, first), True
            run, before = runs[-1].as_py(), norm[-1].as_py()
        if behind is not None:
            yield _marked(*behind, before)

    return mark


def _marked(batch, head, runs, shas, part, first, last):
    n = batch.num_rows
    firsts, lasts = [None] * n, [None] * n
    firsts[0], lasts[-1] = first, last
    columns = [batch.column("doc"), pa.array([part] * n, pa.int32()), runs, head]
    if shas is not None:
        columns.append(shas.cast(pa.string()))
    columns += [pa.array(firsts, pa.string()), pa.array(lasts, pa.string())]
    names = ["doc", "part", "run", "head", *(["text_sha256"] if shas is not None else []), "first_text", "last_text"]
    return pa.RecordBatch.from_arrays(columns, names)


def sorted_runs(docs: DataFrame, payload, text: str, id: str, keep: str, digest: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with the run they belong to, the runs that go on from an earlier partition).

    Rows: doc (payload), part, run, head (first of its run in the partition),
    text_sha256 if asked. Moves: part, and the run that its run 0 goes on.
    """
    key = F.col(quoted(id))
    last = F.desc_nulls_last("key") if keep == "largest" else F.asc_nulls_last("key")
    rows = docs.select(payload.alias("doc"), key.alias("key"), ascii_lower(whole_text(text)).alias("norm"))
    rows = rows.withColumns({"start": F.substring("norm", 1, SPLIT_ON), "hash": F.xxhash64("norm")})
    rows = rows.repartitionByRange("start", "hash", last).sortWithinPartitions("start", "hash", "norm", last).select("doc", "norm")
    kind = T.StructType([
        T.StructField("doc", rows.schema["doc"].dataType),
        T.StructField("part", T.IntegerType()),
        T.StructField("run", T.LongType()),
        T.StructField("head", T.BooleanType()),
        *([T.StructField("text_sha256", T.StringType())] if digest else []),
        T.StructField("first_text", T.StringType()),
        T.StructField("last_text", T.StringType()),
    ])
    marked = hold(rows.mapInArrow(_marker(digest), kind), "runs")
    # A row for each partition from here on.
    edges = (
        marked.where("first_text is not null or last_text is not null")
        .groupBy("part")
        .agg(F.first("first_text", True).alias("first_text"), F.first("last_text", True).alias("last_text"), F.max("run").alias("last_run"))
    )
    by_part = Window.orderBy("part")
    order_of = edges.select("part", "last_run", F.lag("part").over(by_part).alias("prev"))
    left, right = edges.select("part", "first_text"), edges.select(F.col("part").alias("prev"), "last_text")
    goes_on = left.join(order_of, "part").join(right, "prev").where("first_text = last_text").select("part", F.lit(True).alias("goes_on"))
    chain = order_of.join(goes_on, "part", "left").withColumn(
        "base", F.expr("case when last_run > 0 then struct(part as hpart, last_run as hrun) when goes_on is null then struct(part as hpart, 0L as hrun) end")
    )
    upto = by_part.rowsBetween(Window.unboundedPreceding, -1)
    moves = chain.withColumn("from", F.last("base", True).over(upto)).where("goes_on").select("part", F.lit(0).cast("long").alias("run"), "from.hpart", "from.hrun")
    return marked.drop("first_text", "last_text"), moves


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: "smallest" or "largest", the identifier that stays of equal texts.
    """
    marked, moves = sorted_runs(docs, F.col(quoted(id)), text, id, keep, digest=True)
    marked = marked.withColumnRenamed("doc", "doc_id")
    pick = F.max if keep == "largest" else F.min
    runs = marked.groupBy("part", "run").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("n"))
    runs = runs.join(moves, ["part", "run"], "left").select(
        "part", "run", "keep_id", "n", F.coalesce("hpart", "part").alias("gpart"), F.coalesce("hrun", "run").alias("grun"), F.col("hpart").isNull().alias("starts")
    )
    groups = runs.groupBy("gpart", "grun").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    of_run = runs.drop("keep_id", "n").join(groups, ["gpart", "grun"]).drop("gpart", "grun")
    return marked.join(of_run, ["part", "run"]).select("doc_id", "keep_id", "group_size", (F.col("head") & F.col("starts")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    marked, moves = sorted_runs(docs, as_doc(docs), text, id, keep, digest=False)
    heads = marked.where("head").join(moves, ["part", "run"], "left_anti")
    return heads.select("doc.*")
