"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: each source's share of all words by its weight, at most ``epochs``
times its own size; what a full source leaves is shared among the others by
weight until none is above.

Schedule: slot i has the point frac(i * golden ratio) (as a 32-bit fraction,
which repeats after 2^31 slots). Points fall through the cumulative targets
to a source, so that every stretch of slots holds the sources in proportion.
The k-th slot of a source takes the k-th block of its stream: its documents,
shuffled by hash, laid end to end and cut into blocks of ``block_words``
words, over and over. A source's slots end where its target is reached; the
last one is cut there. What chance leaves short at the end of the points is
appended.

Ranks and offsets are sums over buckets, so a source with a third of all rows
is spread over many tasks. Points meet sources by an equality on cells of a
grid, blocks by an equality on (source, block).

Null source: a source of its own, last. Null text: no words; documents
without words are never taken. Repeated rows are documents of their own; they
follow each other in the stream. Its order is that of hashes of identifier,
text and source, so all of it depends on the rows alone, not on how they are
split, and reruns agree. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import WORD, as_doc, hold, quoted, running_sum, whole_text

# frac(golden ratio) as a fraction of 2^32.
GOLDEN = 2654435769
GRID = 4096
SPACED_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


# Rows with equal ones of these are the same to the schedule.
SAME = ["key", "size", "mark", "mark2"]


def sized(docs: DataFrame, extra: list[Column] = (), text: str = "text", id: str = "doc_id", source: str = "source", others: list[str] = ()) -> DataFrame:
    """doc_id, key (of the source, never null), size in words, two hashes of the row: identifier, text, source and ``others``."""
    name = F.col(quoted(source)).cast("string")
    key = F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name))
    known = [F.col(quoted(c)) for c in (id, text, source, *others)]
    marks = [F.xxhash64(F.lit(i), *known).alias(m) for i, m in enumerate(SAME[2:])]
    return docs.select(F.col(quoted(id)).alias("doc_id"), key.alias("key"), word_count(text).alias("size"), *marks, *extra)


def targets(sizes: DataFrame, weights: tuple[float, ...], epochs: float) -> DataFrame:
    """key, source_size, target, from sizes (key, source_size): one row per source.

    Sources in order of code points, null last, weigh ``weights`` in turn.
    """
    # Keys are 'n' (null) and 's...'; "s" first.
    ranked = sizes.withColumn("at", F.row_number().over(Window.orderBy(F.col("key") == "n", "key")) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select("key", "source_size", F.get(turn, F.pmod("at", F.lit(len(weights))).cast("int")).alias("w"), (F.col("source_size") * epochs).alias("most"))
    ranked = hold(ranked, "sources")
    # A full source stays full: each round either fills one or is the last.
    level, full = None, -1
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.lit(False) if level is None else F.col("most") <= F.col("w") * level
        got = ranked.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.count(F.when(over, 1))).first()
        if got[2] == full or not got[1]:
            break
        full, level = got[2], (total - got[0]) / got[1]
    share = F.least(F.col("most"), F.col("w") * F.lit(float(level or 0.0)))
    return ranked.select("key", "source_size", share.cast("double").alias("target"))


def schedule(docs: DataFrame, weights: tuple[float, ...], epochs: float, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(slots, sources): the mix in order, for docs (doc_id, key, size, ...) as ``sized`` gives them, held.

    Slots: slot (null for an appended one, which comes after all others by
    key and k), key, k, block, row (of the document), words taken from it.
    """
    sizes = docs.groupBy("key").agg(F.sum("size").alias("source_size"))
    sources = hold(targets(sizes, weights, epochs), "targets")
    quota = sources.withColumn("words", F.least(F.round("target"), F.col("source_size") * epochs).cast("long")).where("source_size > 0")
    blocks = F.ceil(F.col("source_size") / block_words)
    rest = F.col("words") % F.col("source_size")
    rounds = F.floor(F.col("words") / F.col("source_size"))
    quota = quota.withColumn("blocks", blocks).withColumn("slots", rounds * blocks + F.ceil(rest / block_words)).withColumn("rounds", rounds).withColumn("rest", rest)
    total = quota.agg(F.sum("slots")).first()[0] or 0
    spark = docs.sparkSession
    # Points to sources.
    upto = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = quota.select("key", "slots", (F.coalesce(F.sum("slots").over(upto), F.lit(0)) / max(total, 1)).alias("low"))
    ends = ends.withColumn("high", F.col("low") + F.col("slots") / max(total, 1)).where("slots > 0")
    last = Window.orderBy(F.desc("key"))
    ends = ends.withColumn("high", F.when(F.row_number().over(last) == 1, 2.0).otherwise(F.col("high")))
    cells = ends.select("key", "slots", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1).cast("long")))).alias("cell"))
    point = F.pmod(F.pmod("id", F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
    points = spark.range(total).select(F.col("id").alias("slot"), point.alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * GRID)).join(cells, "cell").where("x >= low and x < high").select("slot", "key", "slots")
    # The rank of a slot among its source's: sums over stretches of slots, and a window within a stretch.
    stretch = F.floor(F.col("slot") / 8192)
    points = hold(points.withColumn("stretch", stretch), "points")
    counts = points.groupBy("key", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "stretch").orderBy("slot")
    ranked = points.withColumn("at", F.row_number().over(within) - 1).join(counts, ["key", "stretch"])
    ranked = ranked.select("slot", "key", (F.col("start") + F.col("at")).cast("long").alias("k"), "slots").where("k < slots").drop("slots")
    have = points.groupBy("key").agg(F.count("*").alias("have"))
    short = quota.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    short = short.select(F.lit(None).cast("long").alias("slot"), "key", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("k"))
    slots = ranked.unionByName(short).join(quota.select("key", "blocks", "rounds", "rest"), "key")
    block = F.col("k") % F.col("blocks")
    # In the last round the words end at `rest`.
    room = F.when(F.floor(F.col("k") / F.col("blocks")) < F.col("rounds"), F.lit(block_words)).otherwise(F.least(F.lit(block_words), F.col("rest") - block * block_words))
    slots = slots.select("slot", "key", "k", block.cast("long").alias("block"), room.cast("long").alias("room"))
    # Documents laid end to end, and cut.
    laid = _laid(docs.where("size > 0"))
    end = F.col("offset") + F.col("size")
    pieces = laid.select("row", "key", "offset", end.alias("end"), F.explode(F.sequence(F.floor(F.col("offset") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    pieces = pieces.select("row", "key", "block", F.greatest(F.col("offset") - F.col("block") * block_words, F.lit(0)).alias("from"), F.least(F.col("end") - F.col("block") * block_words, F.lit(block_words)).alias("to"))
    mix = slots.join(pieces, ["key", "block"]).withColumn("words", F.least("to", "room") - F.col("from")).where("words > 0")
    return mix.select("slot", "key", "k", "block", "row", "from", "words"), sources


def _laid(docs: DataFrame) -> DataFrame:
    """row, key, size, offset in the stream of its source. ``row`` decides among rows that are the same only."""
    alike = hold(docs.groupBy(*SAME).agg(F.count("*").alias("times")), "alike")
    starts = running_sum(alike, "key", ["mark", "mark2", "size"], F.col("size") * F.col("times"), "start")
    laid = hold(docs.select("row", *SAME).join(starts, SAME), "laid")
    repeated = laid.where("times > 1").withColumn("group", F.concat_ws(":", "mark", "mark2", "size", "key"))
    repeated = running_sum(repeated, "group", ["row"], F.lit(1), "rank")
    offset = F.col("start") + F.col("rank") * F.col("size")
    return laid.where("times = 1").withColumn("rank", F.lit(0)).unionByName(repeated.drop("group")).select("row", "key", "size", offset.alias("offset"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    epochs: float = 3,
    block_words: int = 1024,
    text: str = "text",
    id: str = "doc_id",
    source: str = "source",
    extra: list[Column] = (),
    others: list[str] = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the extra columns.

    Rows that differ in one of the columns ``others`` only are not the same.
    """
    base = hold(sized(docs, [F.monotonically_increasing_id().alias("row"), *extra], text, id, source, others), "sizes")
    mix, sources = schedule(base, weights, epochs, block_words)
    taken = mix.groupBy("row").agg(F.sum("words").alias("taken"))
    return base.join(sources, "key").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("row", "key", "mark", "mark2")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), epochs: float = 3, block_words: int = 1024) -> DataFrame:
    """The documents of the mix, as often as it takes them whole, and the first words of those that it takes in part.

    A source ends inside one document at most: what is taken of that one is a
    row with its text cut after the last taken word (white space before a word
    goes with it). So the rows of a source hold just the words that it gives.
    All other columns stay as they came, those that describe the text too.
    """
    # Spark hashes no maps.
    others = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.name not in ("doc_id", "text", "source")]
    mixed = mix_sources(docs, weights, epochs, block_words, extra=[as_doc(docs)], others=others).where("taken > 0")
    rest = (F.col("taken") % F.col("size")).cast("int")
    words = F.regexp_extract_all(F.col("doc.text").cast("string"), F.lit(SPACED_WORD), F.lit(0))
    cut = F.when(rest > 0, F.array(F.col("doc").withField("text", F.array_join(F.slice(words, F.lit(1), rest), "")))).otherwise(F.array())
    whole = F.array_repeat("doc", F.floor(F.col("taken") / F.col("size")).cast("int"))
    return mixed.select(F.explode(F.concat(whole, cut)).alias("doc")).select("doc.*")
