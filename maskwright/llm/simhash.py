"""Near-duplicates by SimHash, candidates pruned with pigeonring filtering.

A fingerprint has one bit for each of 64 positions: set if over half of the
shingle hashes (XXH64, seed 42) have it set. Fingerprints link at
``max_bits`` (0, 1 or 2) or fewer differing bits, without exception.

Search: the 64 bits form a ring of four segments. If two fingerprints differ
in at most two bits, some chain of consecutive segments keeps, for each of its
prefixes of l segments, to at most floor(l * 2 / 4) differences; its first
segment is equal, and so is another one. Fingerprints therefore meet by
equality of two segments (32 bits, six pairs), the chains prune, and the full
Hamming distance decides. A pair of segments that more than ``bucket``
fingerprints share is not paired up: those fingerprints meet by equality of
whole 64-bit neighbours instead (two fingerprints at up to two bits have a
common neighbour at up to one), where no bucket can exceed 65.

Only distinct fingerprints are compared; thousands of copies are one of them.

Null texts are empty; a text without words has fingerprint zero. A null
identifier stays in the result and never names a component that has another.
Repeated rows stay, each with its component. An empty table gives an empty
result. Only the two named columns are read, so others cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import WORD, as_doc, ascii_lower, components, held, hold, quoted, whole_text

SEED = 42
SEGMENTS = 4
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = ends[min(words, len(tokens)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a long."""

    def run(batches):
        for batch in batches:
            fps = [simhash(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    return read.mapInArrow(run, T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), T.StructField("fp", T.LongType())]))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _segment(i: int) -> int:
    width = 64 // SEGMENTS
    return ((1 << width) - 1) << (width * i)


def _ring(x, max_bits: int):
    """Some chain of the ring keeps to its share of the budget at each of its prefixes."""
    d = [F.bit_count(x.bitwiseAND(F.lit(_signed(_segment(i))))) for i in range(SEGMENTS)]
    viable = F.lit(False)
    for start in range(SEGMENTS):
        chain, total = F.lit(True), F.lit(0)
        for length in range(1, SEGMENTS):
            total = total + d[(start + length - 1) % SEGMENTS]
            chain = chain & (total <= length * max_bits // SEGMENTS)
        viable = viable | chain
    return viable & (F.bit_count(x) <= max_bits)


def links(nodes: DataFrame, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the distinct longs ``fp`` that differ in at most max_bits bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    pairs = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]
    at = [
        F.struct(F.lit(p).cast("byte").alias("p"), F.col("fp").bitwiseAND(F.lit(_signed(_segment(i) | _segment(j)))).alias("v"))
        for p, (i, j) in enumerate(pairs)
    ]
    keyed = nodes.select("fp", F.explode(F.array(*at)).alias("k")).select("fp", "k.p", "k.v")
    hot = keyed.groupBy("p", "v").count().where(F.col("count") > bucket).drop("count")
    small = keyed.join(hot, ["p", "v"], "left_anti").groupBy("p", "v").agg(F.collect_list("fp").alias("fps"))
    crowded = keyed.join(hot, ["p", "v"], "left_semi").select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    balls = crowded.select("fp", F.explode(near).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("fps"))

    def met(groups, test):
        pairs = groups.where(F.size("fps") > 1).select("fps", F.explode("fps").alias("a"))
        return pairs.select("a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & test(b.bitwiseXOR(F.col("a"))))).alias("b"))

    found = met(small, lambda x: _ring(x, max_bits)).union(met(balls, lambda x: F.bit_count(x) <= max_bits))
    return found.distinct()


def near_groups(docs: DataFrame, words: int = 3, max_bits: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links reach, its own included)."""
    fps = hold(fingerprints(docs, words, text, id), "fingerprints")
    nodes = hold(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = roots.join(nodes, "fp")
    merged = linked.groupBy("root").agg(F.min("least").alias("low")).join(roots, "root").select("fp", "low")
    of = nodes.join(merged, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def near_edges(docs: DataFrame, words: int = 3, max_bits: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Pairs (a, b) of identifiers whose components are those of ``near_groups``: no pair for a document that is alone."""
    fps = hold(fingerprints(docs, words, text, id), "fingerprints")
    nodes = hold(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    same = fps.join(nodes, "fp").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    between = links(nodes.select("fp"), max_bits)
    for side in "ab":
        between = between.join(nodes.select(F.col("fp").alias(side), F.col("least").alias(f"of_{side}")), side)
    return same.union(between.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


# --- near copies of whole documents -------------------------------------------------------------

SAMPLE, HOT, WIDTH, BLOCK = 1 << 22, 1 << 18, 512, 1024
# Texts whose shingles a worker holds at once.
AT_ONCE = 256


def document_key(text: str = "text", id: str = "doc_id"):
    """What tells a document from others that carry the same identifier."""
    return F.concat_ws(":", F.coalesce(F.col(quoted(id)).cast("string"), F.lit("")), F.hex(F.xxhash64(ascii_lower(whole_text(text)))))


def _slices(batches):
    """The rows of the batches, AT_ONCE at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _sets(batch, words: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column("text")]


def hot_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, their counts): those that come most often in a sample of documents, at most HOT."""

    def run(batches):
        for batch in _slices(batches):
            for part in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64))], ["shingle"])

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    one_in = max(1, size // (6 * SAMPLE))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
    counts = hold(sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 3"), "hot-shingles")
    level = F.floor(F.log2("count") * 4)
    least, taken = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("level")).collect():
        if taken + r["n"] > HOT:
            break
        taken, least = taken + r["n"], r["least"]
    found = counts.where(F.col("count") >= (least if least is not None else 1 << 62)).toArrow()
    shingles = found["shingle"].to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["count"].to_numpy()[order]


def prefixes(docs: DataFrame, words: int, similarity: float, text: str, id: str) -> DataFrame:
    """(key, doc_id, n distinct shingles, bits, prefix): one row per document.

    The prefix are the first n - ceil(similarity * n) + 1 shingles in an order
    that is the same for all documents (by hash, the hot ones last, the hottest
    at the end): two sets as alike as ``similarity`` share one of them. The bits
    are the parities of the shingles over as many classes as there are shingles
    (a power of two, WIDTH at least), folded to compare sets of unequal sizes;
    two sets differ in at least as many shingles as their bits do.
    """
    read = docs.select(document_key(text, id).alias("key"), F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(hot_shingles(read, words))

    def prefix(part, hot, counts):
        if not len(part):
            return part
        most = len(part) - math.ceil(similarity * len(part) - 1e-9) + 1
        if len(hot):
            at = np.minimum(np.searchsorted(hot, part), len(hot) - 1)
            part = part[np.argsort(np.where(hot[at] == part, counts[at], 0), kind="stable")]
        return part[:most]

    def bits(part):
        width = max(WIDTH, 1 << (len(part) - 1).bit_length()) if len(part) else WIDTH
        odd = np.bincount((part >> np.uint64(32)).astype(np.int64) % width, minlength=width) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def run(batches):
        hot, counts = sent.value
        for batch in _slices(batches):
            sets = _sets(batch, words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([bits(x) for x in sets], pa.binary()),
                    pa.array([prefix(x, hot, counts).view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["key", "doc_id", "n", "bits", "prefix"],
            )

    kind = T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("doc_id", read.schema["doc_id"].dataType),
        T.StructField("n", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
    ])
    return read.mapInArrow(run, kind)


def _jaccard(words: int):
    def run(batches):
        for batch in batches:
            out, last, left = [], None, None
            for a, b in zip(batch.column("a_text"), batch.column("b_text")):
                if (text := a.as_py()) != last:
                    last, left = text, np.unique(shingle_hashes(text, words))
                right = np.unique(shingle_hashes(b.as_py(), words))
                both = len(np.intersect1d(left, right, assume_unique=True))
                out.append(both / max(1, len(left) + len(right) - both))
            kept = ["row_a", "row_b", "a", "b"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out, pa.float64())], [*kept, "jaccard"])

    return run


def _unlike(similarity: float) -> float:
    """Of two sets as alike as ``similarity``, the part of both sizes in which they differ at most."""
    return (1 - similarity) / (1 + similarity)


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The bits of a set at a smaller width of ``size`` bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, "<u8").reshape(-1, size // 8), axis=0)


def _across(similarity: float):
    """Pairs of a block that are in different groups and that sizes and bits do not rule out."""

    def run(block):
        out = [np.empty((2, 0), np.int64)]
        bits = block.column("bits").to_pylist()
        sizes = np.array([len(x) for x in bits])
        columns = [block.column(k).to_numpy() for k in ("row", "root", "n", "side")]
        one = (columns[3] == columns[3][0]).all()
        # Sets that can be alike have widths that are equal or next to each other.
        for size in np.unique(sizes).tolist():
            of = np.flatnonzero((sizes == size) | (sizes == 2 * size))
            row, root, n, side = (c[of] for c in columns)
            least, folded = sizes[of] == size, np.stack([_folded(bits[i], size) for i in of])
            for at in range(0, len(of), 64):
                part = slice(at, at + 64)
                fits = (root[part, None] != root) & (row[part, None] < row) & (least[part, None] | least)
                fits &= np.minimum(n[part, None], n) >= similarity * np.maximum(n[part, None], n) - 1e-9
                if not one:
                    fits &= side[part, None] != side
                left, right = np.nonzero(fits)
                left += at
                step = max(1, (1 << 22) // size)
                for i, j in ((left[k : k + step], right[k : k + step]) for k in range(0, len(left), step)):
                    apart = np.bitwise_count(folded[i] ^ folded[j]).sum(1, dtype=np.int64)
                    near = apart <= _unlike(similarity) * (n[i] + n[j]) + 1e-9
                    out.append(np.stack((row[i[near]], row[j[near]])))
        a, b = np.concatenate(out, axis=1)
        return pa.table({"a": a, "b": b})

    return run


def _near_bits(similarity: float):
    """Pairs whose bits do not rule them out."""

    def run(batches):
        for batch in batches:
            sizes = zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), batch.column("n").to_pylist())
            kept = []
            for x, y, n in sizes:
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(dtype=np.int64))
                kept.append(apart <= _unlike(similarity) * n + 1e-9)
            yield batch.filter(pa.array(kept, pa.bool_())).select(["row_a", "row_b", "a", "b"])

    return run


LINK = "row_a long, row_b long, a string, b string, jaccard double"


def near_links(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, few: int = 8, text: str = "text", id: str = "doc_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: key, doc_id), (links: a, b, jaccard), (groups: key, root), of documents alike by their word shingles.

    Whole-document fingerprints differ in some 10 of 64 bits at a similarity
    of 0.8, which no index prunes. So documents meet by equality of a shingle
    of their ``prefixes``, which no pair misses, and a link stands only if the
    exact Jaccard similarity of the shingle sets reaches ``similarity``.

    In a set of up to ``few`` documents that meet, all pairs are checked. In a
    larger one each document is first checked against the centre, the one that
    meets most others over all shingles; then every pair that is not connected
    by then is, in blocks of about BLOCK documents, unless sizes or bits rule
    it out. So the links connect just what those of all pairs would.
    """
    base = hold(prefixes(docs, words, similarity, text, id).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    # Of repeated rows one is enough. Their table is held: where it is small, Spark sends it to the tasks.
    repeated = hold(base.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("key", "least"), "repeated")
    once = base.join(repeated, "key", "left").where("least is null or row = least")
    info = hold(once.select("row", "key", "n", "bits"), "documents")
    cells = once.select("row", F.explode("prefix").alias("token"))
    same = [F.bit_xor(F.xxhash64(F.lit(i), "row")).alias(f"s{i}") for i in range(2)]
    shared = cells.groupBy("token").agg(F.count("*").alias("size"), *same).where("size > 1")
    # Of shingles that the same documents share one is enough.
    shared = shared.groupBy("size", "s0", "s1").agg(F.min("token").alias("token")).select("token", "size")
    cells = hold(cells.join(shared, "token"), "cells")
    small = cells.where(F.col("size") <= few).groupBy("token").agg(F.collect_list("row").alias("all"))
    small = small.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda y: y > F.col("a"))).alias("b"))
    large = cells.where(F.col("size") > few)
    met = large.groupBy("row").agg(F.sum("size").alias("met"))
    centres = large.join(met, "row").groupBy("token").agg(F.max(F.struct("met", "row"))["row"].alias("centre"))
    star = large.join(centres, "token").select(F.least("row", "centre").alias("a"), F.greatest("row", "centre").alias("b")).where("a <> b")
    first, n, _ = held(small.union(star).distinct(), "pairs")
    named, none = base.select("key", "doc_id"), base.sparkSession.createDataFrame([], LINK)
    if not n:
        return named, none.select("a", "b", "jaccard"), none.select(F.col("a").alias("key"), F.col("row_b").alias("root"))
    found = _scored(docs, first, info, words, similarity, text, id)
    roots = hold(components(found.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))).withColumnRenamed("node", "row"), "roots")
    # What a shingle's documents still are: usually one group each, and then nothing is left to do.
    grouped = large.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    apart = grouped.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    apart, n, _ = held(apart, "apart")
    more = none
    if n:
        sides = F.ceil(F.col("size") / BLOCK)
        kept = hold(large.join(apart, "token").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "grouped")
        dealt = kept.join(info.select("row", "n", "bits"), "row").withColumn("side", F.pmod(F.xxhash64("row"), sides))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), sides - 1)))
        dealt = dealt.select("token", F.least("side", "other").alias("from"), F.greatest("side", "other").alias("to"), "row", "root", "n", "bits", "side")
        blocks = dealt.groupBy("token", "from", "to")
        second = blocks.applyInArrow(_across(similarity), "a long, b long").distinct()
        second, n, _ = held(second.join(first, ["a", "b"], "left_anti"), "pairs")
        if n:
            more = _scored(docs, second, info, words, similarity, text, id)
    linked = found.union(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    return named, linked, _merged(info, roots, more if n else None)


def _merged(info: DataFrame, roots: DataFrame, more: DataFrame | None) -> DataFrame:
    """(key, root) of the rows (row, root) after further links, which join whole groups: only their roots are linked anew."""
    if more is not None:
        of = roots.select("row", "root")
        ends = more.select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
        for side in "ab":
            ends = ends.join(of.select(F.col("row").alias(side), F.col("root").alias(f"to_{side}")), side, "left")
            ends = ends.withColumn(side, F.coalesce(f"to_{side}", side)).drop(f"to_{side}")
        joined = hold(components(ends), "joined").select(F.col("node").alias("root"), F.col("root").alias("low"))
        alone = joined.select(F.col("root").alias("row"), "root").join(of, "row", "left_anti")
        roots = of.union(alone).join(joined, "root", "left").select("row", F.coalesce("low", "root").alias("root"))
    return roots.join(info.select("row", "key"), "row").select("key", "root")


def _scored(docs: DataFrame, pairs: DataFrame, info: DataFrame, words: int, similarity: float, text: str, id: str) -> DataFrame:
    """(row_a, row_b, a, b, jaccard) of the pairs (a, b) of rows that are as alike as ``similarity``."""
    sides = [info.select(F.col("row").alias(x), F.struct("key", "n", "bits").alias(f"of_{x}")) for x in "ab"]
    met, m, n = pairs.join(sides[0], "a").join(sides[1], "b"), F.col("of_a.n"), F.col("of_b.n")
    met = met.where(F.least(m, n) >= similarity * F.greatest(m, n) - 1e-9)
    named = [F.col("a").alias("row_a"), F.col("b").alias("row_b"), F.col("of_a.key").alias("a"), F.col("of_b.key").alias("b")]
    met = met.select(*named, F.col("of_a.bits").alias("bits_a"), F.col("of_b.bits").alias("bits_b"), (m + n).alias("n"))
    met, n, _ = held(met.mapInArrow(_near_bits(similarity), "row_a long, row_b long, a string, b string"), "met")
    if not n:
        return docs.sparkSession.createDataFrame([], LINK)
    texts = docs.select(document_key(text, id).alias("key"), whole_text(text).alias("text"))
    needed = met.select("a").union(met.select("b")).distinct().withColumnRenamed("a", "key")
    texts = hold(texts.join(needed, "key", "left_semi").dropDuplicates(["key"]), "texts")
    both = met.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    both = both.join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b").select("row_a", "row_b", "a", "b", "a_text", "b_text")
    return hold(both.mapInArrow(_jaccard(words), LINK).where(F.col("jaccard") >= similarity), "near")


def drop_near_copies(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", id: str = "doc_id", max_bits: int | None = None
) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id, and all other documents.

    A group is what links connect: those of ``near_links``, and, where ``max_bits`` is given, also those of SimHash
    fingerprints (of three-word shingles) at that many or fewer differing bits. Texts without words link to nothing and
    stay. Rows with the same identifier and the same text (but for the case of A-Z) stay or go together.
    """
    known, _, groups = near_links(docs, words, similarity, text=text, id=id)
    roots = hold(groups, "groups")
    if max_bits is not None:
        worded = docs.select(document_key(text, id).alias("key"), whole_text(text).alias("text")).where(F.col("text").rlike(WORD))
        least = roots.groupBy("root").agg(F.min("key").alias("b"))
        alike = roots.join(least, "root").select(F.col("key").alias("a"), "b")
        joined = components(near_edges(worded, max_bits=max_bits, id="key").union(alike))
        roots = hold(joined.withColumnRenamed("node", "key"), "groups")
    members = roots.join(known, "key")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("key"))
    gone = hold(roots.select("key").join(best.select("key"), "key", "left_anti"), "gone")
    return docs.select(document_key(text, id).alias("key"), as_doc(docs)).join(gone, "key", "left_anti").select("doc.*")
