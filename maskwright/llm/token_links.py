"""Alignment of two tokenizers over the same texts: groups of tokens that end together, and how their ids link.

A reads a blank and the text, byte by byte; B reads the text and puts the
blank there itself. Offsets in bytes at which a token of A and one of B both
end cut the tokens into groups. Tokens of A and B whose byte ranges overlap
are linked; the count of a pair of ids is the number of its links in the
corpus.

Per batch everything is columns: ids are flattened with the index of their
document, ends are sums of byte lengths that start anew in each document, an
Acero hash join of the (document, end) keys of both sides finds the groups,
and ``Table.group_by`` counts pairs per document. Per task the pairs are
counted again, Spark adds the counts up. What a document needs of them comes
two ways: at most HOT of the most frequent pairs travel to the tasks, all
others meet their counts in a join, where none is frequent.

A text that is null or empty, or whose joined tokens of A or B are not the
bytes of a blank and the text, has no tokens: zeros, and an empty string of
groups. A null identifier and repeated rows are documents of their own. Texts
are read whole. An empty table gives an empty result. Only the two named
columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import Recent, hold, quoted, remembered, whole_text
from maskwright.llm.piece_merges import Merges

HOT, SLICE, SLICE_BYTES, PAIRS = 1 << 19, 512, 1 << 20, 1 << 19
# Bytes that a Python worker remembers of stretches, twice for each side.
ROOM = 72 << 20
# White space as Unicode has it (a fixed value): what the pattern of A takes for it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable Latin-1 stands for itself, the other bytes for U+0100 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = remembered(
        "byte level", lambda: {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(own))}
    )
    return bytes(bytes_of[c] for c in token)


class Pair:
    """Two tokenizers: ids of texts, and the bytes of ids.

    The pattern that cuts texts for A never joins white space to what is before
    it, so a stretch of white space and what follows has the same ids in any
    text; stretches of B are those of ``Merges``. Both are encoded once and
    remembered by the worker.
    """

    def __init__(self, a: str, b: str):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        told = json.loads(self.a.to_str())
        cuts = told["pre_tokenizer"] or {}
        plain = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space")
        self.stretch = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+") if plain and told["normalizer"] is None else None
        self.merges = Merges(b)
        self.b = self.merges.library
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.a_bytes = pa.array([n.encode() if i in special else byte_level(n) for i, n in enumerate(names)], pa.binary())
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = pa.array([bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)], pa.binary())
        n, m = len(names), len(pieces)
        # Ids as text with what follows them: inside a side, at its end, at the end of the group.
        self.shown = pa.array([f"{i}{c}" for size, c in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(size)])
        self.starts = (0, n, 2 * n, 2 * n + m)
        self.a_known, self.b_known = Recent(self._encoded, ROOM), Recent(self.merges.by_library, ROOM)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        blank_first = [" " + t for t in texts]
        if self.stretch is None:
            a = self._encoded(blank_first)
        else:
            a = _looked_up(self.a_known, [self.stretch.findall(t) for t in blank_first])
        return _as_lists(a), _as_lists(_looked_up(self.b_known, self.merges.cut(texts)))


def _looked_up(known: Recent, cut: list[list[str]]) -> list[bytes]:
    ids = known.of(set().union(*cut)).__getitem__
    return [b"".join(map(ids, found)) for found in cut]


def _as_lists(raws: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, raws)]) // 4
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(raws), "<i4")))


def _pair(a: str, b: str) -> Pair:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return remembered(("token pair", a, b), lambda: Pair(a, b))


def _ends(ids: pa.ListArray, width: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(flat ids, their documents, ends in bytes from the document's start)."""
    flat, doc = ids.flatten(), pc.list_parent_indices(ids)
    sums = np.concatenate(([0], pc.cumulative_sum(width.take(flat).cast(pa.int64())).to_numpy()))
    before = sums[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
    return flat, doc, sums[1:] - before[doc.to_numpy()]


def _joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids."""
    at = pc.subtract(ids.offsets, ids.offsets[0])
    return pc.binary_join(pa.ListArray.from_arrays(at, table.take(ids.flatten())), pa.scalar(b"", pa.binary()))


def aligned(pair: Pair, texts: list[str]) -> tuple[pa.Table, pa.Table]:
    """(one row per text: COUNTS and groups; doc, a, b, n: how often ids are linked in a text)."""
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    a, b = pair.ids(texts)
    same = pc.and_(pc.equal(_joined(a, pair.a_bytes), whole), pc.equal(_joined(b, pair.b_bytes), whole))
    good = pc.and_(same, pc.greater(pc.binary_length(whole), 1))
    rows, size = np.flatnonzero(good.to_numpy(zero_copy_only=False)), len(texts)
    a, b = a.filter(good), b.filter(good)
    (a_ids, a_doc, a_end), (b_ids, b_doc, b_end) = _ends(a, pc.binary_length(pair.a_bytes)), _ends(b, pc.binary_length(pair.b_bytes))
    sides = [
        pa.table({"doc": doc, "end": end, name: np.arange(len(end))}) for name, doc, end in (("a", a_doc, a_end), ("b", b_doc, b_end))
    ]
    both = sides[0].join(sides[1], ["doc", "end"], join_type="inner", use_threads=False)
    a_last, b_last = np.sort(both["a"].to_numpy()), np.sort(both["b"].to_numpy())
    a_doc, b_doc, a_ids, b_ids = a_doc.to_numpy(), b_doc.to_numpy(), a_ids.to_numpy(), b_ids.to_numpy()
    a_is, b_is = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_is[a_last], b_is[b_last] = 1, 1
    a_group, b_group = np.cumsum(a_is) - a_is, np.cumsum(b_is) - b_is

    # Tokens of both sides in the order of the text of groups.
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    inside_a, end_a, inside_b, end_b = pair.starts
    order[np.arange(len(a_ids)) + np.concatenate(([0], b_last + 1))[a_group]] = a_ids + np.where(a_is, end_a, inside_a)
    order[np.arange(len(b_ids)) + (a_last + 1)[b_group]] = b_ids + np.where(b_is, end_b, inside_b)
    a_n, b_n, groups = (np.bincount(x, minlength=len(rows)) for x in (a_doc, b_doc, a_doc[a_last]))
    offsets = np.concatenate(([0], np.cumsum(a_n + b_n))).astype(np.int32)
    shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pair.shown.take(pa.array(order))), "")
    shown = pc.utf8_slice_codeunits(shown, 0, -1)

    # Links: from the token of B that covers the first byte to the one that covers the last.
    length = pc.binary_length(whole.filter(good)).to_numpy().astype(np.int64)
    base = np.concatenate(([0], np.cumsum(length)))[:-1]
    a_at, b_at = a_end + base[a_doc], b_end + base[b_doc]
    first = np.searchsorted(b_at, np.concatenate(([0], a_at[:-1])), "right")
    covers = np.searchsorted(b_at, a_at, "left") - first + 1
    left = np.repeat(np.arange(len(a_ids)), covers)
    right = np.arange(len(left)) - np.repeat(np.cumsum(covers) - covers - first, covers)
    linked = pa.table({"doc": rows[a_doc[left]], "a": a_ids[left], "b": b_ids[right]})
    pairs = linked.group_by(["doc", "a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "a", "b", "n"])

    counts = {name: np.zeros(size, np.int64) for name in COUNTS}
    links = np.bincount(a_doc, covers, len(rows)).astype(np.int64)
    for name, found in zip(COUNTS, (a_n, b_n, groups, links)):
        counts[name][rows] = found
    text = np.full(size, "", object)
    text[rows] = shown.to_pylist()
    return pa.table({**counts, "groups": pa.array(text, pa.string())}), pairs


def _lists(pairs: pa.Table, size: int) -> dict[str, pa.ListArray]:
    """The pairs as lists per document."""
    pairs = pairs.sort_by("doc")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(pairs["doc"].to_numpy(), minlength=size)))).astype(np.int32)
    return {c: pa.ListArray.from_arrays(pa.array(offsets), pairs[c].combine_chunks().cast(t)) for c, t in (("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()))}


def _aligned(a: str, b: str, with_groups: bool):
    def run(batches):
        pair = _pair(a, b)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SLICE)
                sizes = np.cumsum(pc.binary_length(part.column("text")).to_numpy())
                part = part.slice(0, max(1, int(np.searchsorted(sizes, SLICE_BYTES))))
                at += part.num_rows
                found, pairs = aligned(pair, part.column("text").to_pylist())
                shown = found["groups"].to_pylist()
                digest = pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown])
                lists = _lists(pairs, part.num_rows)
                columns = [part.column("doc_id"), *[found[c].combine_chunks() for c in COUNTS], digest, *lists.values()]
                names = ["doc_id", *COUNTS, "groups_sha256", *lists]
                if with_groups:
                    columns.append(pa.array(shown))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _counted(batches):
    """Pairs of all batches of a task; in parts, should they become too many."""
    kept, waiting = [], 0
    names = ["a", "b", "n"]

    def together():
        return pa.concat_tables(kept).group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).select(["a", "b", "n_sum"]).rename_columns(names)

    for batch in batches:
        kept.append(pa.table({c: batch.column(c).flatten() for c in names}))
        waiting += kept[-1].num_rows
        if waiting > 4 * PAIRS:
            kept, waiting = [together()], 0
            if kept[0].num_rows > PAIRS:
                yield from kept.pop().to_batches()
    if kept:
        yield from together().to_batches()


def pair_counts(held: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold a pair of ids, and whether no other a is linked to that b as often."""
    counts = held.select("a", "b", "n").mapInArrow(_counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = hold(counts, "pair-counts")
    # One row per id of B at most.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return hold(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _hottest(counts: DataFrame, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, counts, best) of at most ``room`` pairs, those that come most often."""
    level = F.floor(F.log2("count") * 16)
    least, taken = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("count").alias("least")).orderBy(F.desc("level")).collect():
        if taken + r["n"] > room:
            break
        taken, least = taken + r["n"], r["least"]
    found = counts.where(F.lit(False) if least is None else F.col("count") >= least).toArrow()
    keys = _keys(found["a"].to_numpy(), found["b"].to_numpy())
    order = np.argsort(keys)
    return keys[order], found["count"].to_numpy()[order], found["best"].to_numpy()[order]


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def align(docs: DataFrame, a: str, b: str, with_groups: bool = False, hot: int = HOT, text: str = "text", id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups)), and the counts of pairs (a, b, count, best).

    ``a`` is the file of a byte-level tokenizer, ``b`` that of a sentencepiece
    model with byte fallback.
    """
    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    ints = T.ArrayType(T.IntegerType())
    kind = T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType())])
    kind.add("a", ints).add("b", ints).add("n", T.ArrayType(T.LongType()))
    if with_groups:
        kind.add("groups", T.StringType())
    held = hold(read.mapInArrow(_aligned(a, b, with_groups), kind).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(held)
    sent = docs.sparkSession.sparkContext.broadcast(_hottest(counts, hot))
    shown = ["doc_id", *COUNTS, "groups_sha256", *(["groups"] if with_groups else [])]

    def looked_up(batches):
        keys, times, best = sent.value
        for batch in batches:
            lists = batch.column("n")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            wanted = _keys(batch.column("a").flatten().to_numpy(), batch.column("b").flatten().to_numpy())
            n = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
            known = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)

            def per_doc(values):
                sums = np.concatenate(([0], np.cumsum(values)))
                return sums[offsets[1:]] - sums[offsets[:-1]]

            hits = [np.zeros(len(batch), np.int64)] * 2
            if len(keys):
                hits = [per_doc(np.where(known, n * best[at], 0)), per_doc(np.where(known, n * times[at], 0))]
            rest = np.concatenate(([0], np.cumsum(~known)))[offsets].astype(np.int32)
            others = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known])) for x in (wanted >> 32, wanted & 0xFFFFFFFF, n)]
            columns = [*[batch.column(c) for c in ["row", *shown]], *map(pa.array, hits), *others]
            yield pa.RecordBatch.from_arrays(columns, ["row", *shown, "n_best", "count_sum", "a", "b", "n"])

    longs = T.ArrayType(T.LongType())
    found = T.StructType([held.schema["row"], *[held.schema[c] for c in shown], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    found.add("a", longs).add("b", longs).add("n", longs)
    partly = hold(held.mapInArrow(looked_up, found), "looked-up")
    others = partly.select("row", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row", F.col("p.a").cast("int").alias("a"), F.col("p.b").cast("int").alias("b"), "p.n")
    added = others.join(counts, ["a", "b"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("count")).alias("more_sum")
    )
    whole = partly.join(added, "row", "left")
    sums = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    order = ["doc_id", *COUNTS, *sums, *shown[1 + len(COUNTS) :]]
    return whole.select(*order), counts
