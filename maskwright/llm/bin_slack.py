"""Packing documents into sequences by minimum bin slack.

A document becomes token ids and an end id; one longer than a sequence is cut
into whole sequences and a rest. Per bin, the longest length that is left is
set, and a subset-sum over the other lengths left (a bitset with one bit per
position of the sequence, each length as often as it is there) finds the
fullest combination that fits. That combination is removed as often as its
lengths are there, so one search fills many bins.

What the search needs is the histogram of lengths: at most ``capacity``
numbers, however many documents. The driver sees nothing else. Pieces are
ranked within their length by sums over buckets (a hot length is spread over
many tasks) and look their place up by rank.

Null texts are empty and have the end id only. A null identifier and repeated
rows are documents of their own. An empty table gives an empty result. Only
the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import Recent, hold, quoted, remembered, running_sum, whole_text

# Bytes that a Python worker remembers, twice, of words and of the parts that the tokenizer cuts them into; what does not recur makes room.
ROOMS = 80 << 20, 16 << 20
# Printable ASCII and the letters of Latin-1, in lower case.
LETTER, KNOWN = r"a-z\x{df}-\x{f6}\x{f8}-\x{ff}", r"\x20-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
# How that tokenizer cuts lowered Latin text (a fixed value; other texts it cuts itself): letters are what stays between these.
BESIDE = rf"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{LETTER}0-9\x09-\x0d\x20]+)"
PLAIN = rf"\A[{KNOWN}\x09-\x0d]*\z"
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[\x21-\x26\x28-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|'")
WORD_END, TOGETHER = "</w>", 512


def _word_ids(path: str, words_room: int, parts_room: int):
    """texts -> little-endian ids.

    The tokenizer never joins across ASCII white space, nor across the parts
    that it cuts a word into, and marks the last token of each part. So texts
    are cut and put together as Arrow columns, Python looks up each distinct
    part of a batch, and parts not seen before are encoded many at a time. Of
    a text with other letters than Latin ones, whole words are looked up.
    """
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for token, i in tokenizer.get_vocab().items() if token.endswith(WORD_END)]] = True
    # Parts are lowered, composed and cut already: all that is left is to merge.
    merger = Tokenizer.from_file(path)
    merger.normalizer = None
    merger.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def one_by_one(words):
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]

    def together(parts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(parts), TOGETHER):
            group = parts[at : at + TOGETHER]
            ids = np.array(merger.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(last[ids]) + 1) * 4
            if len(ends) != len(group):
                out += one_by_one(group)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[start:end])
                start = end
        return out

    def make(new: list[bytes]) -> list[bytes]:
        words = b" ".join(new).decode().split(" ") if new else []
        fits = [PART.fullmatch(w) is not None for w in words]
        parts = iter(together(list(compress(words, fits))))
        odd = iter(one_by_one([w for w, fit in zip(words, fits) if not fit]))
        return [next(parts if fit else odd) for fit in fits]

    known = Recent(make, words_room + parts_room)

    def encoded(texts: pa.Array) -> list[bytes]:
        # A text that begins or ends with white space has an empty word there.
        cut = pc.ascii_split_whitespace(texts)
        found = cut.values.dictionary_encode()
        all_words = pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary)
        distinct = pc.binary_join(all_words, pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes().split(b" ")
        coded = known.of({w for w in distinct if w})
        flat = pa.array([coded[w] if w else b"" for w in distinct], pa.large_binary()).take(found.indices)
        _, starts, raw = flat.buffers()
        ends = np.frombuffer(starts, np.int64, len(flat) + 1)[cut.offsets.to_numpy()].tolist()
        raw = memoryview(raw or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]

    def ids(texts) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring(texts, "<|"))
        parts = iter(encoded(pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), BESIDE, r" \1 ")))
        words = iter(encoded(texts.filter(pc.invert(plain))))
        return [next(parts if is_plain else words) for is_plain in plain.to_pylist()]

    return ids


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False, text: str = "text", id: str = "doc_id", rooms: tuple[int, int] = ROOMS
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces of each document."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids, end = remembered(("word ids", tokenizer, rooms), lambda: _word_ids(tokenizer, *rooms)), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = [x + end for x in ids(part.column("text"))]
                rows = [
                    (i, n, s // 4, min(capacity, (len(raw) - s) // 4), raw[s : s + 4 * capacity])
                    for i, raw in enumerate(coded)
                    for n, s in enumerate(range(0, len(raw), 4 * capacity))
                ]
                which, piece, start, length, raws = zip(*rows)
                columns = [
                    part.column("doc_id").take(pa.array(which)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(r) for r in raws], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raws], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    kind = T.StructType([
        T.StructField("doc_id", read.schema["doc_id"].dataType),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ])
    return read.mapInArrow(run, kind)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of the lengths at hand that fills ``room`` best."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach = (reach | reach << (part * length)) & mask
            left, part = left - part, part * 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            taken[length] = taken.get(length, 0) + part
            at -= part * length
    return sorted(taken.items(), reverse=True)


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times)]) until nothing is left."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        items = dict(fullest(rest, capacity - longest))
        items[longest] = items.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in items.items())
        for k, n in items.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        out.append((bins, sorted(items.items(), reverse=True)))
    return out


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, times in a sequence, offset there), in the order of ranks."""
    used, sequence, places = {}, 0, {}
    for bins, items in plan:
        offset = 0
        for length, times in items:
            places.setdefault(length, []).append((used.get(length, 0), sequence, times, offset))
            used[length] = used.get(length, 0) + times * bins
            offset += times * length
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in places.items()}


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset for the pieces (length, doc_id, piece, row, ...), which are held."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = cut.sparkSession.sparkContext.broadcast(_places(patterns(histogram, capacity)))
    ranked = running_sum(cut, "length", ["doc_id", "piece", "row"], F.lit(1), "rank").drop("row")
    names = [f.name for f in ranked.schema if f.name != "rank"]

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                at, rows = np.flatnonzero(length == x), places.value[x]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * x
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = T.StructType([*[ranked.schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, kind)


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, text: str = "text", id: str = "doc_id",
    rooms: tuple[int, int] = ROOMS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``rooms``: bytes that a Python worker remembers of words and of their parts; the ids do not depend on them.
    """
    row: Column = F.monotonically_increasing_id().alias("row")
    cut = hold(pieces(docs, tokenizer, capacity, end_id, with_ids, text, id, rooms).select("*", row), "pieces")
    return pack(cut, capacity)
