"""SentencePiece encoding and decoding for vocabularies of the merge type.

A normalised text starts as its characters. An agenda holds the adjacent pairs
that are pieces together, the best score first, ties from the left; the best
one whose two halves still stand is joined, and its new neighbours enter the
agenda, until none is left. What is no piece becomes its UTF-8 bytes.

No piece spans certain places (before a blank that follows another character,
around characters that are in no longer piece, around user-defined symbols),
so no merge does. The agenda therefore runs once per distinct stretch between
such places, and a Python worker remembers the stretches that recur.

Each Arrow batch is checked against the sentencepiece library: the stretches
that are new to the worker always (``check="stretches"``), or every text whole
and its decoded text too (``check="texts"``). ``agrees`` says per document
whether all of it is the same.

Null texts are empty: the begin and end ids only. A null identifier and
repeated rows stay as they are. Texts are encoded whole, however long. An
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import Recent, quoted, remembered, whole_text

BLANK, UNKNOWN_TEXT, SLICE = "▁", " ⁇ ", 256
# Bytes that a Python worker remembers of stretches, twice.
ROOM = 160 << 20
# Kinds of pieces and the merge type of models, as the public model format numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2

# A byte that is no part of a character becomes one replacement character, each on its own.
codecs.register_error("maskwright.byte", lambda e: ("�", e.start + 1))


def _fields(raw: bytes):
    """(number, value) of a message in the public wire format: integers, 32- and 64-bit values, bytes."""

    def integer(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(raw):
        tag, at = integer(at)
        kind = tag & 7
        if kind == 0:
            value, at = integer(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else integer(at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Merges:
    """The pieces of a model, its agenda, and its ids back to text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        parts = list(_fields(self.library.serialized_model_proto()))
        pieces = [{1: b"", 2: bytes(4), 3: NORMAL, **dict(_fields(v))} for k, v in parts if k == 1]
        trainer = dict(_fields(b"".join(v for k, v in parts if k == 2)))
        shaping = dict(_fields(b"".join(v for k, v in parts if k == 3)))
        if trainer.get(3, 1) != MERGES:
            raise ValueError("the vocabulary is not of the merge type")
        names, self.kinds = [p[1].decode() for p in pieces], [p[3] for p in pieces]
        self.bytes = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(names, self.kinds)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no bytes to fall back on")
        self.prefix, self.squeeze = bool(shaping.get(3, 1)), bool(shaping.get(4, 1))
        merged = (NORMAL, USER, UNUSED)
        self.id = {n: i for i, (n, k) in enumerate(zip(names, self.kinds)) if k in merged}
        self.packed = {n: struct.pack("<I", i) for n, i in self.id.items()}
        self.packed_bytes = {b: struct.pack("<I", i) for b, i in self.bytes.items()}
        # The agenda is a heap, so the best score comes as the smallest key.
        self.key = {n: -struct.unpack("<f", pieces[i][2])[0] for n, i in self.id.items()}
        self.unused = {n for n, i in self.id.items() if self.kinds[i] == UNUSED}
        user = sorted((n for n, i in self.id.items() if self.kinds[i] == USER), key=len, reverse=True)
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        longer = [n for n in self.id if len(n) > 1]
        joined = "".join(re.escape(c) for c in sorted({c for n in longer for c in n} - {BLANK}))
        inner = any(a != BLANK and b == BLANK for n in longer for a, b in zip(n, n[1:]))
        stretch = f"[{BLANK}{joined}]+" if inner or not joined else f"{BLANK}*[{joined}]+|{BLANK}+"
        self.stretch = re.compile(f"{stretch}|.", re.DOTALL)
        # The library without the blank that it puts first: what it makes of a stretch inside a text.
        # A later field of the wire format overrides: of the normaliser's settings (3), the prefix (3) and the squeezing (4) are off.
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=self.library.serialized_model_proto() + bytes([3 << 3 | 2, 4, 3 << 3, 0, 4 << 3, 0]))
        self.checks, self.differs = True, set()
        self.ids_of = Recent(self._checked, ROOM)
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        shown = {BYTE: lambda n: bytes([int(n[1:-1], 16)]), CONTROL: lambda n: b"", UNKNOWN: lambda n: UNKNOWN_TEXT.encode()}
        self.shown = [shown.get(k, lambda n: n.replace(BLANK, " ").encode())(n) for n, k in zip(names, self.kinds)]
        self.begins, self.ends = self.library.bos_id(), self.library.eos_id()

    def merge(self, text: str) -> list[str]:
        """The pieces of a stretch of normalised text."""
        n, key, push, pop = len(text), self.key.get, heapq.heappush, heapq.heappop
        if n == 1:
            return [text]
        parts, before, after = list(text), list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [text[i : i + 2] for i in range(n - 1)]
        agenda = [(k, i, i + 1, pair) for i, (pair, k) in enumerate(zip(pairs, map(key, pairs))) if k is not None]
        heapq.heapify(agenda)
        halves = {}
        while agenda:
            _, left, right, whole = pop(agenda)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != len(whole):
                continue
            if whole in self.unused:
                halves[whole] = (parts[left], parts[right])
            parts[left], parts[right] = whole, ""
            following, previous = after[right], before[left]
            after[left] = following
            if following < n:
                before[following] = left
                if (k := key(joint := whole + parts[following])) is not None:
                    push(agenda, (k, left, following, joint))
            if previous >= 0 and (k := key(joint := parts[previous] + whole)) is not None:
                push(agenda, (k, previous, left, joint))
        found = [p for p in parts if p]

        def whole_or_halves(part):
            return [x for half in halves[part] for x in whole_or_halves(half)] if part in halves else [part]

        return [x for p in found for x in whole_or_halves(p)] if halves else found

    def _ids(self, stretch: str) -> bytes:
        pieces = [stretch] if self.user and self.user.fullmatch(stretch) else self.merge(stretch)
        packed = self.packed
        return b"".join([packed[p] if p in packed else b"".join([self.packed_bytes[b] for b in p.encode()]) for p in pieces])

    def by_library(self, stretches: list[str]) -> list[bytes]:
        asked = self.bare.encode([x.replace(BLANK, " ") for x in stretches], num_threads=1)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in asked]

    def _checked(self, stretches: list[str]) -> list[bytes]:
        found = [self._ids(x) for x in stretches]
        if self.checks:
            self.differs.update(x for x, own, other in zip(stretches, found, self.by_library(stretches)) if own != other)
        return found

    def _stretches(self, text: str) -> list[str]:
        if self.user is None:
            return self.stretch.findall(text)
        cut = self.user.split(text)
        return [x for at, part in enumerate(cut) for x in ([part] if at % 2 else self.stretch.findall(part))]

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit integers."""
        return self.encoded(self.cut(texts), begin, end)

    def cut(self, texts: list[str]) -> list[list[str]]:
        return [self._stretches(t) for t in self.library.normalize(texts)]

    def encoded(self, cut: list[list[str]], begin: bool = True, end: bool = True) -> list[bytes]:
        known = self.ids_of.of(set().union(*cut))
        first, last = (struct.pack("<I", i) if wanted else b"" for i, wanted in ((self.begins, begin), (self.ends, end)))
        return [first + b"".join(map(known.__getitem__, found)) + last for found in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding puts first goes."""
        inside = [n for n, i in enumerate(ids) if self.kinds[i] == CONTROL and 0 < n < len(ids) - 1] if self.controls.intersection(ids) else []
        # Bytes on both sides of a control id are no character together.
        runs = [ids[a:b] for a, b in zip([0, *inside], [*inside, len(ids)])]
        raws, starts = [b"".join(map(self.shown.__getitem__, run)) for run in runs], self.prefix or self.squeeze
        for i in ids:
            if not starts or self.kinds[i] in (BYTE, UNKNOWN):
                break
            if self.kinds[i] == CONTROL:
                continue
            if not self.shown[i].startswith(b" "):
                break
            at = next(n for n, raw in enumerate(raws) if raw)
            raws[at] = raws[at][1:]
            # Where blanks are squeezed, all at the start go, one piece after the other.
            if not self.squeeze or self.shown[i] != b" ":
                break
        return "".join([raw.decode("utf-8", "maskwright.byte") for raw in raws])


def _model(path: str) -> Merges:
    return remembered(("piece merges", path), lambda: Merges(path))


def encode(
    docs: DataFrame, model: str, begin: bool = True, end: bool = True, packed: bool = False, decoded: bool = False, check: str | None = "stretches",
    text: str = "text", id: str = "doc_id",
) -> DataFrame:
    """doc_id, ids (and decoded, agrees): one row per document.

    ``ids`` is an array of integers, or with ``packed`` their little-endian 32
    bits in a row; ``decoded`` adds the text that they stand for; ``check``
    ("stretches", "texts" or None) adds whether the library gives the same.
    """
    if check not in (None, "stretches", "texts"):
        raise ValueError('check is "stretches", "texts" or None')

    def run(batches):
        merges = _model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column("text").to_pylist()
                cut = merges.cut(texts)
                raws = merges.encoded(cut, begin, end)
                lists = [np.frombuffer(r, "<u4").tolist() for r in raws] if decoded or check == "texts" or not packed else None
                columns = [part.column("doc_id"), pa.array(raws, pa.binary()) if packed else pa.array(lists, pa.list_(pa.int32()))]
                agrees = [not merges.differs or merges.differs.isdisjoint(found) for found in cut]
                if check == "texts":
                    asked = merges.library.encode(texts, add_bos=begin, add_eos=end, num_threads=1)
                    agrees = [a and b == c for a, b, c in zip(agrees, lists, asked)]
                if decoded:
                    shown = [merges.decode(x) for x in lists]
                    columns.append(pa.array(shown, pa.string()))
                    if check == "texts":
                        agrees = [a and b == c for a, b, c in zip(agrees, shown, merges.library.decode(lists, num_threads=1))]
                if check:
                    columns.append(pa.array(agrees, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))
    kind = T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])
    if decoded:
        kind.add("decoded", T.StringType())
    if check:
        kind.add("agrees", T.BooleanType())
    names = kind.names
    return read.mapInArrow(run, kind)


def decode(coded: DataFrame, model: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """doc_id, decoded: the text of each row's array of ids. Null ids are none, and give an empty text; so does a null among them."""

    def run(batches):
        merges = _model(model)
        for batch in batches:
            texts = [merges.decode([i for i in x or [] if i is not None]) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    read = coded.select(F.col(quoted(id)).alias("doc_id"), F.col(quoted(ids)).cast("array<int>").alias("ids"))
    return read.mapInArrow(run, T.StructType([T.StructField("doc_id", read.schema["doc_id"].dataType), T.StructField("decoded", T.StringType())]))
