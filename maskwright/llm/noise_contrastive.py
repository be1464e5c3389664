"""Scoring texts with a log-bilinear model learned by noise-contrastive estimation.

Words are A-Z lowered; a text is its words and one end. The most frequent
words have a class of their own, all others share one of eight by their shape
(last character, ASCII or not). The context of a word are the classes of the
two before it: their vectors, each through a matrix, add up to the vector
that is multiplied with the one of each class. Trained in numpy against noise
from the class frequencies; afterwards matrix products over all contexts give
normalised log-probabilities of the classes. Within a class of many words,

    P(word | class, two words before) = (times + strength * share) / (times of the class + strength)

where the times are those after these very two words, whatever they are, and
share = (count + 1) / (counts of the class + 1 each + 1), that of the word in its class: what the
class does where the two words were never met. That makes the product a distribution
over the words of the corpus and one unknown word per shape.

What is learned covers every training row: word counts, counts of class
triples and counts of word triples are aggregates over all of them, and each
step of the training goes through all class triples, by their counts, against
the exact expectation of the noise. The number of classes is fixed, so the
class triples are at most CLASSES ** 3 = 4,096,000 numbers, which is what the
driver trains on, whatever the corpus. Word triples grow with the corpus.

Tasks look the HEAD most frequent words up (bounded, by count); the others,
about one word in twelve, meet their counts in a join. Word triples meet by a
hash of the two words and the shape, as packed numbers of about BUCKET words
a task; sums per document leave it, and the words that are still to meet their
counts. Two words that both have a class may come before a large part of the
corpus: the class triples have their counts, so these are dealt by the third
word as well. Nothing that grows is broadcast.
Words and contexts are known by hashes of 64 and at least 48 bits.

Null texts are empty: an end alone. A null identifier is never held out and
its row is learned from. Repeated rows count as often as they are there.
Without any training row every probability is 1 (score 0). An empty table
gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import hold, quoted, whole_text

CLASSES, SHAPES, HEAD = 160, 8, 200_000
END = b"\n"  # no word holds white space
FLUSH = 400_000
# Words of the corpus for each bucket of triples; triples that are packed at once; bytes of text that are cut at once.
BUCKET, PACK, PIECE = 1 << 20, 1 << 19, 2 << 20
# Documents of a packed part: their places, and whether they are learned from, take two bytes.
PLACES = 1 << 15
STRENGTH = 64.0
# The kind of a packed part, by bits: dealt by the third word too, whose third words are none of the HEAD; DOC: a document.
DEALT, RARE, DOC = 1, 2, 4


def _pieces(batches):
    """The rows of the batches in slices of about PIECE bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            room = PIECE + (ends[at - 1] if at else 0)
            to = min(max(at + 1, int(np.searchsorted(ends, room, "right"))), at + PLACES)
            yield batch.slice(at, to - at)
            at = to


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, codes, starts): the texts one after the other, each its words and an end, as positions in the distinct words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    # White space at either end of a text makes empty words.
    words, codes = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
    real = pc.binary_length(words).to_numpy() > 0
    words, to, real = words.filter(pa.array(real)), np.cumsum(real) - 1, real[codes]
    ends = np.concatenate(([0], np.cumsum(real)))[lists.offsets.to_numpy()]
    codes = np.insert(to[codes[real]], ends[1:], len(words))
    return pa.concat_arrays([words, pa.array([END], pa.binary())]), codes, ends[:-1] + np.arange(len(texts))


def shape_of(word: bytes) -> int:
    last = word[-1]
    kind = 0 if last == 46 else 1 if last == 44 else 2 if 97 <= last <= 122 or last >= 128 else 3
    return kind + 4 * (not word.isascii())


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, shape, n) over all rows; each task adds up its own first."""

    def run(batches):
        def added(parts):
            return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        def counted(table):
            words = table["word"].combine_chunks()
            return _batch(word=words, shape=pa.array(map(shape_of, words.to_pylist()), pa.int32()), n=table["n"].combine_chunks())

        parts, size = [], 0
        for piece in _pieces(batches):
            words, codes, _ = words_of(piece.column("text"))
            parts.append(pa.table({"word": words, "n": np.bincount(codes)}))
            size += len(words)
            if size > 2 * FLUSH:
                parts = [added(parts)]
                size = parts[0].num_rows
                if size > FLUSH:
                    yield counted(parts[0])
                    parts, size = [], 0
        if parts:
            yield counted(added(parts))

    return texts.select("text").mapInArrow(run, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most frequent words with their counts and classes: bounded, and the same for every task."""

    def __init__(self, words: list[bytes], counts: list[int], top: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.words = [words[i] for i in order]
        counts = np.array([counts[i] for i in order], np.int64)
        # The end is always a class: a context reaches back over it.
        if END in self.words[top:]:
            at = self.words.index(END)
            self.words.insert(0, self.words.pop(at))
            counts = np.concatenate((counts[at : at + 1], np.delete(counts, at)))
        self.logs = np.log10(counts + 1.0)
        self.own = min(top, len(self.words))
        # One more at the end, for words that are not here (-1).
        self.classes = np.array([*(SHAPES + i if i < self.own else shape_of(w) for i, w in enumerate(self.words)), 0], np.int64)
        self.own_counts = counts[: self.own]

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def end_class(self) -> int:
        return int(self.classes[self.words.index(END)]) if END in self.words else 0


def _classes_of(words: list[bytes], index: dict[bytes, int], lexicon: Lexicon):
    """(position in the lexicon or -1, class) of each word."""
    at = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
    classes = lexicon.classes[at]
    missing = np.flatnonzero(at < 0)
    classes[missing] = [shape_of(words[i]) for i in missing.tolist()]
    return at, classes


def _before(values: np.ndarray, starts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values two places and one place before each; ``end`` where a text begins."""
    older, newer = np.empty_like(values), np.empty_like(values)
    older[2:], newer[1:] = values[:-2], values[:-1]
    older[starts] = newer[starts] = end
    second = starts[np.diff(starts, append=len(values)) > 1] + 1
    older[second] = end
    return older, newer


def _cells(classes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    older, newer = _before(classes, starts, end)
    return (older * CLASSES + newer) * CLASSES + classes


def triple_counts(texts: DataFrame, lexicon) -> DataFrame:
    """(cell, n): how often each class follows each pair of classes, over all rows."""

    def run(batches):
        known = lexicon.value
        index, end = known.index(), known.end_class()
        total = np.zeros(CLASSES**3, np.int64)
        held, size = [], 0
        for piece in _pieces(batches):
            words, codes, starts = words_of(piece.column("text"))
            held.append(_cells(_classes_of(words.to_pylist(), index, known)[1][codes], starts, end))
            size += len(codes)
            if size > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        cells = np.flatnonzero(total)
        for at in range(0, len(cells), 1 << 16):
            part = cells[at : at + (1 << 16)]
            yield _batch(cell=pa.array(part.astype(np.int32)), n=pa.array(total[part]))

    return texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def train(cells: np.ndarray, counts: np.ndarray, dim: int = 24, steps: int = 300, noise: int = 64, rate: float = 0.04) -> dict[str, np.ndarray]:
    """Vectors, matrices and biases by noise-contrastive estimation: Adam steps, each over all triples by their counts.

    The noise is not drawn: each class takes part in each context with what is expected of it.
    """
    rng = np.random.default_rng(11)
    pairs, row = np.unique(cells // CLASSES, return_inverse=True)
    older, newer = pairs // CLASSES, pairs % CLASSES
    seen = np.zeros((len(pairs), CLASSES), np.float32)
    seen[row, cells % CLASSES] = counts / counts.sum()
    often = np.bincount(cells % CLASSES, counts, CLASSES)
    unused = np.flatnonzero(often[SHAPES:] == 0) + SHAPES
    often = (often + 1.0) / (often + 1.0).sum()
    log_noise = np.log(noise * often).astype(np.float32)
    both = seen + (noise * seen.sum(1, keepdims=True) * often).astype(np.float32)
    near = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    model = {
        "context": near(CLASSES, dim),
        "target": near(CLASSES, dim),
        "older": np.eye(dim, dtype=np.float32) * 0.5,
        "newer": np.eye(dim, dtype=np.float32),
        "bias": np.log(often).astype(np.float32),
    }
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    # Sums by class as products with one-hot matrices.
    at_older, at_newer = (np.zeros((CLASSES, len(pairs)), np.float32) for _ in range(2))
    at_older[older, np.arange(len(pairs))] = at_newer[newer, np.arange(len(pairs))] = 1
    for step in range(1, steps + 1):
        va, vb = model["context"][older], model["context"][newer]
        h = va @ model["older"] + vb @ model["newer"]
        x = h @ model["target"].T + (model["bias"] - log_noise)
        up = seen - both / (1 + np.exp(-np.clip(x, -30, 30, out=x), out=x))
        dh = up @ model["target"]
        grads = {
            "target": up.T @ h,
            "bias": up.sum(0),
            "context": at_older @ (dh @ model["older"].T) + at_newer @ (dh @ model["newer"].T),
            "older": va.T @ dh,
            "newer": vb.T @ dh,
        }
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1))) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            model[k] += pace * first[k] / (np.sqrt(second[k]) + 1e-12)
    # A class that no word has gets nothing.
    model["target"][unused], model["bias"][unused] = 0, -1e4
    return model


def normalised(model: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(class | older, newer) at [older * CLASSES + newer, class]: one matrix product for each older class."""
    a, b = model["context"] @ model["older"], model["context"] @ model["newer"]
    out = np.empty((CLASSES * CLASSES, CLASSES), np.float32)
    for i in range(CLASSES):
        z = (a[i] + b) @ model["target"].T + model["bias"]
        z -= z.max(1, keepdims=True)
        out[i * CLASSES : (i + 1) * CLASSES] = (z - np.log(np.exp(z).sum(1, keepdims=True))) / math.log(10)
    return out


def fit(texts: DataFrame, head: int = HEAD):
    """(counts, lexicon, model, log10 of the mass of each shape, all tokens, distinct tokens) from all rows of texts."""
    counts = hold(word_counts(texts), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The lowest count at which no more than `head` words are taken, from a histogram on a log scale.
    level = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    least, taken = None, 0
    for s in steps:
        if taken + s["words"] > head:
            break
        taken, least = taken + s["words"], s["least"]
    frequent = counts.where((F.col("word") == F.lit(END)) | (F.col("n") >= (least if least is not None else 1 << 62)))
    frequent = frequent.select("word", "n").toArrow()
    lexicon = Lexicon(frequent["word"].to_pylist(), frequent["n"].to_pylist(), CLASSES - SHAPES)
    sent = texts.sparkSession.sparkContext.broadcast(lexicon)
    triples = triple_counts(texts, sent).toArrow().sort_by("cell")
    model = None
    if triples.num_rows:
        cells, n = triples["cell"].to_numpy().astype(np.int64), triples["n"].to_numpy()
        model = train(cells, n.astype(np.float64))
        # How often each shape follows each pair of classes.
        model["after"] = np.zeros((CLASSES * CLASSES, SHAPES), np.int64)
        shaped = cells % CLASSES < SHAPES
        model["after"][cells[shaped] // CLASSES, cells[shaped] % CLASSES] = n[shaped]
    # Of each shape: tokens and words without a class of their own, and one unknown word.
    own = lexicon.words[: lexicon.own]
    mass = np.ones(SHAPES)
    for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r["shape"]] += r["n"] + r["words"]
    for w, n in zip(own, lexicon.own_counts.tolist()):
        mass[shape_of(w)] -= n + 1
    return counts, sent, model, np.log10(mass), tokens, distinct


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _packed(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _unpacked(parts: list[bytes], width: int) -> np.ndarray:
    out = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width)
    return np.pad(out, ((0, 0), (0, 8 - width))).view("<u8").ravel()


# Bytes of a context, of a word of the lexicon, of the hash of any other, and of a place.
KEY, KNOWN, HASH, PLACE = 6, 3, 8, 2


def _triples_of(bits: int):
    """Packs (contexts, words, places, kinds) of some documents into rows (bucket, kind, key, word, place)."""

    def rows(key, word, place, kind):
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
        group = kind * (1 << bits) + bucket
        order = np.argsort(group, kind="stable")
        found, starts = np.unique(group[order], return_index=True)
        for g, part in zip(found.tolist(), np.split(order, starts[1:])):
            k = g >> bits
            yield g & ((1 << bits) - 1), k, _packed(key[part], KEY).tobytes(), _packed(word[part], HASH if k & RARE else KNOWN).tobytes(), _packed(place[part], PLACE).tobytes()

    return rows


def _counted(sent, shape_mass: np.ndarray, strength: float):
    """Of a bucket: its documents as they are, what its triples add to each document, and its words that are not in the lexicon."""

    def run(part):
        kinds, lexicon = part["kind"].to_numpy(), sent.value
        docs = part.filter(pa.array(kinds == DOC))
        got = {k: [] for k in ("key", "word", "row", "learned", "dealt", "rare")}
        for kind in (0, DEALT, RARE, DEALT | RARE):
            some = part.filter(pa.array(kinds == kind))
            if not some.num_rows:
                continue
            place = some["place"].to_pylist()
            base = np.repeat(some["row"].to_numpy(), [len(x) // PLACE for x in place])
            place = _unpacked(place, PLACE).astype(np.int64)
            got["key"].append(_unpacked(some["key"].to_pylist(), KEY))
            got["word"].append(_unpacked(some["word"].to_pylist(), HASH if kind & RARE else KNOWN))
            got["row"].append(base + (place >> 1))
            got["learned"].append(place & 1)
            got["dealt"].append(np.full(len(place), kind & DEALT > 0))
            got["rare"].append(np.full(len(place), kind & RARE > 0))
        none = lambda n, kind: pa.nulls(n, kind)
        out = [_named(docs, none(docs.num_rows, pa.float64()), none(docs.num_rows, pa.int64()), none(docs.num_rows, pa.int64()))]
        if got["key"]:
            key, word, row, learned, dealt, rare = (np.concatenate(x) for x in got.values())
            _, of = np.unique(key, return_inverse=True)
            context = np.bincount(of, learned)[of]
            _, of = np.unique(_mixed(_mixed(key * np.uint64(4) + dealt * np.uint64(2) + rare) + word), return_inverse=True)
            times = np.bincount(of, learned)[of]
            # How often the class comes after two words that have one was known before.
            added = np.where(dealt, 0.0, -np.log10(1 + context / strength))
            known = word[~rare].astype(np.int64)
            added[~rare] += np.log10(1 + times[~rare] / strength * 10 ** (shape_mass[lexicon.classes[known]] - lexicon.logs[known]))
            rows, of = np.unique(row, return_inverse=True)
            out.append(_named(docs.slice(0, 0), pa.array(np.bincount(of, added)), none(len(rows), pa.int64()), none(len(rows), pa.int64()), rows))
            some = np.flatnonzero(rare)
            out.append(_named(docs.slice(0, 0), none(len(some), pa.float64()), pa.array(word[some].view(np.int64)), pa.array(times[some].astype(np.int64)), row[some]))
        return pa.concat_tables(out)

    def _named(docs, added, word, times, rows=None):
        n = len(added)
        columns = {k: docs[k] if rows is None else pa.nulls(n, docs.schema.field(k).type) for k in DOCUMENT}
        return pa.table({"row": docs["row"] if rows is None else pa.array(rows, pa.int64()), **columns, "added": added, "word": word, "times": times})

    return run


DOCUMENT = ["doc_id", "held_out", "n_tokens", "n_head", "base", "inner"]


def score_texts(
    docs: DataFrame, held_out: Column, text: str = "text", id: str = "doc_id", head: int = HEAD, strength: float = STRENGTH, bucket: int = BUCKET
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The rows with ``held_out`` are scored but not learned from.
    """
    read = docs.select(F.col(quoted(id)).alias("doc_id"), held_out.alias("held_out"), whole_text(text).alias("text"))
    counts, sent, model, shape_mass, tokens, distinct = fit(read.where(~F.col("held_out")), head)
    nothing = math.log10(tokens + distinct + 1)
    # As many buckets as the corpus needs, a power of two: the first bits of a context.
    bits = max(0, math.ceil(math.log2(max(1, tokens) / bucket)))
    buckets = 1 << bits

    def run(batches):
        from pyspark import TaskContext

        lexicon, pack = sent.value, _triples_of(bits)
        index, end = lexicon.index(), lexicon.end_class()
        table = normalised(model).ravel() if model is not None else None
        logs = np.append(lexicon.logs, 0.0)  # the last for words that are not here (-1)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in lexicon.words], np.uint64)
        row = TaskContext.get().partitionId() << 33
        held, n_docs, size = [], 0, 0
        for piece in _pieces(batches):
            if held and (n_docs + piece.num_rows > PLACES or size > PACK):
                yield from flushed(held, row, pack)
                row, held, n_docs, size = row + n_docs, [], 0, 0
            held.append(scored(piece, n_docs, lexicon, index, end, table, logs, hashes))
            n_docs, size = n_docs + piece.num_rows, size + len(held[-1][1][0])
        if held:
            yield from flushed(held, row, pack)

    def scored(piece, first, lexicon, index, end, table, logs, hashes):
        """(columns of the documents, (contexts, words, places, kinds) of their words that share a class)."""
        words, codes, starts = words_of(piece.column("text"))
        words = words.to_pylist()
        at, classes = _classes_of(words, index, lexicon)
        sizes = np.diff(starts, append=len(codes))
        summed = lambda x: np.add.reduceat(x[codes], starts)
        base = summed(logs[at]) - nothing * sizes
        inner, triples = np.zeros(len(starts)), [np.empty(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64)]
        if table is not None:
            shared = classes < SHAPES
            within = np.where(shared, logs[at] - shape_mass[np.minimum(classes, SHAPES - 1)], 0.0)
            cells = _cells(classes[codes], starts, end)
            learned = np.array([x is False for x in piece.column("held_out").to_pylist()])
            # Hashes of words; of the lexicon's they are at hand.
            of = np.zeros(len(words), np.uint64)
            of[at >= 0] = hashes[at[at >= 0]]
            of[at < 0] = [xxhash.xxh64_intdigest(words[i], 42) for i in np.flatnonzero(at < 0).tolist()]
            older, newer = _before(of[codes], starts, of[-1])
            to = np.flatnonzero(shared[codes])
            pair, shape = np.divmod(cells[to], CLASSES)
            key = _mixed(_mixed(_mixed(older[to]) + newer[to]) + shape.astype(np.uint64))
            # Two words with a class each: how often the class follows is known, and the word is dealt by too.
            dealt = (pair // CLASSES >= SHAPES) & (pair % CLASSES >= SHAPES)
            key[dealt] = _mixed(key[dealt] + of[codes[to[dealt]]])
            value = table[cells].astype(np.float64) + within[codes]
            value[to[dealt]] -= np.log10(1 + model["after"][pair[dealt], shape[dealt]] / strength)
            inner = np.add.reduceat(value, starts)
            place = np.repeat((first + np.arange(len(starts))) * 2 + learned, sizes)[to]
            rare = at[codes[to]] < 0
            word = np.where(rare, of[codes[to]], at[codes[to]].astype(np.uint64))
            triples = key, word, place, dealt * DEALT + rare * RARE
        columns = {
            "doc_id": piece.column("doc_id"),
            "held_out": piece.column("held_out"),
            "n_tokens": pa.array(sizes, pa.int64()),
            "n_head": pa.array(summed((at >= 0).astype(np.int64)), pa.int64()),
            "base": pa.array(base, pa.float64()),
            "inner": pa.array(inner, pa.float64()),
        }
        return columns, triples

    def flushed(held, row, pack):
        """The documents and the triples of the pieces, as rows of a bucket."""
        columns = {k: pa.concat_arrays([x[0][k] for x in held]) for k in DOCUMENT}
        n = len(columns["doc_id"])
        rows = row + np.arange(n)
        some = {"bucket": pa.array(rows % buckets, pa.int32()), "kind": pa.array(np.full(n, DOC), pa.int32()), "row": pa.array(rows, pa.int64())}
        yield _batch(**some, **columns, **{k: pa.nulls(n, pa.binary()) for k in ("key", "word", "place")})
        packed = list(pack(*(np.concatenate([x[1][i] for x in held]) for i in range(4))))
        if packed:
            bucket, kind, key, word, place = zip(*packed)
            n = len(packed)
            some = {"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()), "row": pa.array([row] * n, pa.int64())}
            some |= {k: pa.nulls(n, x.type) for k, x in columns.items()}
            yield _batch(**some, **{k: pa.array(x, pa.binary()) for k, x in (("key", key), ("word", word), ("place", place))})

    ddl = T.StructType.fromDDL
    document = [T.StructField("doc_id", read.schema["doc_id"].dataType), *ddl("held_out boolean, n_tokens long, n_head long, base double, inner double")]
    parts = read.mapInArrow(run, T.StructType([*ddl("bucket int, kind int, row long"), *document, *ddl("key binary, word binary, place binary")]))
    summed_up = T.StructType([*ddl("row long"), *document, *ddl("added double, word long, times long")])
    found = hold(parts.groupBy("bucket").applyInArrow(_counted(sent, shape_mass, strength), summed_up), "scores")
    # The words that are not in the lexicon meet their counts.
    shares = F.array(*[F.lit(float(strength / 10**x)) for x in shape_mass])
    n = F.col("n") + 1.0
    tail = found.where("word is not null").join(counts.select(F.xxhash64("word").alias("word"), "shape", "n"), "word")
    tail = tail.select("row", F.lit(1).alias("known"), F.log10(n).alias("logs"), F.log10(1 + F.col("times") / (F.get(shares, "shape") * n)).alias("added"))
    more = found.where("added is not null").select("row", F.lit(0).alias("known"), F.lit(0.0).alias("logs"), "added").union(tail)
    more = more.groupBy("row").agg(F.sum("known").alias("known"), F.sum("logs").alias("logs"), F.sum("added").alias("added"))
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return found.where("n_tokens is not null").drop("added", "word", "times").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs")).alias("base_score"),
        (F.col("inner") + zero("logs") + zero("added")).alias("score"),
    )
