"""A quality score from supervised subword embeddings.

Words, pairs of neighbouring words and the character 3- and 4-grams within
words are hashed to rows of a table of learned vectors; a word that repeats
the one before makes the same pair whatever the word. A document is the mean
of its rows, drawn towards zero by ``PRIOR`` absent ones, so that a few words
decide little; a linear layer and a softmax over the labels follow. Trained
by stochastic gradient descent in numpy.

The fit reads a bounded sample: of each label the ``sample`` documents whose
identifiers have the smallest hashes, among those labelled and not held out.
Everything else covers all documents and whole texts. As the layer is linear,
a trained model is one number per hash bucket and a bias (1 MB at 2^18
buckets, whatever the data), which is what the tasks get.

Null texts are empty, and an empty text has the score of the bias. A null
identifier is never held out nor learned from. Labels with null, and labels
without a document, are left out; with one label or none at all, the score is
that label's share (0.5 without any). Repeated rows are scored alike. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import as_doc, quoted, whole_text

BITS = 18
GRAMS = (3, 4)
PRIOR = 30
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, 1 << 12), _powers(INVERSE, 1 << 12)


def _hashes(text: bytes) -> np.ndarray:
    """Bucket of every word and gram of a text in one go. Words of up to 4096 bytes are hashed whole, longer ones by their grams."""
    raw = b" " + b" ".join(text.split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    space = b == 33
    out = []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            if len(b) < n + 1:
                continue
            h = np.zeros(len(b) - n + 1, np.uint64)
            inner = np.zeros(len(h), bool)
            for k in range(n):
                h = h * np.uint64(BASE) + b[k : k + len(h)]
                if 0 < k < n - 1:
                    inner |= space[k : k + len(h)]
            out.append((h[~inner] + np.uint64(n)) * np.uint64(MIX))
        # A word's hash is the difference of two running sums, brought to the same power.
        gaps = np.flatnonzero(space)
        starts, ends = gaps[:-1] + 1, gaps[1:]
        short = (ends > starts) & (ends - starts < len(UP))
        starts, ends = starts[short], ends[short]
        at = np.arange(len(b)) % len(UP)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * UP[at], dtype=np.uint64)))
        # Positions wrap at the length of the table of powers; a word that crosses the wrap is hashed by itself.
        whole = starts // len(UP) == (ends - 1) // len(UP)
        words = np.empty(len(starts), np.uint64)
        words[whole] = (sums[ends[whole]] - sums[starts[whole]]) * DOWN[starts[whole] % len(UP)]
        words[~whole] = [np.sum(b[s:e] * UP[: e - s], dtype=np.uint64) for s, e in zip(starts[~whole], ends[~whole])]
        out.append((words + np.uint64(1)) * np.uint64(MIX))
        pairs = (words[:-1] ^ (words[1:] * np.uint64(MIX))) * np.uint64(BASE)
        pairs[words[:-1] == words[1:]] = np.uint64(MIX)
        out.append((pairs ^ (pairs >> np.uint64(29))) * np.uint64(MIX))
    return np.concatenate(out) >> np.uint64(64 - BITS)


def features(text: str | None):
    """The buckets of a text, in chunks cut at white space, so that memory does not grow with the text."""
    raw, at = (text or "").encode(), 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK)
        if end < len(raw) and (cut := max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))) > at:
            end = cut
        got = _hashes(raw[at:end])
        if len(got):
            yield got
        at = end


def _profile(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their shares) of a text."""
    counts = np.zeros(1 << BITS)
    for got in features(text):
        counts += np.bincount(got.astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), (counts[at] / (counts.sum() + PRIOR)).astype(np.float32)


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], shares: tuple[float, float], dim: int = 16, epochs: int = 12, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) from (buckets, shares, label); ``shares`` are those of the labels among all labelled rows."""
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            at, share, label = examples[i]
            mean = share @ table[at]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            step = rate * (1 - done / steps)
            back = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            # Shares are small: as in the mean of single n-grams, a bucket moves with its share, and rows of long texts no less than of short ones.
            table[at] -= step * np.outer(share * min(len(at), 64), back)
            done += 1
    learned = [sum(e[2] == y for e in examples) / len(examples) for y in (0, 1)]
    prior = math.log(shares[1] / shares[0]) - math.log(learned[1] / learned[0])
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0] + prior)


def held_out(id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the identifier as text leaves the remainder; a null identifier is not held out."""
    crc = F.crc32(F.col(quoted(id)).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 1500, text: str = "text", id: str = "doc_id", label: str = "quality") -> tuple[np.ndarray, float]:
    """The model from the labels (id, label) that ``learn`` admits; ``sample`` is the bound on the documents of each label."""
    marked = labels.where(learn).select(F.col(quoted(id)).alias("doc_id"), F.col(quoted(label)).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    shares = tuple((counts.get(y, 0) + 1) / (sum(counts.values()) + 2) for y in (0, 1))
    chosen = [marked.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = chosen[0].union(chosen[1]).dropDuplicates(["doc_id"])
    read = docs.select(F.col(quoted(id)).alias("doc_id"), whole_text(text).alias("text"))

    def run(batches):
        for batch in batches:
            got = [_profile(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "share"],
            )

    kind = T.StructType([read.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))])
    # At most 2 * sample rows of two numbers: bounded, so it may go to every task. Of repeated rows one is enough.
    texts = read.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    # The bounded sample is learnt from in one task; the driver sees the model alone.
    def learn_all(batches):
        parts = list(batches)
        if not parts:
            return
        got = pa.Table.from_batches(parts).sort_by([("doc_id", "ascending")]).combine_chunks()
        examples = [(a.values.to_numpy(), s.values.to_numpy(), y.as_py()) for a, s, y in zip(got["at"], got["share"], got["label"])]
        if len({e[2] for e in examples}) == 2:
            weight, bias = fit(examples, shares)
            yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([bias])], ["weight", "bias"])

    profiles = texts.select("doc_id", "label", "text").mapInArrow(run, kind)
    found = profiles.repartition(1).mapInArrow(learn_all, "weight binary, bias double").collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), math.log(shares[1] / shares[0])
    return np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", extra: list[Column] = ()) -> DataFrame:
    """The extra columns and the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weight, bias = sent.value
        for batch in batches:
            out = []
            for t in batch.column("_text"):
                total, n = 0.0, 0
                for got in features(t.as_py()):
                    total, n = total + float(weight[got].sum(dtype=np.float64)), n + len(got)
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, total / (n + PRIOR) + bias)))))
            keep = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(out, pa.float64())], [*keep, "score"])

    read = docs.select(*extra, whole_text(text).alias("_text"))
    return read.mapInArrow(run, T.StructType([*[f for f in read.schema if f.name != "_text"], T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float) -> DataFrame:
    """The documents that score ``threshold`` or more, with the columns they came with."""
    model = train(docs, labels, learn)
    return score(docs, model, extra=[as_doc(docs)]).where(F.col("score") >= threshold).select("doc.*")
