"""Vectors as short codes: product quantisation with Lloyd rounds that look only where something changed.

A component x becomes the integer floor(scale * x). A vector is cut into equal
parts; each part position has a codebook, at first that part of the vectors
with the smallest identifiers. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and replaces each entry
by the floor of the mean of its parts; an unused entry stays.

Each part keeps its entry and the exact distance to it from round to round. If
that entry stayed as it was, no other fixed entry can have become nearer, so
the part is compared with the entries that moved only. Parts whose entry moved
are compared with all. All of it is integer arithmetic, exact.

The state of a round is a table in the shared folder. Entries are renewed from
sums per task, added up by Spark: the driver sees entries x length numbers.

Vectors that are null or hold null or non-finite components are dropped. The
length is that of the kept vector with the smallest identifier among the
non-empty ones; a vector of another length, or with a component whose integer
is so large that distances could leave 63 bits, stays without code and error
(null). Null identifiers come last among the first entries, equal ones in the
order of their vectors. Repeated rows count each. An empty table gives an
empty result. Other columns are carried only if named.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import hold, quoted

STATE = "vec binary, code binary, apart binary"
# Distances of so many numbers are worked out at a time.
CELLS = 1 << 20


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row, the first of equally near ones."""
    index, apart = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    step, width = max(1, CELLS // max(1, entries.size)), x.shape[1]
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    # Products of integers below 2^53 are exact as doubles.
    exact = width * (2 * largest) ** 2 < 1 << 53
    own = entries.astype(np.float64).T
    for at in range(0, len(x), step):
        part = x[at : at + step]
        if exact:
            y = part.astype(np.float64)
            d = (y * y).sum(1)[:, None] - 2 * (y @ own) + (own * own).sum(0)
        else:
            d = ((part[:, None, :] - entries[None]) ** 2).sum(2)
        best = d.argmin(1)
        index[at : at + step], apart[at : at + step] = best, d[np.arange(len(part)), best]
    return index, apart


def assign(x: np.ndarray, books: np.ndarray, code: np.ndarray | None = None, apart: np.ndarray | None = None, moved: np.ndarray | None = None):
    """(code, squared distances) of parts x (rows, positions, width) by books (positions, entries, width).

    With the code and distances by the books before, and which entries moved
    since, only what can have changed is compared.
    """
    n, positions, _ = x.shape
    if code is None:
        code, apart, moved = np.zeros((n, positions), np.int64), np.zeros((n, positions), np.int64), np.ones(books.shape[:2], bool)
    else:
        code, apart = code.copy(), apart.copy()
    for p in range(positions):
        active = np.flatnonzero(moved[p])
        if not len(active):
            continue
        again = moved[p][code[:, p]]
        rows = np.flatnonzero(again)
        if len(rows):
            code[rows, p], apart[rows, p] = _nearest(x[rows, p], books[p])
        rows = np.flatnonzero(~again)
        if len(rows):
            index, d = _nearest(x[rows, p], books[p][active])
            index = active[index]
            nearer = (d < apart[rows, p]) | ((d == apart[rows, p]) & (index < code[rows, p]))
            code[rows[nearer], p], apart[rows[nearer], p] = index[nearer], d[nearer]
    return code, apart


def _array(column, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape).astype(np.int64)


def _assigned(books: np.ndarray, moved: np.ndarray | None):
    """The state of rows after they are assigned to the entries of books."""
    positions, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _array(batch.column("vec"), "<i4", positions, width)
            old = () if moved is None else (_array(batch.column("code"), np.uint8, positions), _array(batch.column("apart"), "<i8", positions), moved)
            code, apart = assign(x, books, *old)
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["code"] = pa.array([r.tobytes() for r in code.astype(np.uint8)], pa.binary())
            columns["apart"] = pa.array([r.tobytes() for r in apart.astype("<i8")], pa.binary())
            yield pa.RecordBatch.from_arrays([columns[n] for n in ("kept", "vec", "code", "apart")], ["kept", "vec", "code", "apart"])

    return run


def _integers(scale: float):
    def run(batches):
        for batch in batches:
            vectors = batch.column("vec")
            x = vectors.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(x * scale).astype("<i4").reshape(len(vectors), -1)
            nothing = pa.array([b""] * len(vectors), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array([r.tobytes() for r in x], pa.binary()), nothing, nothing], ["kept", "vec", "code", "apart"])

    return run


def _sums(positions: int, entries: int, width: int):
    """Per task: (position, entry, place, parts, total) of all parts that an entry has."""

    def run(batches):
        total, parts = np.zeros((positions, entries, width), np.int64), np.zeros((positions, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = _array(batch.column("vec"), "<i4", positions, width), _array(batch.column("code"), np.uint8, positions)
            for p in range(positions):
                parts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(total[p], code[:, p], x[:, p])
        p, e, w = (a.ravel() for a in np.indices(total.shape))
        used = parts[p, e] > 0
        columns = [p, e, w, parts[p, e], total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c[used].astype(np.int64)) for c in columns], ["position", "entry", "place", "parts", "total"])

    return run


def _renewed(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The floor of the mean of each entry's parts."""
    sums = state.select("vec", "code").mapInArrow(_sums(*books.shape), "position long, entry long, place long, parts long, total long")
    out = books.copy()
    for r in sums.groupBy("position", "entry", "place").agg(F.sum("parts").alias("n"), F.sum("total").alias("total")).collect():
        out[r["position"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by position, entry and place within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, carry: tuple[str, ...] = (),
    vector: str = "embedding", id: str = "vec_id",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, the carried columns, code: one byte per part, error), and the codebooks (parts, entries, components of a part)."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a code has one byte per part: 1 to 256 entries")
    vec = F.col(quoted(vector)).cast("array<double>").alias("vec")
    kept = F.struct(F.col(quoted(id)).alias("vec_id"), *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(carry)]).alias("kept")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(kept, vec).where(F.col("vec").isNotNull() & finite)
    order = [F.col("kept.vec_id").asc_nulls_last(), F.col("vec")]
    first = rows.where(F.size("vec") > 0).orderBy(*order).limit(1).select(F.size("vec").alias("n")).collect()
    length = first[0]["n"] if first else parts
    if length % parts:
        raise ValueError(f"{parts} equal parts do not fit a length of {length}")
    # At most this, the squares of differences of all components add up below 2^62.
    most = min(1 << 30, math.isqrt((1 << 62) // length) // 2)
    fits = (F.size("vec") == length) & F.forall("vec", lambda x: F.abs(x) * scale < most)
    seeds = [r["vec"] for r in rows.where(fits).orderBy(*order).limit(entries).collect()]
    books = np.floor(np.array(seeds, np.float64).reshape(len(seeds), parts, length // parts) * scale).astype(np.int64).transpose(1, 0, 2).copy()
    named = [F.col("kept.vec_id").alias("vec_id"), *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(carry)]]
    kind = T.StructType([rows.schema["kept"], *T._parse_datatype_string(STATE).fields])
    state, moved = rows.where(fits).mapInArrow(_integers(scale), kind), None
    if len(seeds):
        for _ in range(rounds):
            state = hold(state.mapInArrow(_assigned(books, moved), kind), "assigned")
            renewed = _renewed(state, books)
            books, moved = renewed, (renewed != books).any(2)
        state = state.mapInArrow(_assigned(books, moved), kind)

    def errors(batches):
        for batch in batches:
            apart = _array(batch.column("apart"), "<i8", parts).sum(1) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("code"), pa.array(apart)], ["kept", "code", "error"])

    error = T.StructType([rows.schema["kept"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    coded = state.select("kept", "code", "apart").mapInArrow(errors, error).select(*named, "code", "error")
    other = rows.where(~fits).select(*named, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), books


def with_group_error(coded: DataFrame, group: str, name: str) -> DataFrame:
    """Adds the sum of error over rows of the same group; null is a group, and null errors count nothing.

    Sums are partial aggregates; their table is held, so that Spark knows its
    size and sends it to the tasks only if it is small. No task holds a group.
    """
    coded = hold(coded, "coded")
    sums = hold(coded.groupBy(F.col(quoted(group)).alias("_group")).agg(F.sum("error").alias("_sum")), "sums")
    return coded.join(sums, F.col(quoted(group)).eqNullSafe(F.col("_group")), "left").withColumnRenamed("_sum", name).drop("_group")
