"""Nearest neighbours by randomly rotated one-bit codes.

A unit vector is rotated at random into at least ``bits`` dimensions and kept
as the signs (one bit each) with one correction, its inner product with the
code's own unit vector. For a query, rotated but not cut to bits, the inner
product with the code divided by the correction estimates the cosine without
bias, and the correction bounds the error. A vector is reranked if its upper
bound reaches the k-th best lower bound: exact cosines of the original
vectors, in double precision, decide.

Work: equal vectors are one code, with their k + 1 smallest identifiers (no
query can need more). They meet by two 64-bit hashes, so that a vector is
shuffled once, after equal ones of a task were made one; a class whose least
and greatest vectors differ (two vectors with the same hashes) fails the job.
Codes and queries are dealt to blocks by hash; each pair of blocks is one
bounded matrix product, so a task never holds more than a block of each, and
codes are copied once for each QUERY_BLOCK queries. Every row is covered;
nothing is probed or capped.

Vectors that are null, empty, all zero, or hold null or non-finite
components take no part, nor do rows with a null identifier. Vectors meet only those of their own
dimension. Repeated rows count once. Ties go to the smaller identifier. An
empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import hold, quoted

BLOCK, QUERY_BLOCK, SLICE, QUERY_SLICE = 16_384, 4096, 4096, 1024


@lru_cache(8)
def rotation(dim: int, bits: int) -> np.ndarray:
    """Orthonormal columns: dim -> as many dimensions as there are bits (at least dim, a multiple of 8)."""
    wide = -(-max(dim, bits) // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(42).standard_normal((wide, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(embeddings: DataFrame, vector: str, id: str) -> DataFrame:
    """vec_id, vec (doubles) of the rows that take part."""
    vec = F.col(quoted(vector)).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(quoted(id)).alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where((F.size("vec") > 0) & finite).withColumn("big", F.array_max(F.transform("vec", F.abs))).where("big > 0")
    # Squares that would leave the range of a double: such a vector is scaled first, which no cosine minds.
    plain = F.col("big").between(1e-140, 1e140)
    return rows.select("vec_id", F.when(plain, F.col("vec")).otherwise(F.transform("vec", lambda x: x / F.col("big"))).alias("vec"))


def _units(column) -> np.ndarray:
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _encode(bits: int, as_query: bool):
    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                turned = _units(part.column("vec")).astype(np.float32) @ rotation(int(dim), bits).T
                if as_query:
                    kept = [pa.array([v.tobytes() for v in turned], pa.binary()), pa.array(np.ones(len(turned), np.float32))]
                else:
                    scale = np.float32(1 / np.sqrt(turned.shape[1]))
                    code = np.packbits(turned > 0, axis=1)
                    kept = [pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.abs(turned).sum(1, dtype=np.float32) * scale)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), part.column("dim"), *kept], ["cid", "dim", "code", "fit"])

    return run


def _estimate(k: int, sureness: float):
    """Of a block of codes and a block of queries: the pairs that may be among the query's k best. Codes are unpacked slice by slice."""

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = {"query": pa.int64(), "cid": pa.int64(), "low": pa.float32(), "high": pa.float32()}
        n, m = codes.num_rows, queries.num_rows
        if not n or not m:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        turned = np.frombuffer(b"".join(queries["code"].to_pylist()), np.float32).reshape(m, -1)
        wide = turned.shape[1]
        cids, fits, qids = codes["cid"].to_numpy(), codes["fit"].to_numpy(), queries["cid"].to_numpy()
        best, parts = np.full((m, k), -np.inf, np.float32), []
        for at in range(0, n, SLICE):
            packed = np.frombuffer(b"".join(codes["code"].slice(at, SLICE).to_pylist()), np.uint8).reshape(-1, wide // 8)
            fit = fits[at : at + SLICE]
            signs = (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1).T
            error = (sureness * np.sqrt(np.maximum(0, 1 - fit**2)) / (fit * np.sqrt(max(1, wide - 1)))).astype(np.float32)
            scale = (fit * np.sqrt(wide)).astype(np.float32)
            for of in range(0, m, QUERY_SLICE):
                here = slice(of, of + QUERY_SLICE)
                guess = (turned[here] @ signs) / scale
                best[here] = np.partition(np.concatenate((best[here], guess - error), axis=1), -k, axis=1)[:, -k:]
                q, c = np.nonzero(guess + error >= best[here].min(1)[:, None])
                parts.append((of + q, cids[at + c], guess[q, c] - error[c], guess[q, c] + error[c]))
        q, cid, low, high = (np.concatenate(p) for p in zip(*parts))
        keep = high >= best.min(1)[q]
        return pa.table({name: pa.array(x[keep], t) for (name, t), x in zip(kinds.items(), (qids[q], cid, low, high))})

    return run


def nearest(
    embeddings: DataFrame, is_query: Column, k: int = 5, bits: int = 1024, sureness: float = 2.5, vector: str = "embedding", id: str = "vec_id"
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row with ``is_query`` (an expression on vec_id) its k nearest other rows."""
    same = ["dim", "hash", "hash2"]
    hashes = [F.xxhash64("vec").alias("hash"), F.xxhash64(F.lit(29), F.reverse("vec")).alias("hash2")]
    rows = hold(usable(embeddings, vector, id).select("vec_id", "vec", F.size("vec").alias("dim"), *hashes), "vectors")
    spare = k + 1
    # Equal vectors: the smallest identifiers of each. Spark keeps that many per task before it shuffles.
    named = rows.select("vec_id", *same).distinct()
    first = named.withColumn("at", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("at") <= spare)
    first = first.groupBy(*same).agg(F.collect_list("vec_id").alias("ids"))
    vectors = rows.groupBy(*same).agg(F.min("vec").alias("vec"), F.max("vec").alias("other"))
    vec = F.when(F.col("vec") == F.col("other"), F.col("vec")).otherwise(F.raise_error(F.lit("two vectors have the same hashes")))
    classes = vectors.withColumn("vec", vec).drop("other").join(first, same)
    classes = hold(classes.select(F.monotonically_increasing_id().alias("cid"), *same, "vec", "ids"), "classes")
    asked = hold(named.where(is_query).join(classes.select("cid", *same), same).select(F.col("vec_id").alias("query_id"), "cid"), "asked")
    wanted = asked.select("cid").distinct()
    blocks, query_blocks = max(1, -(-classes.count() // BLOCK)), max(1, -(-wanted.count() // QUERY_BLOCK))

    def dealt(df, own, n, other, m):
        mine = F.pmod(F.xxhash64(F.lit(5), "cid"), F.lit(n)).cast("int").alias(own)
        return df.select("*", mine, F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    kind = "cid long, dim int, code binary, fit float"
    codes = hold(classes.select("cid", "dim", "vec").mapInArrow(_encode(bits, False), kind), "codes")
    turned = classes.join(wanted, "cid", "left_semi").select("cid", "dim", "vec").mapInArrow(_encode(bits, True), kind)
    codes, turned = dealt(codes, "b", blocks, "q", query_blocks), dealt(turned, "q", query_blocks, "b", blocks)
    met = codes.groupBy("dim", "b", "q").cogroup(turned.groupBy("dim", "b", "q")).applyInArrow(_estimate(spare, sureness), "query long, cid long, low float, high float")
    best = Window.partitionBy("query").orderBy(F.desc("low"), "cid")
    whole = Window.partitionBy("query")
    met = met.withColumn("at", F.row_number().over(best)).withColumn("bar", F.max(F.when(F.col("at") == spare, F.col("low"))).over(whole))
    near = met.where("bar is null or high >= bar").select("query", "cid")
    pairs = near.join(classes.select("cid", "vec", "ids"), "cid").join(classes.select(F.col("cid").alias("query"), F.col("vec").alias("qvec")), "query")
    cosine = _dot(F.col("qvec"), F.col("vec")) / (F.sqrt(_dot(F.col("qvec"), F.col("qvec"))) * F.sqrt(_dot(F.col("vec"), F.col("vec"))))
    scored = pairs.select("query", "ids", cosine.alias("score")).select("query", "score", F.explode("ids").alias("vec_id"))
    order = [F.desc("score"), F.asc("vec_id")]
    top = scored.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("at") <= spare).drop("at")
    found = asked.join(top, F.col("cid") == F.col("query")).where("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
