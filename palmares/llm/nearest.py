"""Nearest neighbours by largest inner product, through randomly rotated one-bit codes.

Every vector is centred, scaled to length one, padded with zeros to the length of the code and rotated at random; of the
result only the signs are kept, packed into bits, beside the correction scalars (distance to the centre, product of the
signs with the rotated unit vector). The product of a query with the signs estimates its inner product with the vector,
and the scalars bound the error. In a block of codes the best estimates are reranked by exact inner products; after them
every vector whose upper bound reaches the worst place so far.

Queries and vectors are dealt into groups, and every pair of groups is one task that returns a bounded number of vectors
for each query. Equal vectors are searched once: a common vector has one code, and only the smallest ids among its
copies are candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palmares.operators.ranking import top_k_per_group
from palmares.store import stored

QUERY_EVERY = 20
TOP = 20
#: Width of the error bound in standard deviations of the estimate, and bits of a code.
BOUND, CODE_BITS = 3.0, 256
CODES = T.StructType([
    T.StructField("vector", T.LongType()), T.StructField("first", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("bits", T.BinaryType()), T.StructField("radius", T.FloatType()), T.StructField("aligned", T.FloatType()),
])
FOUND = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("vector", T.LongType()),
    T.StructField("first", T.LongType()), T.StructField("close", T.DoubleType()),
])


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """The first ``dim`` rows of a random orthogonal matrix of order ``bits``: padding with zeros and turning in one."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(bits, dim)))
    return (q * np.sign(np.diag(r))).T.astype(np.float32)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def encoder(dim: int, bits: int, centre: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, bits, seed)
        for batch in batches:
            away = _matrix(batch.column(2), dim) - centre
            radius = np.linalg.norm(away, axis=1)
            turned = (away / np.where(radius > 0, radius, 1)[:, None]) @ turn
            packed = pa.array([row.tobytes() for row in np.packbits(turned > 0, axis=1)], pa.binary())
            aligned = np.abs(turned).sum(axis=1) / sqrt(bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, packed, pa.array(radius, pa.float32()), pa.array(aligned, pa.float32())], names=CODES.names)

    return encode


def searcher(dim: int, bits: int, centre: np.ndarray, seed: int, top: int, bound: float, block: int = 4096, few: int = 256):
    """For a group of queries and a group of codes: of each query the ``top`` codes with the largest inner products."""

    def best_of(score: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Places of the ``top`` largest scores of every row, ties to the smaller first id; -1 marks no code."""
        order = np.lexsort([np.where(code >= 0, first[code], np.iinfo(np.int64).max), -score], axis=1)
        return order[:, :top]

    def search_group(queries: pa.Table, codes: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        if not queries.num_rows or not codes.num_rows:
            return pa.table({f.name: pa.array([], k) for f, k in zip(FOUND, kinds)})
        turn = rotation(dim, bits, seed)
        asked, stored_vectors = _matrix(queries.column("embedding"), dim), _matrix(codes.column("embedding"), dim)
        query_ids, code_ids, first = queries.column("vector").to_numpy(), codes.column("vector").to_numpy(), codes.column("first").to_numpy()
        radius, aligned = (codes.column(c).to_numpy() for c in ("radius", "aligned"))
        packed = np.frombuffer(b"".join(codes.column("bits").to_pylist()), np.uint8).reshape(len(code_ids), -1)
        safe = np.where(aligned > 0, aligned, 1)
        spread = bound * radius * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / sqrt(max(bits - 1, 1))
        # Rounding of single precision is covered by a small share of the lengths.
        spread = spread + 1e-5 * (radius + np.linalg.norm(centre))
        exact = lambda q, at, code: np.einsum("ij,ij->i", asked[q:q + few][at].astype(float), stored_vectors[code].astype(float))
        parts = []
        for q in range(0, len(query_ids), few):
            some = asked[q:q + few]
            base, turned, length = some @ centre, some @ turn, np.linalg.norm(some, axis=1)
            score, code = np.full((len(some), top), -np.inf), np.full((len(some), top), -1)
            for c in range(0, len(code_ids), block):
                signs = np.unpackbits(packed[c:c + block], axis=1, count=bits).astype(np.float32) * 2 - 1
                scale = (radius[c:c + block] / safe[c:c + block] / sqrt(bits)).astype(np.float32)
                guess = base[:, None] + (turned @ signs.T) * scale
                lead = np.argpartition(-guess, min(top, guess.shape[1]) - 1, axis=1)[:, :top]
                sure = exact(q, np.repeat(np.arange(len(some)), lead.shape[1]), lead.ravel() + c).reshape(lead.shape)
                line = -np.partition(-np.concatenate([score, sure], axis=1), top - 1, axis=1)[:, top - 1]
                np.put_along_axis(guess, lead, -np.inf, axis=1)
                at, more = np.nonzero((guess > -np.inf) & (guess + length[:, None] * spread[c:c + block] >= line[:, None]))
                extra = exact(q, at, more + c)
                worth = extra >= line[at]
                at, more, extra = at[worth], more[worth], extra[worth]
                wide = np.bincount(at, minlength=len(some))
                column = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
                more_score, more_code = np.full((len(some), wide.max(initial=0)), -np.inf), np.full((len(some), wide.max(initial=0)), -1)
                more_score[at, column], more_code[at, column] = extra, more + c
                score, code = np.concatenate([score, sure, more_score], axis=1), np.concatenate([code, lead + c, more_code], axis=1)
                keep = best_of(score, code, first)
                score, code = np.take_along_axis(score, keep, axis=1), np.take_along_axis(code, keep, axis=1)
            at, place = np.nonzero(code >= 0)
            parts.append((query_ids[q:q + few][at], code_ids[code[at, place]], first[code[at, place]], score[at, place]))
        return pa.table({f.name: pa.array(np.concatenate(x), k) for f, k, x in zip(FOUND, kinds, zip(*parts))})

    return search_group


def valid(embedding: Column, dim: int) -> Column:
    """Of the common length, all components finite, not zero."""
    infinite = F.lit(float("inf"))
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return embedding.isNotNull() & (F.size(embedding) == dim) & finite & F.exists(embedding, lambda x: x != 0)


def inner_product(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda total, x: total + x)


def search(
    vectors: DataFrame, top: int = TOP, every: int = QUERY_EVERY, key: str = "vec_id", embedding: str = "embedding",
    seed: int = 5, bound: float = BOUND, code_bits: int = CODE_BITS, query_rows: int = 1024, code_rows: int = 1 << 14,
) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose key is divisible by ``every`` the ``top`` other rows with the
    largest inner product, ties to the smaller key.

    Vectors that are null, zero, hold null or non-finite components, or have another length than most vectors, and rows
    without a key take no part; of equally frequent lengths the smallest counts. Components may be floats, doubles or whole
    numbers: codes are of single precision, scores of the components as given. Rows that repeat a key with the same vector count once; a query's own key is never
    among its neighbours. An empty table gives no rows.
    """
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("embedding")).filter(F.col("id").isNotNull())
    dim = rows.filter(F.size("embedding") > 0).agg(F.mode(F.size("embedding"), deterministic=True)).first()[0] or 1
    rows = rows.filter(valid(F.col("embedding"), dim)).withColumn("vector", F.xxhash64("embedding"))
    # Copies of a vector: the smallest ids are enough, one more than asked for since a query skips its own.
    members = stored(top_k_per_group(rows.select("vector", "id").distinct().withColumn("back", -F.col("id")), ["vector"], top + 1, "back"), "nn-members")
    asked = stored(rows.filter(F.col("id") % every == 0).select("vector", "id").distinct(), "nn-queries")
    distinct = rows.groupBy("vector").agg(F.min("id").alias("first"), F.min("embedding").alias("embedding"), F.max(F.col("id") % every == 0).alias("asked"))
    distinct = stored(distinct, "nn-vectors")
    n, n_asked, *centre = distinct.agg(
        F.count(F.lit(1)), F.count_if("asked"), *[F.coalesce(F.avg(F.get("embedding", F.lit(i))), F.lit(0.0)) for i in range(dim)]
    ).first()
    middle, bits = np.array(centre, np.float32), max(code_bits, dim)
    codes = stored(distinct.select("vector", "first", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(encoder(dim, bits, middle, seed), CODES), "nn-codes")
    query_groups, code_groups = max(1, ceil(n_asked / query_rows)), max(1, ceil(n / code_rows))
    group = lambda c, groups: F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(groups)).cast("int")
    every_group = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = distinct.filter("asked").select("vector", "embedding", group("vector", query_groups).alias("qg"), every_group(code_groups).alias("cg"))
    right = codes.select("*", group("vector", code_groups).alias("cg")).select("*", every_group(query_groups).alias("qg"))
    pairs = left.groupBy("qg", "cg").cogroup(right.groupBy("qg", "cg"))
    near = pairs.applyInArrow(searcher(dim, bits, middle, seed, top + 1, bound), FOUND)
    near = top_k_per_group(near, ["query"], top + 1, "close", ["first"], "place").select("query", "vector")
    a = distinct.select(F.col("vector").alias("query"), F.col("embedding").alias("a"))
    b = distinct.select("vector", F.col("embedding").alias("b"))
    leading = near.join(b, "vector").join(a, "query").select("query", "vector", inner_product(F.col("a"), F.col("b")).alias("score"))
    leading = stored(leading, "nn-scored")
    results = leading.join(members, "vector").select("query", "score", "id")
    results = top_k_per_group(results, ["query"], top + 1, "score", ["id"], "place").drop("place")
    final = asked.select(F.col("vector").alias("query"), F.col("id").alias("query_id")).join(results, "query").filter(F.col("query_id") != F.col("id"))
    ranked = top_k_per_group(final, ["query_id", "query"], top, "score", ["id"])
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
