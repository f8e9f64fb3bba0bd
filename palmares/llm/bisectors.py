"""Centroid clustering in whole numbers, by a tournament of bisectors.

Between two centroids a and b lies the plane of points at equal distance; a vector x is nearer to b if and only if
x.(2b - 2a) > b.b - a.a. Normals and thresholds of all pairs are whole numbers, made once a round. A vector starts
with centroid 0 and meets the others in order: each test keeps one of two, zero keeps the smaller number, and after k - 1
tests the nearest is left. Only the distance to that one is computed.

Vectors are turned into whole numbers once and stored. A round is one scan of them: tasks assign their vectors and return
sums and counts by centroid, which Spark adds up to k x dim numbers for the driver. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palmares.store import discard, stored

CLUSTERS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
#: Whole numbers are held within this bound, which leaves room for every sum of the tests in 64 bits.
BOUND = 1 << 27
#: Vectors assigned together.
BLOCK = 8192


class Bisectors:
    """Normals and thresholds of all pairs of the centroids; the normals of centroid a lie at ``normal[a]``."""

    def __init__(self, centroids: np.ndarray):
        # Products are exact in doubles as long as every sum stays below 2 to the 53.
        self.centroids = centroids
        self.most = int(np.abs(centroids).max(initial=0))
        square = (centroids**2).sum(axis=1)
        self.normal = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.threshold = square[None, :] - square[:, None]

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of every vector."""
        exact = 4 * self.most * int(np.abs(vectors).max(initial=0)) * vectors.shape[1] < 1 << 52
        points, normal = (vectors.astype(float), self.normal.astype(float)) if exact else (vectors, self.normal)
        winner = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.centroids)):
            # Vectors with the same winner so far meet the same plane.
            order = np.argsort(winner, kind="stable")
            cuts = np.searchsorted(winner[order], np.arange(rival + 1))
            for holder in range(rival):
                rows = order[cuts[holder]:cuts[holder + 1]]
                if len(rows):
                    winner[rows[points[rows] @ normal[holder, rival] > self.threshold[holder, rival]]] = rival
        return winner

    def distance(self, vectors: np.ndarray, winner: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[winner]) ** 2).sum(axis=1)


def whole_vectors(vectors: DataFrame, key: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(key, point): the vectors of ``dim`` components without null, NaN or infinity, as floor(scale * x) within ``BOUND``."""
    infinite = F.lit(float("inf"))
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    bounded = lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x * scale, F.lit(-1e18)), F.lit(1e18))), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    return rows.filter((F.size("x") == dim) & finite).select("key", F.transform("x", bounded).alias("point"))


def _points(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def sums(points: DataFrame, bisectors: Bisectors, dim: int) -> dict[int, tuple[int, list[int]]]:
    """Of every centroid that has vectors their count and componentwise sum: at most k x dim numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = _points(batch.column(0).slice(at, BLOCK), dim)
                winner = bisectors.nearest(some)
                count += np.bincount(winner, minlength=k)
                np.add.at(total, winner, some)
        some = np.flatnonzero(count)
        offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim)
        lists = pa.ListArray.from_arrays(offsets, pa.array(total[some].ravel(), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64()), lists], names=["cluster", "n", "total"])

    parts = points.select("point").mapInArrow(add, "cluster long, n long, total array<long>")
    added = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at")
    out: dict[int, tuple[int, list[int]]] = {}
    for row in added.agg(F.sum("n").alias("n"), F.sum("part").alias("part")).orderBy("cluster", "at").collect():
        out.setdefault(row["cluster"], (row["n"], []))[1].append(row["part"])
    return out


def first_centroids(points: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ``seed:key`` has the smallest digests, in their order; rows without a key come last.

    Equal keys go by their vectors. Spark keeps k rows a task before they meet.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    chosen = points.select(digest.alias("digest"), "point").orderBy(F.asc_nulls_last("digest"), "point").limit(clusters).collect()
    return np.array([r["point"] for r in chosen], np.int64)


def fitted(points: DataFrame, clusters: int, rounds: int, dim: int, seed: int) -> np.ndarray:
    """The centroids after ``rounds`` rounds; there are fewer than ``clusters`` if there are fewer vectors."""
    centroids = first_centroids(points, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for cluster, (n, total) in sums(points, Bisectors(centroids), dim).items():
            centroids[cluster] = [t // n for t in total]
    return centroids


def assigned(points: DataFrame, centroids: np.ndarray, dim: int) -> DataFrame:
    """(key, cluster, distance) of every vector."""
    bisectors, kind = Bisectors(centroids), points.schema["key"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                some = _points(part.column(1), dim)
                winner = bisectors.nearest(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(winner, pa.int32()), pa.array(bisectors.distance(some, winner), pa.int64())], names=["key", "cluster", "distance"]
                )

    return points.mapInArrow(assign, f"key {kind}, cluster int, distance long")


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def clusters(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dim: int = DIM, scale: int = SCALE, seed: int = 1,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row for every vector that takes part.

    Vectors that are null, of another length than ``dim``, or hold null or non-finite components take no part. Rows that
    repeat are vectors of their own, and so are rows without a key, which start a centroid only where keys run out. With
    fewer vectors than clusters every vector starts one. Components beyond ``BOUND`` after scaling are held there. A sum of
    distances beyond 64 bits is null. An empty table gives no rows.
    """
    points = stored(whole_vectors(vectors, key, embedding, dim, scale), "bisector-points")
    centroids = fitted(points, clusters, rounds, dim, seed)
    if not len(centroids):
        centroids = np.zeros((1, dim), np.int64)
    rows = stored(assigned(points, centroids, dim), "bisector-rows")
    discard(points)
    names = [(at, c, digest(c)) for at, c in enumerate(centroids.tolist())]
    known = vectors.sparkSession.createDataFrame(names, "cluster int, centroid array<long>, centroid_sha256 string")
    # At most ``clusters`` rows: counted, not guessed.
    each = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"))
    each = each.select("cluster", F.col("part").try_cast("long").alias("cluster_inertia"), "part")
    total = each.agg(F.sum("part")).scalar().try_cast("long").alias("inertia")
    each = each.join(known, "cluster").select("cluster", "cluster_inertia", total, "centroid", "centroid_sha256")
    out = rows.join(F.broadcast(each), "cluster")
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def _assign(source: str, centroids: str) -> str:
    """SQL: the nearest centroid of each vector of ``source`` and its squared distance, ties to the smaller number."""
    return f"""
    SELECT id, v, near.c AS cluster, near.d AS distance FROM (
      SELECT id, v, min(struct_pack(d := list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS near
      FROM {source}, {centroids} GROUP BY id, v)"""


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 1) -> str:
    """DuckDB SQL for the rows of ``clusters`` over keys that do not repeat; the number of rounds unrolls it."""
    parts = [
        f"""kept AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || id)) - 1 AS c, v AS w FROM kept
      QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || id)) <= {clusters})""",
    ]
    for r in range(rounds):
        parts += [
            f"a{r} AS ({_assign('kept', f'c{r}')})",
            f"""m{r} AS (SELECT cluster, list(m ORDER BY place) AS w FROM (
        SELECT cluster, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
          SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS place FROM a{r}) GROUP BY cluster, place) GROUP BY cluster)""",
            f"c{r + 1} AS (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} ON c = cluster)",
        ]
    parts.append(f"assigned AS ({_assign('kept', f'c{rounds}')})")
    return "WITH " + ",\n".join(parts) + f"""
    SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
      CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(w, ',')) AS centroid_sha256
    FROM assigned JOIN c{rounds} ON cluster = c"""
