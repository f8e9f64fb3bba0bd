"""The bisector tournament against plain distances."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from palmares.llm import bisectors

KIND = "vec_id long, embedding array<double>, cluster string, label int"


def plain(rows, k, rounds, dim, scale, seed):
    """All by loops over Python's whole numbers."""
    kept = []
    for key, x in rows:
        if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x):
            kept.append((key, [max(min(int(np.floor(scale * c)) if abs(scale * c) < 1e300 else (1 << 60) * (1 if c > 0 else -1), bisectors.BOUND), -bisectors.BOUND) for c in x]))
    digest = lambda key: (key is None, hashlib.sha256(f"{seed}:{key}".encode()).hexdigest() if key is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(p) // len(groups[n]) for p in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(key, *nearest(v)[::-1]) for key, v in kept]
    total = sum(f[2] for f in found)
    inertia = {n: sum(f[2] for f in found if f[1] == n) for n in range(k)}
    return sorted(((*f, inertia[f[1]], total, bisectors.digest(centroids[f[1]])) for f in found), key=repr)


def rows_of(frame):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in frame.collect()), key=repr)


def test_equals_plain_distances(spark):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 0.1) for _ in range(6)]) for i in range(300)]
    rows += [(i, r[1]) for i, r in enumerate(rows[:40], 400)] + [(500 + i, [0.25] * 6) for i in range(150)] + rows[:5]
    rows += [(900, None), (901, []), (902, [0.1] * 5), (903, [None] + [0.1] * 5), (904, [float("nan")] * 6), (905, [float("inf")] + [0.0] * 5), (None, [0.3] * 6), (906, [-0.0] * 6)]
    vectors = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND).repartition(5)
    for k, rounds, scale in ((7, 3, 64), (1, 2, 64), (5, 0, 4)):
        out = bisectors.clusters(vectors, clusters=k, rounds=rounds, dim=6, scale=scale)
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
        assert rows_of(out) == plain(rows, k, rounds, 6, scale, 1)


def test_few_vectors_large_numbers_and_empty_tables(spark):
    rows = [(1, [1e300, -1e300]), (2, [3.5, 4e7]), (None, [0.0, 0.0]), (None, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND)
    assert rows_of(bisectors.clusters(vectors, dim=2)) == plain(rows, 16, 3, 2, 64, 1)
    assert bisectors.clusters(vectors.limit(0), dim=2).collect() == []
    assert bisectors.clusters(vectors, dim=3).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=9, max_size=40), st.booleans())
def test_the_tournament_finds_the_nearest_and_the_smaller_number(k, points, large):
    x = np.array(points, np.int64) * ((1 << 24) if large else 1)
    away = ((x[:, None, :] - x[None, :k, :]) ** 2).sum(axis=2)
    found = bisectors.Bisectors(x[:k])
    assert found.nearest(x).tolist() == away.argmin(axis=1).tolist()
    assert found.distance(x, found.nearest(x)).tolist() == away.min(axis=1).tolist()
