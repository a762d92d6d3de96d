"""Centroid clustering against a plain version of the same rounds."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from paddock.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string, apex double"


def plain(rows, k, rounds, n):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == n and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    inertia = {j: sum(d for _, d, m in found if m == j) for j in range(len(centres))}
    return sorted(((i, j, d, inertia[j], total, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def vectors(seed, n, components, groups=6):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(components)] for _ in range(groups)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in r.choice(middles)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(n // 2)]  # a third are copies
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[3][1]), (None, None), (2000, None), (2001, []), (2002, [0.0] * components)]
    rows += [(2003, [float("nan")] * components), (2004, [float("inf")] + [0.0] * (components - 1)), (2005, [None] * components), (2006, [0.5] * (components + 1))]
    return rows


@pytest.mark.parametrize(("n", "components", "k"), [(120, 8, 5), (60, 3, 40), (4, 6, 40)])
def test_clusters(spark, n, components, k):
    rows = vectors(n, n, components)
    df = spark.createDataFrame([(i, v, 1, 2, "x", 0.5) for i, v in rows], SCHEMA).repartition(4)
    got = centroids.clusters(df, k=k, components=components).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, k, 5, components)


def test_nothing_kept(spark):
    df = spark.createDataFrame([(1, [0.5], 1, 2, "x", 0.5), (2, None, 1, 2, "x", 0.5)], SCHEMA)
    assert centroids.clusters(df).count() == 0 == centroids.clusters(df.where("false")).count()


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e6] * 64, 1, 2, "x", 0.5)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        centroids.clusters(df).count()


def test_bounds():
    """Apex bounds hold for every pair, also with flat and repeated pivots."""
    rng = np.random.default_rng(3)
    x = rng.integers(-300, 300, (300, 12))
    x[:, 9:] = x[:, :3]  # nine dimensions
    x[50:60] = x[0]
    simplex = centroids.Simplex(x[np.r_[0, 50:60, 1:40]], 20)
    assert 8 <= len(simplex.pivots) <= 10
    low, high = centroids.bounds(simplex.apexes(x), simplex.apexes(x))
    exact = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (low <= exact).all() and (exact <= high).all()
    assert (exact - low).mean() < 0.2 * exact.mean()
