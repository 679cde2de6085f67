import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from airloom.llm import centroid_clustering as s


def brute(rows, k, rounds, dim):
    kept = [(i, [max(-s.MOST, min(s.MOST, math.floor(256.0 * v))) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    c = [x for _, x in sorted(kept, key=name)[:k]]
    for r in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c)) for _, x in kept]
        if r < rounds:
            for j in range(len(c)):
                own = [x for (_, x), (_, n) in zip(kept, near) if n == j]
                if own:
                    c[j] = [sum(v) // len(own) for v in zip(*own)]
    total, by = sum(d for d, _ in near), Counter()
    for d, j in near:
        by[j] += d
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    fit = lambda v: v if v < 1 << 63 else None
    return Counter((i, j, d, fit(by[j]), fit(total), digest[j]) for (i, _), (d, j) in zip(kept, near))


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "z") for i, x in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)


@pytest.mark.parametrize("seed, k, scale", [(1, 5, 0.02), (2, 12, 1.0), (3, 40, 0.01), (4, 1, 1.0)])
def test_matches_brute_force(spark, seed, k, scale):
    rng, dim = random.Random(seed), 4
    rows = [(i, [rng.gauss(i % 7 * scale, scale / 2) for _ in range(dim)]) for i in range(200)]
    rows += [(500 + i, [0.5] * dim) for i in range(30)] + [(7, [0.25] * dim), (7, [0.25] * dim), (None, [-1.0] * dim), (None, [1.0] * dim)]
    rows += [(600, None), (601, [1.0]), (602, [float("nan")] * dim), (603, [1.0, None, 1.0, 1.0]), (604, [float("inf")] * dim), (605, [])]
    got = s.clustered(frame(spark, rows), k, 3, dim)
    assert Counter(map(tuple, got.collect())) == brute(rows, k, 3, dim)


def test_huge_components(spark):
    rows = [(i, [10.0**i, -(10.0**i), 3.5]) for i in range(9)] + [(50, [1e300, -1e300, 0.0])]
    got = s.clustered(frame(spark, rows), 3, 2, 3)
    assert Counter(map(tuple, got.collect())) == brute(rows, 3, 2, 3)


def test_no_vectors(spark):
    got = s.clustered(frame(spark, [(1, [1.0])]))
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_save_distances_and_keep_ties():
    rng = np.random.default_rng(3)
    middles = rng.integers(-2000, 2000, (40, 8))
    x = np.concatenate([m + rng.integers(-60, 60, (50, 8)) for m in middles])
    c = middles + rng.integers(-30, 30, middles.shape)
    centres = s.Centres(c)
    cluster, upper, lower = centres.nearest(x, np.arange(40))
    for _ in range(4):
        moved = centres.c + rng.integers(-5, 6, c.shape)
        moved[3] = moved[2]  # two centroids in one place
        centres = s.Centres(moved, centres.c)
        cluster, upper, lower, work = centres.assign(x, cluster, upper, lower)
        assert (cluster == s.squares(x, moved).argmin(axis=1)).all()
        assert work < 0.2 * len(x) * 40
