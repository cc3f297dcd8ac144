"""Exact clustering against Lloyd's rounds in plain integers."""

import math
import random
from hashlib import sha256

import numpy as np

from curbline.llm import lloyd as L

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long"


def brute(rows, k, rounds, dimensions, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found, per = assign(), {}
    for d, j in found:
        per[j] = per.get(j, 0) + d
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, d, per[j], sum(per.values()), digests[j]) for (i, _), (d, j) in zip(kept, found)], key=str)


def _vectors(n, dimensions, seed=4, grid=None):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(dimensions)] for _ in range(6)]
    out = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.3) for x in middles[i * i % 6]]
        out.append((i * 3, [round(x * grid) / grid for x in v] if grid else v, 1, 2))
    return out


def _got(df):
    return sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()], key=str)


def test_equals_brute_force_with_odd_rows(spark):
    rows = _vectors(500, 8) + [(None, [0.1] * 8, 1, 2), (2**53 + 1, [0.2] * 8, 1, 2), (5, None, 1, 2), (7, [1.0] * 7, 1, 2), (8, [float("nan")] + [0.0] * 7, 1, 2), (11, [float("inf")] + [0.0] * 7, 1, 2)]
    rows += [(13, [None] + [0.0] * 7, 1, 2), (14, [0.0] * 8, 1, 2), (17, [30_000.0] * 8, 1, 2)] + [(20, [0.5] * 8, 1, 2)] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for rounds in (0, 1, 3, 6):
        assert _got(L.report(docs, k=5, rounds=rounds, dimensions=8, block=64)) == brute(rows, 5, rounds, 8, 64)


def test_ties_on_a_coarse_grid(spark):
    rows = _vectors(400, 2, seed=9, grid=4)
    assert _got(L.report(spark.createDataFrame(rows, SCHEMA), k=7, rounds=4, dimensions=2, scale=4, block=50)) == brute(rows, 7, 4, 2, 4)


def test_few_vectors_one_cluster_empty_table(spark):
    rows = _vectors(3, 4)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert _got(L.report(docs, k=16, dimensions=4)) == brute(rows, 16, 3, 4, 64)
    assert _got(L.report(docs, k=1, dimensions=4)) == brute(rows, 1, 3, 4, 64)
    assert _got(L.report(docs.limit(0), dimensions=4)) == []
    assert _got(L.report(docs, dimensions=5)) == []


def test_most_vectors_are_not_looked_at_again(spark):
    """Six clouds far apart: after the first assignment, few gaps expire."""
    rng = random.Random(2)
    rows = [(i, [10.0 * (i % 6) + rng.gauss(0, 0.2) for _ in range(4)], 1, 2) for i in range(1200)]
    _, _, state = L.cluster(spark.createDataFrame(rows, SCHEMA), k=12, rounds=5, dimensions=4, block=200)
    assert state.agg({"popped": "sum"}).first()[0] < 0.4 * 1200  # in the last round
