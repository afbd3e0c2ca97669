"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from veritrail.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, v string, cluster int, label int"


def brute(rows, k=centroids.K, rounds=centroids.ROUNDS):
    """{place of a row: (cluster, distance, cluster_inertia, inertia, sha)} in exact integers."""
    fits = lambda x: x is not None and math.isfinite(x) and abs(x) < centroids.LARGEST
    vectors = {n: [math.floor(256 * x) for x in v] for n, (_, v) in enumerate(rows) if v is not None and len(v) == 64 and all(map(fits, v))}
    starts = sorted((hashlib.sha256(f"2:{rows[n][0]}".encode()).hexdigest(), v) for n, v in vectors.items() if rows[n][0] is not None)
    centres = [v for _, v in starts[:k]]
    nearest = lambda: {n: min((min(sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), int(centroids.MOST)), i) for i, c in enumerate(centres)) for n, v in vectors.items()}
    for _ in range(rounds):
        of = nearest()
        for i in range(len(centres)):
            mine = [vectors[n] for n in vectors if of[n][1] == i]
            if mine:
                centres[i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    of = nearest()
    inertia = {i: sum(d for d, j in of.values() if j == i) for i in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(rows[n][0], i, d, inertia[i], sum(inertia.values()), sha[i]) for n, (d, i) in of.items()]


def found(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "x", 7, 1) for i, v in rows], SCHEMA).repartition(3)
    return [tuple(r)[:6] for r in centroids.clustered(table, **options).collect()]


@pytest.mark.parametrize("size", [0.01, 1, 3000, 2.0**22])
def test_clusters_are_exact(spark, size):
    """Also where squares need all 64 bits; repeated vectors, ties and rows that take no part."""
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, size) for _ in range(64)]) for i in range(90)]
    if size == 2.0**22:  # far apart from zero, near each other
        rows = [(i, [size + rng.random() for _ in range(64)]) for i in range(90)]
    rows += [(200 + i, [round(x) for x in rows[i][1]]) for i in range(20)] * 2
    rows += [(300, None), (301, [1.0] * 63), (302, [None] + [1.0] * 63), (303, [float("nan")] + [1.0] * 63), (304, [float("inf")] + [1.0] * 63), (None, [0.5] * 64), (5, [0.25] * 64)]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(found(spark, rows, k=12, rounds=4), key=key) == sorted(brute(rows, 12, 4), key=key)


def test_few_or_no_vectors(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, [1.0] * 64)])[0][1] == 0
    assert sorted(found(spark, [(1, [1.0] * 64), (2, [2.0] * 64)])) == sorted(brute([(1, [1.0] * 64), (2, [2.0] * 64)]))


def test_distances_beyond_a_long_are_the_largest_long():
    low, high = np.zeros((1, 64), np.int64), np.full((1, 64), (1 << 32) - 1)
    planes = [centroids.planes_of(x, 32) for x in (low, high)]
    assert centroids.distances(planes[0], planes[1])[0, 0] == centroids.MOST
    assert (centroids.integers_of(planes[1]) == high).all()
