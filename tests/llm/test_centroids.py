"""Centroid clustering against a plain k-means on Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, v string"


def brute(rows, k, rounds, dims, scale):
    most = centroids.limit(dims)
    own = [(i, [max(-most, min(most, math.floor(scale * x))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    places = [v for _, v in sorted(own, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(places))
    for _ in range(rounds):
        groups = {}
        for _, v in own:
            groups.setdefault(near(v)[1], []).append(v)
        places = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(places)]
    found = [(i, *near(v)) for i, v in own]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), shas[j]) for i, d, j in found), key=str)


def rows(r, n, dims):
    out = [(i, [r.gauss(i % 3, 1) for _ in range(dims)]) for i in range(n)]
    out += [(n, None), (n + 1, []), (n + 2, [0.0] * (dims - 1)), (n + 3, [0.0] * (dims + 1)), (n + 4, [None] + [1.0] * (dims - 1)), (n + 5, [math.nan] * dims), (n + 6, [math.inf] + [0.0] * (dims - 1))]
    out += [(None, [0.5] * dims), (None, [0.25] * dims), (3, [-0.001] * dims), (3, [-0.001] * dims), (n + 7, [1e30] + [0.0] * (dims - 1)), (n + 8, [-1e30] * dims)]
    return out + [(1000 + i, [1.0] * dims) for i in range(40)]


@pytest.mark.parametrize(("n", "dims", "k", "rounds"), [(120, 4, 7, 3), (5, 3, 60, 2), (60, 2, 5, 0), (80, 64, 16, 3)])
def test_clusters_equal_brute_force(spark, n, dims, k, rounds):
    own = rows(random.Random(n), n, dims)
    docs = spark.createDataFrame([(i, e, "x", "y", "z") for i, e in own], SCHEMA).repartition(3)
    got = centroids.cluster(docs, k=k, rounds=rounds, dims=dims, scale=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(own, k, rounds, dims, 8)


def test_nothing_kept_gives_nothing(spark):
    for own in ([], [(1, [1.0, 2.0], "x", "y", "z"), (2, None, "x", "y", "z")]):
        assert centroids.cluster(spark.createDataFrame(own, SCHEMA), dims=3).collect() == []


def test_too_many_centroids_raise(spark):
    with pytest.raises(ValueError, match="more than"):
        centroids.cluster(spark.createDataFrame([], SCHEMA), k=1 << 20)


def test_windows_hold_ties_at_the_rim_and_leave_most_centroids_out():
    search = centroids.Annulus(np.array([[5, 0], [-5, 0], [0, 5], [4, 3], [400, 0], [0, 500]]))
    cluster, distance = search.nearest(np.array([[0, 0], [0, 0], [390, 0], [0, 1000]]), np.array([-1, 3, 4, 5]))
    assert cluster.tolist() == [0, 0, 4, 5] and distance.tolist() == [25, 25, 100, 250000]
    low, high = search.windows(np.array([[0, 0], [390, 0]]), np.array([-1, 4]))
    assert (high - low).tolist() == [4, 1]


@pytest.mark.parametrize("last", [False, True])
def test_annulus_equals_all_distances(last):
    r = np.random.default_rng(3)
    places, points = r.integers(-20, 20, (40, 3)), r.integers(-20, 20, (500, 3))
    every = ((points[:, None] - places) ** 2).sum(axis=2)
    cluster, distance = centroids.Annulus(places).nearest(points, r.integers(0, 40, 500) if last else np.full(500, -1))
    assert distance.tolist() == every.min(axis=1).tolist() and cluster.tolist() == every.argmin(axis=1).tolist()
