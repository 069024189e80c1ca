"""Clusters against plain rounds over all distances."""

import hashlib
import random

import numpy as np

from facsimile.llm.centroids import Rotation, centroid_digest, fit_centroids, nearest

SCHEMA = "vec_id long, embedding array<double>, row string, cluster string"


def brute(rows, k, rounds, dims, scale=1024):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == n]
            if own:
                centres[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = [sum(d for d, c in found if c == n) for n in range(len(centres))]
    return [(str(i), c, d, inertia[c], sum(inertia), centroid_digest(centres[c])) for (i, _), (d, c) in zip(kept, found)]


def check(spark, rows, k, rounds, dims, **options):
    table = spark.createDataFrame([(i, v, "r", "c") for i, v in rows], SCHEMA).repartition(3)
    got = fit_centroids(table, k=k, rounds=rounds, dims=dims, **options).labelled().collect()
    assert all(r.row.row == "r" and r.row.cluster == "c" for r in got)
    return sorted((str(r.row.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got)


def test_rounds(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(None, rows[0][1]), (None, None), (900, rows[1][1][:3]), (901, [float("nan")] * 12), (902, [None] + rows[1][1][1:]), (903, [float("inf")] * 12)]
    rows += [rows[7]] * 60 + [(910, []), (3, rows[4][1])]
    for k, leading, sample in ((6, 3, 50), (3, 12, 10_000), (8, 1, 1)):
        assert check(spark, rows, k, 6, 12, leading=leading, sample=sample) == sorted(brute(rows, k, 6, 12))


def test_ties_and_empty_clusters(spark):
    """Few different points: equal centroids, of which all but the first stay empty."""
    rows = [(i, [float(i % 2), -0.5, float(i % 3 == 0)]) for i in range(40)]
    assert check(spark, rows, 8, 5, 3) == sorted(brute(rows, 8, 5, 3))
    assert check(spark, rows[:3], 8, 5, 3) == sorted(brute(rows[:3], 8, 5, 3))


def test_large_components(spark):
    rows = [(i, [8e4 * (i % 4) - 1.3e5, 1e-9 * i, -1.3e5]) for i in range(30)]
    assert check(spark, rows, 4, 4, 3) == sorted(brute(rows, 4, 4, 3))
    beyond = fit_centroids(spark.createDataFrame([(1, [1e300] * 64, "", ""), (2, [-1e300] * 64, "", "")], SCHEMA), k=1).labelled().collect()
    assert len(beyond) == 2


def test_bounds_rule_out_most(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (8, 64)).astype(np.int64)
    points = centres[rng.integers(0, 8, 2000)] + rng.normal(0, 40, (2000, 64)).astype(np.int64)
    rotation = Rotation.fit(points[:500].astype(float), 16)
    cluster, distance, verified = nearest(points, *rotation.coordinates(points.astype(float)), centres, rotation)
    all_distances = ((points[:, None, :] - centres) ** 2).sum(axis=2)
    assert np.array_equal(cluster, all_distances.argmin(axis=1)) and np.array_equal(distance, all_distances.min(axis=1))
    assert verified < 1.2 * len(points)


def test_no_rows(spark):
    assert fit_centroids(spark.createDataFrame([], SCHEMA)) is None
    assert fit_centroids(spark.createDataFrame([(1, None, "", "")], SCHEMA)) is None
