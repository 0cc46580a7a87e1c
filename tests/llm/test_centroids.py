import hashlib
import math

import numpy as np
import pytest

from hashsieve.llm import centroids as C
from tests.conftest import SF001

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, k, rounds, dimensions, scale=256, salt="2:"):
    """``rows``: (vec_id, components).  Python integers throughout."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in first[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, c), j) for j, c in enumerate(middle)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for j in range(len(middle)):
            own = [v for (_, v), (_, at) in zip(kept, found) if at == j]
            if own:
                middle[j] = [sum(column) // len(own) for column in zip(*own)]
    return sorted(((i is None, i or 0, j, d) for (i, _), (d, j) in zip(kept, assign()) if kept)), middle


def run(spark, rows, **options):
    found, middle = C.clusters(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA), **options)
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect()), middle.tolist()


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_clusters_against_brute_force(spark, leading):
    rng = np.random.default_rng(leading)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 400)]  # a third of the rows are one vector
    rows += [(7, [0.0] * 6), (7, rows[3][1]), (None, [0.5] * 6)]  # repeated and missing ids
    rows += [(901, None), (902, []), (903, [1.0] * 5), (904, [1.0] * 5 + [None]), (905, [1.0] * 5 + [float("nan")]), (906, [1.0] * 5 + [float("-inf")])]
    assert run(spark, rows, k=12, rounds=3, dimensions=6, leading=leading) == brute(rows, 12, 3, 6)


def test_ties_and_small_tables(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(18)]  # ties between centroids, equal vectors
    assert run(spark, grid, k=5, rounds=4, dimensions=2) == brute(grid, 5, 4, 2)
    assert run(spark, grid[:3], k=5, rounds=4, dimensions=2) == brute(grid[:3], 5, 4, 2)  # fewer vectors than centroids
    assert run(spark, [(1, [1.0])], k=5, rounds=1, dimensions=2) == ([], [])
    assert run(spark, [], k=5, rounds=1, dimensions=2) == ([], [])
    large = [(i, [5e5 * (-1) ** i, 3.0 + i]) for i in range(20)]
    assert run(spark, large, k=3, rounds=2, dimensions=2) == brute(large, 3, 2, 2)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e9, 0.0])], k=1, rounds=1, dimensions=2)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    x = np.rint(256 * (rng.normal(size=(5000, 64)) * np.geomspace(1, 0.01, 64)) @ basis.T).astype(np.int64)
    middle = x[:40].copy()
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1].T
    rotation = C.Rotation(axes, C.LEADING)
    best, distance, measured = C.nearest_centroids(x, *rotation(x), middle, rotation)
    exact = ((x[:, None, :] - middle[None, :, :]) ** 2).sum(axis=2)
    assert best.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()
    assert measured < 0.2 * exact.size


def test_query_sums(spark):
    rows = C.op13_centroids(spark, SF001).collect()
    whole, middle = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()], 40, 5, 64)
    assert sorted((False, r.vec_id, r.cluster, r.distance) for r in rows) == whole
    assert {r.inertia for r in rows} == {sum(d for *_, d in whole)}
    for r in rows:
        assert r.cluster_inertia == sum(d for _, _, j, d in whole if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()
