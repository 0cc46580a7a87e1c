"""Block matrix join against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashsieve.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in queries:
        x = min((v.tolist() for i, v in ok if i == q), default=None)
        if x is None:
            continue
        x = np.array(x)
        scores = [(-float(N.inner(x[None], v[None])[0]), i) for i, v in ok if i != q and len(v) == len(x)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * 10.0 ** rng.integers(-3, 3)]) for i in range(n)]
    same = rows[5][1]
    return rows + [(n + i, same) for i in range(n // 3)]


@pytest.mark.parametrize("block_rows", [32, 100_000])
def test_equals_brute_force(spark, block_rows):
    rows = vectors(300, 16, 1)
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    got = N.neighbours(df, df.filter(F.col("vec_id") % 20 == 0), k=20, block_rows=block_rows)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, [i for i, _ in rows if i % 20 == 0], 20)


@pytest.mark.parametrize("tile,pairs", [(2048, 65_536), (37, 65_536), (5, 11)])
def test_tiles_do_not_matter(monkeypatch, tile, pairs):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "PAIRS", pairs)
    rng = np.random.default_rng(4)
    block = N.Quantised(np.arange(200), np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=8), (50, 1))]))
    asked = N.Quantised(np.arange(0, 200, 20), block.vectors[::20])
    for query, heap in zip(asked.ids, N.search(asked, block, 7)):
        scores = N.inner(np.tile(block.vectors[query], (200, 1)), block.vectors)
        want = sorted((-scores[i], i) for i in range(200) if i != query)[:7]
        assert sorted((-s, -n) for s, n in heap) == want


def test_bound_holds():
    rng = np.random.default_rng(2)
    a, b = (N.Quantised(np.arange(50), rng.normal(size=(50, 64)) * rng.lognormal(size=(50, 1))) for _ in range(2))
    estimate = (a.wide @ b.wide.T).astype(float) * a.scale[:, None] * b.scale[None]
    bound = a.error[:, None] * b.norm[None] + a.rounded_norm[:, None] * b.error[None]
    assert (np.abs(a.vectors @ b.vectors.T - estimate) <= bound).all()


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (None, [1.0, 1.0]), (8, [1.0, 0.0, 0.0]), (9, [0.5, 0.1]), (9, [0.5, 0.1]), (0, [1.0, 0.0]), (20, [2.0, 2.0]), (40, [0.0, 0.0])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA)
    got = [tuple(r) for r in N.neighbours(df, df.filter(F.col("vec_id") % 20 == 0), k=3).collect()]
    assert sorted(got) == brute(rows, [0, 20, 40], 3)
    assert N.neighbours(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e300, 1e160, 1e-170])
def test_large_and_small_components(size):
    rng = np.random.default_rng(6)
    shapes = rng.normal(size=(300, 8))
    block = N.Quantised(np.arange(300), shapes * size)
    asked = N.Quantised(np.arange(300, 310), rng.normal(size=(10, 8)) / size)
    for vector, heap in zip(asked.vectors, N.search(asked, block, 5)):
        scores = N.inner(np.tile(vector, (300, 1)), block.vectors)
        assert sorted((-s, -n) for s, n in heap) == sorted((-s, i) for i, s in enumerate(scores))[:5]


def test_vectors_travel_as_they_are_stored(spark):
    rows = vectors(200, 12, 3)
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        assert N.usable(df, "vec_id", "embedding").schema["vector"].dataType.simpleString() == f"array<{kind}>"
        got = N.neighbours(df, df.filter(F.col("vec_id") % 20 == 0), k=4)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, [i for i, _ in rows if i % 20 == 0], 4)


def test_double_queries_keep_their_digits(spark):
    rows = vectors(120, 6, 8)
    asked = [(1000 + i, [x + 1e-12 for x in v]) for i, v in rows[:6]]
    got = N.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"),
                       spark.createDataFrame(asked, "vec_id long, embedding array<double>"), k=3)
    want = []
    for q, x in asked:
        scores = [(-float(N.inner(np.array(x)[None], np.array(v)[None])[0]), i) for i, v in rows]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:3])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
