"""Whitening against the eigenvectors of a covariance in exact integers, and the cases that the docstring defines."""

import math
import random

import numpy as np
import pytest

from folioscope.llm.queries import QUERIES
from folioscope.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, x int, n int, whitened int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in zip(ids or range(len(vectors)), vectors)], SCHEMA)


def plain(vectors, scale):
    """n, deviations by position, whitened rows and explained shares; whitened up to the sign of a component."""
    x = {i: tuple(math.floor(scale * c) for c in v) for i, v in vectors.items()}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    moved = {i: [n * c - s for c, s in zip(v, sums)] for i, v in x.items()}
    centred = np.array([[n * c - s for c, s in zip(v, sums)] for v in fit], float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    white = {i: np.array(m, float) / n @ directions / np.sqrt(np.maximum(values, 1e-300)) for i, m in moved.items()}
    return n, {i: sum(c * c for c in m) for i, m in moved.items()}, white, values / values.sum()


def check(found, want, k):
    n, deviation, white, explained = want
    got = np.array([found[i].whitened for i in sorted(found)])
    signs = np.sign((got * np.array([white[i][:k] for i in sorted(found)])).sum(axis=0))
    for i, r in found.items():
        assert r.n == n and int(r.deviation) == deviation[i]
        assert np.allclose(np.array(r.whitened) * signs, white[i][:k], rtol=1e-7, atol=1e-7) and np.allclose(r.explained, explained[:k], rtol=1e-9)
        assert r.identity_error < 1e-9


def test_equals_the_covariance(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, s) for s in (1, 0.7, 0.4, 0.2, 0.1, 0.05)] for _ in range(300)]
    vectors = base + base[:40] + [base[0]] * 200
    found = {r.vec_id: r for r in whiten(frame(spark, vectors).repartition(37)).collect()}  # more partitions than a merge takes
    check(found, plain(dict(enumerate(vectors)), 256), 4)
    assert found[0].n == 300


def test_large_integers_stay_exact(spark):
    vectors = [[rng * 3e9, (rng * 7 % 11) * 1e9 + 1, float(rng % 3)] for rng in range(40)]
    found = {r.vec_id: r for r in whiten(frame(spark, vectors), components=2).collect()}
    n, deviation, _, _ = plain(dict(enumerate(vectors)), 256)
    assert all(int(r.deviation) == deviation[i] for i, r in found.items())


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], [2.0, 1.0], [0.5, -0.0], None, [1.0, None], [nan, 1.0], [inf, 0.0], [1.0], [], [1.0, 2.0]]
    found = whiten(frame(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, 8, None])).collect()
    assert sorted(r.vec_id for r in found if r.vec_id is not None) == [0, 1, 2] and len(found) == 4
    assert {r.n for r in found} == {3} and all(len(r.whitened) == len(r.explained) == 2 for r in found)


def test_nothing_varies(spark):
    found = whiten(frame(spark, [[1.0, 2.0, 3.0]] * 5)).collect()
    assert len(found) == 5 and all((r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) == (1, 0, [], [], 0.0) for r in found)
    line = whiten(frame(spark, [[float(i), 2.0 * i] for i in range(9)]), scale=1.0).collect()
    assert all(len(r.whitened) == 1 and abs(r.explained[0] - 1) < 1e-12 for r in line)
    for empty in ([], [None], [[]]):
        assert whiten(frame(spark, empty)).collect() == []


def test_registered_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.1, (200, 6)) * np.arange(1, 7)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)] + [(500, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["op13_whitening"](spark, str(tmp_path)).collect()
    n, deviation, white, explained = plain({i: v for i, v in rows if v}, 256)
    assert len(found) == 800 and {r.component for r in found} == {1, 2, 3, 4}
    for k in range(1, 5):
        mine = {r.vec_id: r for r in found if r.component == k}
        sign = np.sign(sum(r.whitened * white[i][k - 1] for i, r in mine.items()))
        for i, r in mine.items():
            assert (r.n, r.deviation) == (n, deviation[i]) and r.identity_error < 1e-9
            assert r.whitened * sign == pytest.approx(white[i][k - 1], abs=1e-7) and r.explained == pytest.approx(explained[k - 1], rel=1e-9)
