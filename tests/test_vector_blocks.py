"""Similarity joins in blocks against every pair, with small blocks, ties, nulls and vectors that no pivot tells apart."""

from functools import reduce

import numpy as np
import pytest

from folioscope import plans
from folioscope.operators import blocks, metric, vectors as op

from .test_queries import SF


@pytest.fixture(scope="module")
def rows():
    x = np.random.default_rng(3).normal(size=(150, 16))
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True), 2)
    x[100:] = x[:50]
    return [(i, i % 2, [float(c) for c in v]) for i, v in enumerate(x)] + [(200, 0, None), (201, None, [1.0] * 16), (202, 1, [None] * 16), (None, 1, [1.0] * 16)]


@pytest.fixture
def frame(spark, rows, monkeypatch):
    monkeypatch.setattr(blocks, "VECTORS", 20)
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def score(x, y):
    return float(np.floor(sum((a * b for a, b in zip(x, y)), 0.0) * 1e6 + 0.5) / 1e6)


def no_pairs(found):
    """What meets in a group is folded by a task for each pair of blocks."""
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    return found.collect()


def test_similar_within(frame, rows):
    usable = rows[:150]
    want = {(g, a, b, score(x, y)) for a, g, x in usable for b, h, y in usable if g == h and a < b and score(x, y) >= 0.3}
    found = no_pairs(op.similar_within(frame, "label", 0.3))
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_knn_join(frame, rows):
    usable, want = rows[:150], []
    for a, g, x in usable:
        if a % 3 == 0:
            near = sorted((-score(x, y), b) for b, h, y in usable if b % 3 == 1 and g == h and score(x, y) >= 0.1)
            want += [(g, a, b, -s, n + 1) for n, (s, b) in enumerate(near[:3])]
    found = no_pairs(op.knn_join(frame.where("vec_id % 3 = 0"), frame.where("vec_id % 3 = 1"), "label", 3, 0.1))
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_close_pairs_where_no_pivot_prunes(frame, rows, monkeypatch):
    monkeypatch.setattr(metric, "CHUNK", 10)
    monkeypatch.setattr(metric, "CELL_ROWS", 5)
    used = []
    monkeypatch.setattr(metric, "_block_pairs", lambda *a, f=metric._block_pairs: used.append(1) or f(*a))
    x = np.array([r[2] for r in rows[:150]])
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j): far[i, j] for i in range(150) for j in range(i + 1, 150) if far[i, j] <= 1.1}
    found = metric.close_pairs(frame.where("vec_id < 150"), "vec_id", "embedding", 1.1).collect()
    assert used and {(r["a"], r["b"]) for r in found} == set(want) and len(found) == len(want)
    assert all(abs(r["distance"] - want[r["a"], r["b"]]) < 1e-12 for r in found)


def test_blocks_of_vectors_are_not_sent_again(frame, monkeypatch):
    monkeypatch.setattr(metric, "CHUNK", 10)
    monkeypatch.setattr(metric, "CELL_ROWS", 5)
    found = metric.close_pairs(frame.where("vec_id < 150"), "vec_id", "embedding", 1.1)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e6, 1e20])
def test_single_precision_loses_no_pair(scale):
    rng = np.random.default_rng(4)
    x, y = (rng.normal(size=(n, 16)) * scale for n in (700, 90))
    far = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    for radius in (far[5, 7], np.quantile(far, 0.3), far.min()):
        met = {(int(a), int(b)) for i, j in metric._may_be_near(x, y, radius) for a, b in zip(i, j)}
        near = {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= radius))}
        assert near <= met and len(met - near) <= 50


def test_pairs_in_range_join_no_vectors(spark):
    plan = plans.QUERIES["embedding_pairs_in_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 1  # the sizes of cells


@pytest.mark.parametrize("pivots", [None, 5])
def test_dots_are_those_of_both_ways(frame, rows, pivots):
    found = metric.close_pairs(frame.where("vec_id < 150"), "vec_id", "embedding", 1.1, pivots=pivots, dots=True).collect()
    # sum() of Python makes up for what is lost, which the score does not
    assert found and all(r["dot"] == reduce(lambda s, v: s + v[0] * v[1], zip(rows[r["a"]][2], rows[r["b"]][2]), 0.0) for r in found)
