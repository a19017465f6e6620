"""The closest pairs of owners, against all pairs, whether equal sets are enough or not."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import entities as op


@pytest.mark.parametrize("most", [2, 9])
def test_closest_pairs(spark, monkeypatch, most):
    rng = random.Random(most)
    sets = {i: {rng.randrange(12) for _ in range(rng.randint(1, most))} for i in range(90)}
    rows = spark.createDataFrame([(i, m) for i, s in sets.items() for m in [*s, None]] + [(None, 1)], "o long, m long")
    want = sorted((-len(x & y) / len(x | y), a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y)[:20]
    if most == 2:
        assert want[-1][0] == -1

        def fail(*_):
            raise AssertionError("all pairs with a shared member are formed")

        monkeypatch.setattr(op, "overlap_pairs", fail)
    found = op.closest_pairs(rows, "o", "m", 20).orderBy(F.col("jaccard").desc(), "a", "b").collect()
    assert [(-r.jaccard, r.a, r.b, r.n_shared) for r in found] == want
