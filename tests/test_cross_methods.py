"""Methods of one paper of a pair that were never tried on datasets of the other, against plain loops."""

import random

from pyspark.sql import functions as F

from folioscope.functions.text import method_class
from folioscope.plans import gap_queries


def test_methods_are_counted_in_the_row_of_a_pair(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([*range(20), None]), rng.choice([f"lstm {rng.randrange(12)}", f"big net {rng.randrange(12)}", "y", "alone", None]), rng.choice(["t1", "t2", "t3", None]), rng.choice([*"abcdef", None])) for _ in range(60)] + [(50, "only lstm", "t1", None)]
    pairs = [(i, i + 1) for i in range(19)] + [(50, 3), (3, 50), (4, 4)]

    def fail(*_):
        raise AssertionError("every method meets every dataset")

    monkeypatch.setattr(gap_queries, "cooccurrence", fail, raising=False)
    frame = spark.createDataFrame(rows, "paper_id long, method string, task string, dataset string")
    kind = {r.m: r.c for r in frame.select(F.col("method").alias("m"), method_class(F.col("method")).alias("c")).distinct().collect() if r.m}
    of = lambda paper, i: {r[i] for r in rows if r[0] == paper and r[i] is not None}
    seen = {(m, d) for p in {r[0] for r in rows} - {None} for m in of(p, 1) for d in of(p, 3)}
    want = {}
    for a, b in {*pairs, *((b, a) for a, b in pairs)}:
        for m in of(a, 1):
            left = sum((m, d) not in seen for d in of(b, 3))
            if left and kind[m] != "NOT_METHOD" and of(a, 2) & of(b, 2):
                want[m, a, b] = (len(of(a, 2) & of(b, 2)), left)
    found = gap_queries.cross_paper_methods(spark.createDataFrame(pairs, "paper_a long, paper_b long"), frame, method_class).collect()
    assert {(r.method, r.paper_a, r.paper_b): (r.n_shared, r.n_missing) for r in found} == want and len(found) == len(want) > 5
