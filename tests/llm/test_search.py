import numpy as np
from pyspark.sql import functions as F

from folioscope.llm.vector_search import Grid, _kth, scan, top_k


def plain(rows, k, asks):
    ok = [(i, [int(np.floor(64.0 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if asks(i):
            scored = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q)))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_bounds_hold_and_scans_lose_no_result():
    rng = np.random.default_rng(1)
    for spread in (60, 10**6):
        vectors = rng.integers(-spread, spread, (500, 7))
        vectors[100:300] = vectors[100]  # a very common vector: ties
        ids, grid = rng.permutation(500), Grid(vectors.min(axis=0), vectors.max(axis=0))
        cells = grid.codes(vectors)
        corner, least, most = grid.bounds(vectors[:40], cells)
        score = vectors[:40] @ vectors.T
        assert (corner + least[:, None] <= score).all() and (score <= corner + most[:, None]).all()
        sure = np.array(_kth(ids[:40].tolist(), list(vectors[:40]), [(int(i), v) for i, v in zip(ids[:60], vectors[:60])], 20))
        at, who, _ = scan(ids[:40], vectors[:40], sure, ids, cells, grid, 20)
        for q in range(40):
            want = sorted((-int(score[q, j]), int(ids[j])) for j in range(500) if ids[j] != ids[q])[:20]
            assert {i for _, i in want} <= set(ids[who[at == q]].tolist()) and ids[q] not in ids[who[at == q]]


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(3)
    vectors = np.floor(64 * rng.normal(size=(20_000, 16))).astype(np.int64)
    grid, ids = Grid(vectors.min(axis=0), vectors.max(axis=0)), np.arange(20_000)
    sure = np.array(_kth(ids[:50].tolist(), list(vectors[:50]), [(i, vectors[i]) for i in range(2000)], 20))
    at, _, _ = scan(ids[:50], vectors[:50], sure, ids, grid.codes(vectors), grid, 20)
    assert len(at) < 0.02 * 50 * 20_000


def test_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(400 + i, rows[8][1]) for i in range(60)]  # many equal vectors
    rows += [(None, [1.0] * 6), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [0.5] * 3), (306, [0.5] * 3), (308, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("dim", F.lit(2))
    found = top_k(df, F.col("vec_id") % 4 == 0, k=5, block=30, query_block=10).collect()
    want = plain(rows, 5, lambda i: i % 4 == 0)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert top_k(df.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    twice = df.where("vec_id IN (1, 2, 3)").unionByName(df.where("vec_id = 2"))
    assert [(r.query_id, r.vec_id) for r in top_k(twice, F.col("vec_id") == 1, k=9).orderBy("rank").collect()].count((1, 2)) == 2
