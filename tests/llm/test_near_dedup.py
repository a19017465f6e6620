import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import jaccard

from .cases import awkward, docs


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def test_near_copies_go_and_others_stay(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    line = [word() for _ in range(12)]
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([30, 60, 120, 300]))] + line
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.choice([1, 2, 4])):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), "one two", "one  two", "one two three", "", None, " \n"]
    found = pipeline.near_dedup(spark, docs(spark, texts), "")
    kept = {r.doc_id for r in found.collect()}
    sets = [shingles(t) for t in texts]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])}
    assert len([1 for i, j in links if sets[i] != sets[j]]) > 20
    assert not [p for p in links if kept.issuperset(p)]
    root = list(range(len(sets)))
    for i, j in sorted(links) * 3:
        root[i] = root[j] = min(root[i], root[j])
    assert all(root[i] < i for i in set(range(len(sets))) - kept)
    assert {i for i in range(len(sets)) if not any(i in p for p in links)} <= kept


def test_awkward_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = awkward(spark)
    ids = [r.doc_id for r in pipeline.near_dedup(spark, df, "").collect()]
    texts = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(map(str, texts)) == sorted(map(str, [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, df.repartition(7), "").collect()]))
    named = [x for x in texts if x[0] is not None]
    assert len(named) == len(set(named)) and ids.count(None) == 2
    assert {x for x in named if x[0] == 2} == {(2, None), (2, "another text with the id two")} and ids.count(1) == 1
    assert pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_large_families_meet_pivots_not_all_pairs(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(1, 9)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = jaccard._prints(docs(spark, texts), 5, np.zeros(0, np.uint64))
    rows = jaccard._shared(rows).cache()
    full, few = jaccard._candidates(rows), jaccard._candidates(rows, 4)
    assert few.count() < full.count() / 4
    left = sorted(set(range(150)) - {r.doc_id for r in jaccard.surplus(docs(spark, texts)).collect()})
    sets = [shingles(t) for t in texts]
    assert not [(i, j) for i in left for j in left if i < j and similar(sets[i], sets[j])]


def test_parities_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[x[: len(x) * 9 // 10], rng.integers(0, 2**63, 3).astype(np.uint64)]) for x in sets]
    bits = [jaccard.parity(x) for x in sets]
    order = rng.permutation(len(sets))
    i, j = rng.integers(0, len(sets), 3000), rng.integers(0, len(sets), 3000)
    n = np.array([len(sets[order[a]]) + len(sets[order[b]]) for a, b in zip(i, j)])
    found = jaccard.Parities(pa.array(bits, pa.binary()), order).may_share(i, j, n)
    assert found.tolist() == [jaccard._may_share(bits[order[a]], bits[order[b]], k) for a, b, k in zip(i, j, n.tolist())]
