"""Joins by similarity, order-dependent choices and dictionaries against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import plans
from folioscope.operators import dictionary
from folioscope.operators.greedy import leaders, survivors
from folioscope.operators.metric import close_pairs, comparisons
from folioscope.operators.setjoin import overlapping_sets, similar_sets

from .test_queries import SF


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def members(spark, sets, key="o"):
    return spark.createDataFrame([(i, m) for i, s in sets.items() for m in [*s, None] + list(s)[:1]], f"{key} long, m string")


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_similar_sets(spark, threshold):
    rng = random.Random(7)
    sets = {i: {f"m{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randint(0, 12))} for i in range(150)}
    sets |= {200 + i: {"same", "two"} for i in range(30)}
    want = {(a, b, len(x & y), len(x), len(y)) for a, x in sets.items() for b, y in sets.items() if a < b and x and len(x & y) >= threshold * len(x | y) - 1e-9}
    assert {tuple(r) for r in similar_sets(members(spark, sets), "o", "m", threshold).collect()} == want


def test_overlapping_sets(spark):
    rng = random.Random(8)
    make = lambda n: {i: {f"m{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(0, 15))} for i in range(n)}
    x, y = make(60), make(80)
    want = {(a, b, len(s & t)) for a, s in x.items() for b, t in y.items() if len(s & t) >= 3}
    found = overlapping_sets(members(spark, x), members(spark, y, "p"), "o", "p", "m", 3).collect()
    assert {(r.a, r.b, r.n_shared) for r in found} == want and len(found) == len(want)
    assert similar_sets(members(spark, {}), "o", "m", 0.5).count() == 0


def sequential_leaders(items, takes):
    leader = {}
    for i in sorted(items):
        if i not in leader:
            leader[i] = i
            for j in sorted(takes.get(i, ())):
                leader.setdefault(j, i)
    return leader


@pytest.mark.parametrize("seed", range(3))
def test_leaders_in_order(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([1, 12, 60])
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(n * 2)}  # of any direction, with loops
    takes = {}
    for a, b in pairs:
        takes.setdefault(a, set()).add(b)
    found = leaders(spark.range(n).withColumnRenamed("id", "x"), "x", spark.createDataFrame(sorted(pairs), "a long, b long")).collect()
    assert {r.x: r.leader for r in found} == sequential_leaders(range(n), takes) and len(found) == n


def sequential_survivors(cost, alike):
    keep = dict.fromkeys(cost, True)
    order = sorted(cost)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if keep[i] and keep[j] and (i, j) in alike:
                if cost[i] <= cost[j]:
                    keep[j] = False
                else:
                    keep[i] = False
    return {i for i in order if keep[i]}


@pytest.mark.parametrize("seed", range(4))
def test_survivors_in_order(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([2, 15, 40])
    cost = {i: rng.randrange(4) for i in range(n)}
    alike = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a != b}
    found = survivors(spark.createDataFrame(sorted(cost.items()), "x long, c long"), "x", "c", spark.createDataFrame(sorted(alike), "a long, b long"))
    assert {r.x for r in found.collect()} == sequential_survivors(cost, alike)


def test_distinct_names(spark):
    import re

    stem = lambda w: w.rstrip("es") if len(w) > 3 else w
    part = table(spark, "part")
    first = {}
    for key, name in sorted(zip(part["p_partkey"], part["p_name"] + " " + part["p_type"].str.lower())):
        first.setdefault(name, key)
    words = {k: {stem(w) for w in re.sub("[^a-z0-9 ]", " ", n.lower()).split()} for n, k in first.items()}
    alike = {(a, b) for a in words for b in words if a < b and len(words[a] & words[b]) >= 0.6 * len(words[a] | words[b])}
    want = sequential_survivors({k: len(n) for n, k in first.items()}, alike)
    found = plans.QUERIES["distinct_names"](spark, SF).collect()
    assert {r.place for r in found} == want and all(first[r.name] == r.place for r in found) and len(want) < len(first)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    letters = "abcdé 漢"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))) for i in range(120)] + [(500, None), (501, "")]
    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"a", "never inside", "漢"}
    want = {(i, n, t.index(n) + 1) for i, t in rows if t for n in names if n in t}
    return spark.createDataFrame(rows, "k long, t string"), spark.createDataFrame([(n,) for n in [*names, "", None, "a"]], "n string"), want


@pytest.mark.parametrize("size", [1 << 20, 0])
def test_names_inside_texts(texts, size):
    frame, names, want = texts
    found = dictionary.occurrences(frame, "k", "t", names, "n", sent_bytes=size).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_a_large_dictionary(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 10)))
    names = {word() for _ in range(100_000)}
    some = rng.sample(sorted(names), 50)
    rows = [(i, " ".join([word(), some[i % 50], word()])) for i in range(200)]
    want = {i: min((t.index(n), n) for n in names if n in t)[1] for i, t in rows[:40]}
    frame = spark.createDataFrame(rows, "k long, t string")
    known = spark.createDataFrame([(n,) for n in names], "n string").repartition(4)
    sent, met = ({r.k: r.name for r in dictionary.first_occurrence(frame, "k", "t", known, "n", size).collect()} for size in (1 << 24, 0))
    assert sent == met and len(sent) == 200 and {i: sent[i] for i in want} == want


def test_resolved_names(spark):
    names = spark.createDataFrame([("bert",), ("bert large",), ("gpt",), ("x",), (None,), ("",)], "name string")
    known = spark.createDataFrame([("bert",), ("bert large uncased",), ("a gpt",), (None,)], "known string")
    found = {r.name: (r.known, r.score) for r in dictionary.resolve_names(names, "name", known, "known").collect()}
    assert found == {"bert": ("bert", 1.0), "bert large": ("bert", 0.85), "gpt": ("a gpt", 0.85)}


@pytest.mark.parametrize("pivots", [1, 7, 60])
def test_pairs_in_range(spark, monkeypatch, pivots):
    from folioscope.operators import metric

    monkeypatch.setattr(metric, "CHUNK", 40)
    rng = np.random.default_rng(pivots)
    x = np.r_[rng.normal(0, 0.05, (150, 3)) + np.repeat(rng.normal(0, 1, (15, 3)), 10, axis=0), np.zeros((5, 3))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [float("nan"), 0.0, 0.0]), (None, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(i, j) for i, j in zip(*np.nonzero(apart <= 0.15)) if i < j}
    found = close_pairs(frame, "id", "v", 0.15, pivots=pivots).collect()
    assert {(r.a, r.b) for r in found} == want and len(found) == len(want)
    tasks = comparisons(frame, "id", "v", 0.15, pivots=pivots)
    most, compared = tasks.agg(F.max("rows"), F.sum("compared")).first()
    assert most < 160 and (pivots < 60 or compared < 155 * 154 / 2 / 5)
    assert close_pairs(frame.where("false"), "id", "v", 1.0).collect() == []


def test_limitation_clusters(spark):
    rows = table(spark, "embeddings").sort_values("vec_id")
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    apart = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    takes = {}
    for i in range(len(ids)):
        near = sorted((apart[i, j], ids[j]) for j in range(len(ids)) if j != i and apart[i, j] <= 0.7**0.5)[:9]
        takes[ids[i]] = {j for _, j in near}
    found = plans.QUERIES["limitation_clusters"](spark, SF).collect()
    assert {r.vec_id: r.leader for r in found} == sequential_leaders(ids, takes)
