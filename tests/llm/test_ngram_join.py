"""The partitioned join against all pairs: that similar sets meet whatever the allocation, and components on awkward tables."""

import random

import numpy as np
import pytest

from folioscope.llm import ngram_join
from folioscope.llm.ngram_join import DELETED, PROBE, Allocation, all_keys, bands, near_duplicate_sets, segments

from .cases import awkward, docs, extra


def meet(x, y, allocation):
    """Whether the two sets have a key in common that may bring them together."""
    at, key, flags = all_keys([x, y], allocation)
    mine = {(k, f) for k, f in zip(key[at == 0].tolist(), flags[at == 0].tolist())}
    by = {}
    for k, f in mine:
        by.setdefault(k, []).append(f)
    return any(f & g == 0 for k, g in zip(key[at == 1].tolist(), flags[at == 1].tolist()) for f in by.get(k, ()))


def similar(x, y):
    both = len(np.intersect1d(x, y))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def test_bands_hold_what_is_similar():
    high = bands(5000)
    most, count = segments(high)
    for n in range(1, 5000):
        band = int(np.searchsorted(high, n))
        smallest = -(-4 * n // 5)
        assert int(np.searchsorted(high, smallest)) >= band - 1 and most[band] >= n // 4 and count[band] > most[band]


@pytest.mark.parametrize("seed", range(4))
def test_similar_sets_always_meet(seed):
    rng = np.random.default_rng(seed)
    met = 0
    for turn in range(1500):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 9, 14, 30, 80, 200]))
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        gone, new = rng.integers(0, n // 5 + 2), rng.integers(0, n // 4 + 2)
        y = np.unique(np.r_[rng.permutation(x)[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
        if not len(y) or not similar(x, y):
            continue
        allocation = Allocation()
        if turn % 3:  # any allocation, sensible or not
            codes = np.array([b << 32 | s for b in range(40) for s in range(60)])
            pick = rng.random(len(codes))
            allocation = Allocation(codes[pick < 0.3], codes[pick > 0.6])
        met += 1
        assert meet(x, y, allocation), (n, gone, new)
    assert met > 300


def test_unlike_sets_seldom_meet():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 10, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 2**63, 190, dtype=np.uint64)]) for _ in range(60)]
    assert sum(meet(x, y, Allocation()) for i, x in enumerate(sets) for y in sets[:i]) < 180
    assert DELETED & PROBE == 0


def plain(texts):
    """n and component of each (id, text), by all pairs."""
    sets = []
    for _, t in texts:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in texts if i is not None}
    links = [(texts[i][0], texts[j][0]) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    links = [(a, b) for a, b in links if a is not None and b is not None]
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            return [(i, len(s), None if i is None else root[i]) for (i, _), s in zip(texts, sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    license_line = " ".join(f"lic{i}" for i in range(25))
    out = []
    for _ in range(12):  # families of near copies, from barely similar to equal
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            out.append(text.title() if rng.random() < 0.2 else text)
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) + " " + license_line for _ in range(40)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small):
    if small:  # buckets are cut into slices, keys into chunks, and the sample has few sets
        monkeypatch.setattr(ngram_join, "BUCKET_KEYS", 64)
        monkeypatch.setattr(ngram_join, "CHUNK", 2)
        monkeypatch.setattr(ngram_join, "SAMPLE_SETS", 10)
    texts = corpus(3)
    ids = random.Random(1).sample(range(10_000), len(texts))
    found = near_duplicate_sets(docs(spark, texts, ids).repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(plain(list(zip(ids, texts))))


def test_awkward_rows(spark):
    given = awkward(spark)
    found = near_duplicate_sets(extra(given)).collect()
    order = lambda rows: sorted(rows, key=lambda r: [(x is not None, x or 0) for x in r])
    assert order(map(tuple, found)) == order(plain([(r.doc_id, r.text) for r in given.collect()]))
    assert near_duplicate_sets(given.where("false")).collect() == []


def test_one_group_holds_a_third_of_all_rows(spark):
    texts = ["same words in every one of these many copies"] * 60 + [" ".join(f"c{i}" if i != k else "changed" for i in range(100)) for k in range(40)] + [f"t{i} u{i} v{i} x{i} y{i} z{i}" for i in range(80)]
    found = near_duplicate_sets(docs(spark, texts)).collect()
    assert sorted(map(tuple, found)) == sorted(plain(list(enumerate(texts))))


def test_packed_integers():
    for values in ([0], [-(2**63), 2**63 - 1], [5, 300, 5], [2**40, 2**40 + 70_000], [-3, -1, -3]):
        assert ngram_join._wide(ngram_join._narrow(np.array(values, np.int64))).tolist() == values


def test_costly_segments_are_left_out(spark):
    line = " ".join(f"lic{i}" for i in range(12))
    texts = [" ".join(f"d{k}x{i}" for i in range(24)) + " " + line for k in range(300)]
    allocation = ngram_join.allocate(docs(spark, texts).select("doc_id", "text"), len(texts), 5, sample=200)
    assert len(allocation.none) == len(allocation.twice) and not set(allocation.none) & set(allocation.twice)
