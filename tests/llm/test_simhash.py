import random

import numpy as np
import xxhash

from folioscope.llm.graph import components
from folioscope.llm.simhash import _blocks, link_buckets, near_duplicates, simhash

from .cases import awkward, docs, extra


def plain(text, k=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprint_matches_its_definition():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("aB É\t\n xy") for _ in range(rng.randint(0, 60)))
        assert simhash(text) == plain(text)


def test_tree_finds_the_links_of_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [base]
    for _ in range(4):
        y = base.copy()
        for _ in range(3):
            y ^= np.uint64(1) << rng.integers(0, 64, len(base), dtype=np.uint64)
        near.append(y)
    dense = np.full(300, base[0])
    for _ in range(4):
        dense ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([*near, dense]))
    blocks = _blocks(4)
    b, p = np.repeat(np.arange(5), len(x)), np.tile(x, 5)
    s, w = np.repeat([a for a, _ in blocks], len(x)), np.repeat([n for _, n in blocks], len(x)).astype(np.uint64)
    v = ((p << s.astype(np.uint64)) >> (np.uint64(64) - w)).astype(np.int64)
    one, two = link_buckets(b, v, p, s, 4)
    at = {int(f): i for i, f in enumerate(x)}
    far = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    assert classes(len(x), [(at[int(i)], at[int(j)]) for i, j in zip(p[one], p[two])]) == classes(len(x), list(zip(*np.nonzero(np.triu(far, 1)))))


def test_components_take_the_smallest_node(spark):
    edges = [(5, 9), (9, 2), (2, 5), (7, 8), (8, 30), (1, 1)] + [(100 + i, 101 + i) for i in range(30)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {2: 2, 5: 2, 9: 2, 7: 7, 8: 7, 30: 7, **{100 + i: 100 for i in range(31)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_buckets_give_the_same_links(spark):
    from folioscope.llm.simhash import link_fingerprints

    rng = np.random.default_rng(5)
    prints = [int(x) for x in np.unique(rng.integers(0, 2**12, 300))]
    frame = spark.createDataFrame([(p, p) for p in prints], "fp long, rep long")
    whole = {tuple(sorted(r)) for r in components(link_fingerprints(frame)).collect()}
    split = {tuple(sorted(r)) for r in components(link_fingerprints(frame, bucket_rows=20)).collect()}
    assert whole == split


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = near_duplicates(extra(df)).collect()
    assert len(rows) == df.count()
    given = {(r.doc_id, plain(r.text)) for r in df.collect()}
    assert {(r.doc_id, r.fp & (2**64 - 1)) for r in rows} == given
    given = {(i, p) for i, p in given if i is not None}
    prints = sorted({p for _, p in given})
    roots = classes(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    for r in (r for r in rows if r.doc_id is not None):
        root = roots[prints.index(r.fp & (2**64 - 1))]
        assert r.component_id == min(i for i, p in given if roots[prints.index(p)] == root)
    assert near_duplicates(docs(spark, [])).count() == 0
