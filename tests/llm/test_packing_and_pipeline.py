import random

import pytest

from folioscope.llm.packing import best_fit, pack

from .cases import awkward, docs, extra


def plain(sizes, sources, clusters, capacity, per_source):
    """Best fit decreasing by looking at every bin."""
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in bins if b["left"] >= sizes[i] and clusters[i] not in b["c"] and b["s"].count(sources[i]) < per_source]
        b = min(fits, key=lambda b: (b["left"], b["since"]), default=None)  # of equally tight bins, the one that has been so longest
        if b is None:
            b = {"left": capacity, "c": set(), "s": [], "since": len([x for x in out if x is not None])}
            bins.append(b)
        if sizes[i]:
            b["since"] = len([x for x in out if x is not None])
        b["left"] -= sizes[i]
        b["c"].add(clusters[i])
        b["s"].append(sources[i])
        out[i] = b["left"]
    return out, len(bins)


def test_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(30):
        n = rng.randint(0, 60)
        sizes, sources, clusters = [rng.randint(0, 40) for _ in range(n)], [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 25) for _ in range(n)]
        placed = pack(sizes, sources, clusters, 50, 2)
        want, n_bins = plain(sizes, sources, clusters, 50, 2)
        assert [50 - at - s for (_, at), s in zip(placed, sizes)] == want
        assert len({b for b, _ in placed}) == n_bins


def check(rows, capacity, per_source):
    bins, whole = {}, {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
        whole.setdefault((r.doc_id, r.cluster_id), []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r.bin_offset, r.size)):
            assert r.bin_offset >= at
            at = r.bin_offset + r.size
        assert at <= capacity
        assert len({r.cluster_id for r in members}) == len(members)
        assert all(sum(x.source == r.source for x in members) <= per_source for r in members)


def test_bins_hold_what_they_may(spark):
    rng = random.Random(1)
    texts = [" ".join(str(rng.random()) for _ in range(rng.choice([0, 3, 40, 90, 250]))) for _ in range(300)] + ["same words here"] * 100
    rows = best_fit(extra(docs(spark, texts)), capacity=100, per_source=3).collect()
    check(rows, 100, 3)
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
    assert total == {i: len(t.split()) for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = best_fit(extra(df), capacity=20).collect()
    check(rows, 20, 4)
    assert len([r for r in rows if r.piece == 0]) == df.count()
    assert best_fit(df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from .test_quality import labelled

    texts, labels = labelled(300)
    texts = [t + f"\nUnique line number {i} of this very document, write to u{i}@mail.example.com." for i, t in enumerate(texts)]
    passage = " ".join(f"{a}{b}ing" for a in "bcdfghklm" for b in ("am", "on", "ur", "est", "ill", "ent")) + " all night."
    texts += [texts[4], None, "", f"Shared passage {passage}", f"Other head {passage}"]
    base = docs(spark, texts).unionByName(docs(spark, ["The row that has no id stays where it is."], [None])).unionByName(docs(spark, [texts[1]], [1]))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        state.write.parquet(path := str(tmp_path / name.replace(" ", "_")))
        state = spark.read.parquet(path)
        kept[name] = {r.doc_id: r.text for r in state.collect()}
        assert all(r.n_chars == len(r.text) for r in state.collect() if r.text is not None)
    bad = [i for i in range(300) if not labels[i]]
    assert len([i for i in bad if i in kept["quality classifier"]]) < 0.1 * len(bad)
    assert 304 not in kept["SimHash near-dedup"] or 4 in kept["SimHash near-dedup"]
    assert sum(r == 1 for r in kept["SimHash near-dedup"]) <= 1
    shared = [t for t in kept["suffix-array dedup"].values() if t and "hesting" in t]
    assert len(shared) == 1
    assert not any("@mail" in (t or "") for t in kept["PII"].values()) and any("[EMAIL]" in (t or "") for t in kept["PII"].values())
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(kept["PII"])
