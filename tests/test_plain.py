"""Queries that SQL can't say, against plain loops over the same tables."""

import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from folioscope import plans
from folioscope.functions.text import STOP_TOKENS

from .test_queries import SF


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").toPandas()


def found(spark, name):
    return plans.QUERIES[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = table(spark, "embeddings").sort_values("vec_id")
    return [(label, own["vec_id"].to_numpy(), np.stack(own["embedding"].to_numpy()).astype(float)) for label, own in rows.groupby("label")]


def test_greedy_clusters(spark, vectors):
    want = {}
    for _, ids, x in vectors:
        near = np.floor(x @ x.T * 1e6 + 0.5) / 1e6 >= 0.2
        for i, one in enumerate(ids):
            if one not in want:
                want[one] = one
                for other in ids[near[i]]:
                    want.setdefault(other, one)
    got = found(spark, "greedy_clusters")
    assert dict(zip(got["vec_id"], got["leader"])) == want


def test_mmr_select(spark, vectors):
    want = []
    for label, ids, x in vectors:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        picked = []
        while len(picked) < min(15, len(ids)):
            worth = [(0.7 * (ids[i] % 11) / 11.0 - 0.3 * max([0.0, *(float(unit[i] @ unit[j]) for j in picked)]), -i) for i in range(len(ids)) if i not in picked]
            picked.append(-max(worth)[1])
        want += [(label, ids[i], n + 1) for n, i in enumerate(picked)]
    got = found(spark, "mmr_select")
    assert sorted(zip(got["label"], got["vec_id"], got["rank"])) == sorted(want)


def test_hash_embedding(spark):
    texts = table(spark, "documents").set_index("doc_id")["text"]
    for doc, vector in found(spark, "hash_embedding").set_index("doc_id")["embedding"].items():
        want = np.zeros(16)
        for word in re.findall(r"[^\W_]+", (texts[doc] or "").lower()):
            digest = xxhash.xxh64_intdigest(word.encode(), 42)
            slot = (digest - (1 << 64) if digest >> 63 else digest) % 32
            want[slot % 16] += 1 if slot < 16 else -1
        if texts[doc]:
            assert np.allclose(vector, want / max(np.linalg.norm(want), 1e-12), atol=2e-6)


def test_complement_signals(spark):
    words = lambda text: set(re.findall(r"\b[a-z][a-z0-9\-]{2,}\b", (text or "").lower())) - set(STOP_TOKENS)
    docs, claims = ({r[0]: words(r[1]) for r in table(spark, name)[[key, "text"]].itertuples(index=False)} for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {(d, c): len(x & y) for d, x in docs.items() for c, y in claims.items() if len(x & y) >= 3}
    got = found(spark, "complement_signals")
    assert dict(zip(zip(got["doc_id"], got["item_id"]), got["n_shared"])) == want and len(got) == 2 * len(want)
    scarce = lambda t: any(w in t.lower() for w in ("memory", "edge", "mobile", "resource", "parameter", "compute", "lightweight"))
    saves = lambda t: re.search(r"quantiz|4-bit|8-bit|int8|\bprun(?:ing|ed)\b|distillation|distilled|knowledge[\s-]?distill", t.lower()) is not None
    texts = {name: {r[0]: r[1] or "" for r in table(spark, name)[[key, "text"]].itertuples(index=False)} for name, key in (("documents", "doc_id"), ("benchmark", "item_id"))}
    for r in got.itertuples():
        doc, item = texts["documents"][r.doc_id], texts["benchmark"][r.item_id]
        said, answer = (doc, item) if r.direction == "document to passage" else (item, doc)
        assert r.confidence == (0.9 if scarce(said) and saves(answer) else 0.65)


def test_sentence_windows(spark):
    want = []
    for doc, text in table(spark, "documents")[["doc_id", "text"]].itertuples(index=False):
        now, n = [], 0
        windows = []
        for s in [s for s in re.split(r"(?<=[.!?])\s+", text or "", flags=re.A) if s.strip(" ")]:
            size = len(re.split(r"\s+", s.strip(" "), flags=re.A))
            if now and n + size > 120:
                windows.append(now)
                kept = now[-2:]
                kept_size = sum(len(re.split(r"\s+", k.strip(" "), flags=re.A)) for k in kept)
                now, n = (kept, kept_size) if kept_size + size <= 120 else ([], 0)
            now, n = now + [s], n + size
        want += [(doc, i, len(w), " ".join(w)) for i, w in enumerate(windows + ([now] if now else []))]
    got = found(spark, "sentence_windows")
    assert sorted(got[["doc_id", "window", "n_sentences", "text"]].itertuples(index=False, name=None)) == sorted(want)


def test_stream_dedup_has_each_key_of_each_stretch(spark):
    events, got = table(spark, "events"), found(spark, "stream_dedup")
    keys = lambda frame: set(zip(frame["user_id"], frame["event_type"]))
    assert keys(got) == keys(events)
    assert not got.duplicated(["user_id", "event_type", "ts"]).any()
