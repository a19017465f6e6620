"""Every registered query of the subpackage on a small folder of tables, against SQL, a library or a plain computation."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from folioscope.llm import pii, quality_crf
from folioscope.llm.queries import ORACLES, QUERIES
from tests.test_queries import rows

from .cases import docs
from .test_packing_and_pipeline import check
from .test_packing_and_pipeline import plain as plain_bins
from .test_pii import plain as patterns
from .test_quality import labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    texts, labels = labelled(150)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [t + f"\nline {i} by u{i}@mail.example.com and 10.1.{i % 200}.7, order 1234567890123452" for i, t in enumerate(texts)]
    texts += [f"{' '.join(rng.choice(words) for _ in range(rng.randint(0, 30)))} {passage} {i}" for i in range(20)] + texts[:5] + ["", None, "é 漢字 ß", "x" * 4000, "a b c", "  \n "]
    frame = docs(spark, texts)
    frame.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(40)] + [(300, None), (301, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def given(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def result(spark, folder, name):
    found = QUERIES[name](spark, folder).collect()
    return found, {r.doc_id: r for r in found}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op11_periodic_runs"}))  # its null longs turn to floats in pandas; test_runs.py has it
def test_equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    assert len(found) and sorted(found.columns) == sorted(want.columns) and rows(found) == rows(want)


def test_op1_fingerprints_and_components(spark, folder, given):
    def fingerprint(text):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fingerprint(t) for i, t in given.items()}
    root = {i: i for i in prints}
    for _ in range(len(prints)):
        before = dict(root)
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
        if root == before:
            break
    _, found = result(spark, folder, "op1_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op2_ids_of_the_library(spark, folder, given):
    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    _, found = result(spark, folder, "op2_token_store")
    assert found.keys() == given.keys()
    for i in sorted(given):
        ids = [*library.encode(given[i], add_special_tokens=False).ids, 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_op6_scores_of_the_field(spark, folder, given):
    tables = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")]
    model = quality_crf.fit(*tables)
    labels = {r.doc_id: r.quality for r in tables[1].collect()}
    _, found = result(spark, folder, "op6_quality_crf")
    assert found.keys() == given.keys()
    score = dict(zip(given, model.score(list(given.values()))))
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and abs(r.score - score[i]) < 1e-9 and r.predicted == (r.score >= 0.3)
    assert np.mean([found[i].predicted == labels[i] for i in labels if found[i].held_out]) > 0.9


def test_op7_base_spans_and_added_ones(spark, folder, given):
    _, found = result(spark, folder, "op7_pii")
    assert found.keys() == given.keys()
    for i, r in found.items():
        base = patterns(given[i])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(",")) | {""}
        assert spans == sorted(spans, key=lambda s: (int(s[1]), pii.LABELS.index(s[0])))


def test_op9_bins(spark, folder, given):
    found, _ = result(spark, folder, "op9_packing")
    components = {r.doc_id: r.component_id for r in QUERIES["op1_simhash"](spark, folder).collect()}
    check(found, 2048, 4)
    total = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.size
        assert r.cluster_id == components[r.doc_id]
    assert total == {i: len(t.encode().split()) for i, t in given.items()}
    shards = {}
    for r in found:
        shards.setdefault(r.bin_id >> 32, {}).setdefault(r.doc_id, []).append(r)
    for members in shards.values():  # every last piece is in the tightest bin that may take it
        last = [max(pieces, key=lambda r: r.piece) for _, pieces in sorted(members.items(), key=lambda x: (-sum(r.size for r in x[1]), x[0]))]
        left, n_bins = plain_bins([r.size for r in last], [r.source for r in last], [r.cluster_id for r in last], 2048, 4)
        assert [2048 - r.bin_offset - r.size for r in last] == left and len({r.bin_id for r in last}) == n_bins


def test_op10_ids_of_the_library(spark, folder, given):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, found = result(spark, folder, "op10_byte_bpe")
    assert found.keys() == given.keys()
    for i, r in found.items():
        ids = library.encode_ordinary(given[i])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(given[i].encode()).hexdigest()
