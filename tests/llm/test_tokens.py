import base64
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import token_store
from folioscope.llm.bpe import BytePairs, RankQueue, decode, encode
from folioscope.llm.common import in_share, sample_rows
from folioscope.llm.token_store import Encoder, read_document, read_tokens, write_tokens

from .cases import awkward, docs, extra

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def texts():
    rng = random.Random(1)
    letters = ["a", "B", "é", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "1", "22", "!", "...", "\x1c", "\xa0", "　", "漢字", "😀", "ß", "́", "_", "-", " a", ",", " the.", "the", ". ", " \n"]
    plain = [x for x in letters if x not in ("  ", "\x1c", "\xa0", "　", " \n")]
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in (letters, plain) for _ in range(700)]
    return made + ["a" * 3000, "ab" * 2000, " " * 300, "\n" * 50, "", " ", "a ", "\r\n x"]


def own():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoder_equals_the_library():
    library, made = Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE)
    given = [*texts(), "x <|endoftext|> y"]
    want = [np.array(e.ids, made.dtype).tobytes() for e in library.encode_batch(given, add_special_tokens=False)]
    assert made.encode_batch(given) == want
    assert made.encode_each(pa.array(given)) == want


def test_encoder_looks_plain_words_up_together(monkeypatch):
    monkeypatch.setattr(token_store, "CACHED", 30)  # so that words are dropped and come again
    library, made, rng = Tokenizer.from_file(BYTE_BPE), Encoder(BYTE_BPE), random.Random(4)
    for _ in range(30):
        given = [" ".join("".join(rng.choice("abcXY") for _ in range(rng.randint(1, 3))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 20))) for _ in range(8)]
        assert made.encode_each(pa.array(given)) == [np.array(e.ids, made.dtype).tobytes() for e in library.encode_batch(given, add_special_tokens=False)]
    assert not made.parts and len(made.words) == len(made.word_ids) == len(made.asked) < 250  # no word was looked up by itself


def test_bpe_equals_the_library():
    library, made = own(), BytePairs.load(RANKS, public_tokenizers.PATTERN)
    given = texts()
    want = [np.array(library.encode_ordinary(t), "<i4").tobytes() for t in given]
    assert made.encode_batch(given) == want
    ids, ends = made.encode_column(pa.array(given), np.dtype("<i4"))
    assert [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])] == want
    assert [made.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])] == [t.encode() for t in given]


def test_queue_gives_ranks_in_order():
    rng, q = random.Random(7), RankQueue(60_000)
    ranks = rng.sample(range(60_000), 500)
    for r in ranks:
        q.open(r, [r])
    assert [q.pop() for _ in ranks] == [(r, [r]) for r in sorted(ranks)] and not q.top and not any(q.leaf) and not any(q.middle)


def test_bpe_on_awkward_rows(spark):
    df = awkward(spark)
    found = decode(encode(extra(df), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    library = own()
    assert len(found) == df.count()
    for r in found:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert encode(docs(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_other_patterns_are_not_cut_at_spaces():
    pattern = r"\w+|\s+|[^\w\s]+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library, made = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), BytePairs.load(RANKS, pattern)
    given = texts()[::7] + ["he gazed at the  old mill, twice."]
    want = [library.encode_ordinary(t) for t in given]
    ids, ends = made.encode_column(pa.array(given), np.dtype("<i4"))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert made.encode_batch(given) == [np.array(x, "<i4").tobytes() for x in want]


def test_ids_and_bytes_outside_the_vocabulary_are_errors():
    made = BytePairs.load(RANKS, public_tokenizers.PATTERN)
    for ids in ([-1], [5, 60_000], [3, -7]):
        with pytest.raises(IndexError):
            made.decode(ids)
    with pytest.raises(KeyError):
        BytePairs({b"a": 0}, public_tokenizers.PATTERN).encode_batch(["ab"])


def test_shares_of_very_large_tables_are_not_empty(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "k")
    n = rows.where(in_share(1e-3, "k")).count()
    assert 100 < n < 320 and rows.where(in_share(1.0, "k")).count() == 200_000
    limits = [in_share(rows_wanted / total, "k")._jc.toString() for rows_wanted, total in ((1000, 5 * 10**10), (2000, 10**12))]
    assert all(int(re.findall(r"\d+", x)[-1]) > 10**9 for x in limits)  # a limit of 0 would choose nothing
    assert len(sample_rows(rows, 50, ["k"], total=10**12)) > 0  # none chosen by the hash: the lowest hashes
    same = spark.createDataFrame([(1, "x")] * 1000, "k int, t string")
    assert 0 < len(sample_rows(same, 10, ["k", "t"])) <= 20
    assert sample_rows(same.limit(0), 10, ["k"]) == []


def test_one_id_may_fill_several_shards(spark, tmp_path):
    rng = random.Random(2)
    given = [" ".join(str(rng.random()) for _ in range(3000)) for _ in range(60)]
    df = docs(spark, given, [None] * 30 + [5] * 30)
    store = write_tokens(df, BYTE_BPE, to=str(tmp_path / "s"), shard_mb=1)
    manifest = spark.read.parquet(f"{store}/manifest").orderBy("task", "seq").collect()
    assert len(manifest) > 2 and [r.first_id for r in manifest] == sorted(r.first_id for r in manifest)
    rows = read_tokens(spark, store).orderBy("start").collect()
    assert len(rows) == 60 and [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    assert len(read_document(spark, store, 5)) == 30


def test_store_round_trip(spark, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    given = [f"the {i} text of document number {i % 9}, and more." * (i % 5) for i in range(300)] + [None, "", "é" * 9000]
    df = extra(docs(spark, given, [3 * i for i in range(len(given))]))
    store = write_tokens(df, BYTE_BPE, to=str(tmp_path / "store"), sample=100, shard_mb=1)
    rows = read_tokens(spark, store).orderBy("doc_id").select("*", F.crc32("ids").alias("crc")).collect()
    at = 0
    for r, text in zip(rows, given):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [x.tolist() for x in read_document(spark, store, 30)] == [[*library.encode(given[10], add_special_tokens=False).ids, 2]]


def test_store_of_awkward_and_of_no_rows(spark, tmp_path):
    df = awkward(spark)
    rows = read_tokens(spark, write_tokens(df, BYTE_BPE, to=str(tmp_path / "a"))).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in df.collect())
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in rows)
    assert read_tokens(spark, write_tokens(docs(spark, []), BYTE_BPE, to=str(tmp_path / "b"))).count() == 0
