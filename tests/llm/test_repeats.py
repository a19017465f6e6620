import random

import numpy as np
import pytest

from folioscope.llm.repeats import merge_spans
from folioscope.llm.substring import deduplicate_words
from folioscope.llm.suffix_array import deduplicate_bytes, sort_suffixes

from .cases import awkward, docs, extra


def brute(rows, length, units):
    """Spans by a plain pass over documents in id order."""
    seen, out = set(), {}
    for i, text in rows:
        u, spans = units(text or ""), []
        for a in range(len(u) - length + 1):
            window = tuple(u[a : a + length])
            if window in seen:
                spans.append((a, a + length))
            seen.add(window)
        out[i] = merge_spans(spans)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["é", "漢字", "zz."]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(25, 60))) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(2)]
        parts.insert(1, rng.choice(passages)[rng.randint(0, 9) :])
        texts.append(rng.choice([" ", "\n"]).join(parts))
    return texts + ["ab" * 300, "ab" * 200, "", None, texts[0], "a" * 700]


BYTES, WORDS = (deduplicate_bytes, lambda t: t.encode()), (deduplicate_words, lambda t: t.encode().split())


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3), (3, 0), (4, 1)])
@pytest.mark.parametrize("which,length", [(BYTES, 100), (BYTES, 40), (WORDS, 20), (WORDS, 9)])
def test_against_a_plain_pass(spark, seed, hot, which, length):
    operator, units = which
    texts = corpus(seed)
    rows = operator(docs(spark, texts), length=length, hot=hot).collect()
    want = brute(list(enumerate(texts)), length, units)
    assert {r.doc_id: [tuple(s) for s in r.spans] for r in rows} == want
    for r in rows:
        u = units(texts[r.doc_id] or "")
        gone = {i for a, b in want[r.doc_id] for i in range(a, b)}
        left = [x for i, x in enumerate(u) if i not in gone]
        assert bytes(r.kept) == bytes(left) if operator is deduplicate_bytes else r.kept == b" ".join(left).decode()


@pytest.mark.parametrize("which,length", [(BYTES, 100), (WORDS, 20)])
def test_awkward_rows(spark, which, length):
    operator, units = which
    df = awkward(spark)
    rows = operator(extra(df), length=length).collect()
    assert len(rows) == df.count()
    assert operator(docs(spark, []), length=length).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5].text == "x" * 5000 and by_id[5].key == 1
    assert all(r.text is None for r in rows if r.doc_id == 2 and r.text is None)
    one = [r for r in rows if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1] and not one[0].spans  # one document given twice
    assert by_id[9].spans and not by_id[7].spans


def test_suffixes_sort_by_their_first_bytes():
    rng = random.Random(3)
    for trial in range(150):
        n = rng.randint(1, 300)
        text = bytes(rng.choice(b"abAB\x00\xff" if trial % 2 else b"ab") for _ in range(n))
        wanted = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        depth = rng.choice([8, 16, 40, 100])
        ranked = sort_suffixes(np.frombuffer(text, np.uint8), wanted, depth)
        keys = [(text[i : i + depth] + b"\0" * depth)[:depth] for i in ranked]
        assert sorted(ranked.tolist()) == wanted.tolist() and keys == sorted(keys)
