import re
import zlib

import numpy as np

from folioscope.llm.quality_crf import WIDTH, LineModel, _forward_backward, classify, fit, line_features, line_labels, read_lines, train, with_neighbours
from folioscope.llm.quality_rules import quality_rules

from .cases import awkward, docs, extra

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = SPACE.findall(text or "")
    grams = {}
    for i in range(len(words) - 7):
        grams.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_rules_measure_as_defined(spark):
    line = "the quick brown fox jumps over the lazy dog and runs away"
    given = ["\n".join([line] * 3), "a b c d e f g h a b c d e f g h", " \x0b".join(str(i) for i in range(100)) + " #|<>", "w " * 9, "x\n\nx\n \ny\nx", "é ß　z" * 30]
    df = extra(docs(spark, given)).unionByName(extra(awkward(spark).selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars")))
    found = quality_rules(df).collect()
    assert len(found) == df.count()
    texts = sorted((plain(r.text) for r in df.collect()))
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == texts
    assert not any(r.kept for r in found if r.base_failed)
    assert quality_rules(df.limit(0)).count() == 0


def test_rules_run_without_user_functions(spark):
    plan = quality_rules(docs(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    stay = np.array([0.7, -0.4, -0.9, 0.5])
    chains = [rng.normal(size=n) for n in (1, 4, 2, 5)]
    found, _ = _forward_backward(chains, stay)
    for e, p in zip(chains, found):
        total, good = 0.0, np.zeros(len(e))
        for y in np.ndindex(*[2] * len(e)):
            w = np.exp(sum(a * b for a, b in zip(y, e)) + sum(stay[2 * a + b] for a, b in zip(y, y[1:])))
            total += w
            good += w * np.array(y)
        assert np.allclose(p, good / total)


def labelled(n=400):
    clean = ["The quiet river runs past the old mill and into the sea.", "She wrote a long letter about the summer they had spent there.", "Rain fell on the roof all night, and nobody slept."]
    junk = ["BUY!! NOW!! BEST!! DEAL!!", "spam spam spam spam spam spam spam", "a### b*** c%%% d$$$ e&&&"]
    rng = np.random.default_rng(1)
    texts = ["\n".join(rng.choice(clean if i % 3 else junk, rng.integers(2, 6))) for i in range(n)]
    return texts, [int(i % 3 > 0) for i in range(n)]


def test_classifier_on_held_out_rows(spark):
    texts, labels = labelled()
    df = docs(spark, texts)
    marks = spark.createDataFrame(list(enumerate(labels)) + [(None, 1), (7, None)], "doc_id long, quality int")
    found = classify(extra(df), fit(df, marks)).select("doc_id", "quality_score", "quality_predicted").collect()
    out = [(r.quality_predicted, labels[r.doc_id]) for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(out) > 50 and np.mean([a == b for a, b in out]) > 0.97
    assert all(0 <= r.quality_score <= 1 and r.quality_predicted == (r.quality_score >= 0.3) for r in found)


def test_lines_of_one_document_get_labels_of_their_own():
    texts, labels = labelled()
    model = train(texts, labels)
    good, bad = texts[1].split("\n")[:1] * 1 + ["Rain fell on the roof all night, and nobody slept.", "She wrote a long letter about the summer they had spent there."], ["BUY!! NOW!! BEST!! DEAL!!", "spam spam spam spam spam spam spam", "a### b*** c%%% d$$$ e&&&"]
    for lines, want in ((good + bad, [1, 1, 1, 0, 0, 0]), (bad + good, [0, 0, 0, 1, 1, 1])):
        (p,) = model.marginals([with_neighbours(line_features(lines))])
        assert sum((p >= 0.5) == want) >= 5 and p[np.array(want) == 1].min() > p[np.array(want) == 0].max()
    assert (np.abs(model.stay) < 8).all() and model.stay[1:3].sum() < model.stay[0] + model.stay[3]


def test_at_least_half_of_a_bad_document_is_bad():
    assert line_labels(np.array([0.9, 0.8, 0.1]), np.array([10, 10, 10])).tolist() == [1, 0, 0]
    assert line_labels(np.array([0.9]), np.array([4])).tolist() == [0]
    assert line_labels(np.array([0.2, 0.3, 0.4]), np.array([1, 1, 1])).tolist() == [0, 0, 0]


def test_score_matches_enumeration_of_all_labellings():
    texts, labels = labelled(60)
    model = train(texts, labels, rounds=10)
    given = [*texts[:12], "one line only", "a\n\n b \nBUY!! NOW!!"]
    for text, score in zip(given, model.score(given)):
        lines = read_lines(text)
        e = with_neighbours(line_features(lines)) @ model.weights
        total, good = 0.0, np.zeros(len(e))
        for y in np.ndindex(*[2] * len(e)):
            w = np.exp(np.dot(y, e) + sum(model.stay[2 * a + b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        q = np.dot(good / total, list(map(len, lines))) / sum(map(len, lines))
        assert np.isclose(score, 1 / (1 + np.exp(-(model.curve[0] * q + model.curve[1]))))


def test_the_sample_is_never_empty(spark):
    texts, labels = labelled(200)
    model = fit(docs(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"), rows=1)
    assert model.prior in (0.0, 1.0) or model.weights.any()


def test_classifier_reads_no_held_out_label(spark):
    texts, labels = labelled(200)
    df = docs(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    one = fit(df, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"))
    two = fit(df, spark.createDataFrame([(i, 1 - v if h else v) for i, (v, h) in enumerate(zip(labels, held))], "doc_id long, quality int"))
    assert np.array_equal(one.weights, two.weights) and one.curve == two.curve


def test_classifier_without_anything_to_learn(spark):
    none = train([], [])
    assert none.prior == 0.5 and np.allclose(none.score(["a", ""]), 0.5)
    assert train(["a", "b"], [1, 1]).score(["c"])[0] > 0.9
    df = awkward(spark)
    found = classify(extra(df), LineModel(np.zeros(WIDTH), np.zeros(4), (1.0, 0.0), 0.8)).collect()
    assert len(found) == df.count() and all(abs(r.quality_score - 0.8) < 1e-9 for r in found if not (r.text or "").strip())
    assert classify(df.limit(0), none).count() == 0
