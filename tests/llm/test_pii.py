import random
import re

import numpy as np

from folioscope.llm.pii import ALIKE, KINDS, LABELS, N_FEATURES, N_LABELS, SAME, Field, Model, Taken, _digits, base_spans, build_field, detect, find_spans, fit, luhn, redact, train

from .cases import awkward, docs, extra

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = _digits(m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@1259-+ ()%_%x\né") for _ in range(rng.randint(0, 60)))
        assert base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "@" * 300_000):
        base_spans(text)


def test_messages_match_enumeration_on_a_tree():
    rng = np.random.default_rng(1)
    model = Model(rng.normal(size=(N_FEATURES, N_LABELS)), rng.normal(size=(3, N_LABELS, N_LABELS)))
    field = Field([(0, 1)] * 4, rng.normal(size=(4, N_FEATURES)), ([(0, 1)], [(1, 2)], [(2, 3)]))
    (found,) = model.marginals([field], rounds=200)
    node, total = field.features @ model.weights, np.zeros((4, N_LABELS))
    for y in np.ndindex(*[N_LABELS] * 4):
        w = np.exp(sum(node[i, k] for i, k in enumerate(y)) + model.tables[0, y[0], y[1]] + model.tables[1, y[1], y[2]] + model.tables[2, y[2], y[3]])
        for i, k in enumerate(y):
            total[i, k] += w
    assert np.allclose(found, total / total.sum(axis=1, keepdims=True), atol=1e-2)


def test_skip_edges_join_distant_repeats():
    field = build_field("mail bob@x.org now " + "word " * 50 + "again bob@x.org and 555-123-4567 " + "word " * 9 + "5551234567")
    assert len(field.edges[SAME]) == len(field.edges[ALIKE]) == 1 and all(b - a > 1 for sort in (SAME, ALIKE) for a, b in field.edges[sort])


def corpus():
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice("some plain words of a letter".split()) for _ in range(n))
    return [f"{fill(9)} u{i}@mail.example.com {fill(4)} 10.{i % 200}.3.4 {fill(3)} +1 (212) 555-{1000 + i} {fill(5)} {i} things" for i in range(300)]


FAR = " word" * 60 + " "
#: (a known datum, another form of it far away, its kind): the form is found only beside the datum.
PLANTED = [
    ("call +1 (212) 555-1000 now", "2125551000", "phone"),
    ("call +1 (305) 555-2345 now", "305-555-2345", "phone"),
    ("mail jo.34@mail7.example.com now", "jo.34", "email"),
    ("pay 4845168114407329 now", "484516811440", "card"),
    ('set token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" now', "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde", "secret"),
]


def mentions():
    """Texts with data of every kind, and decoys."""
    rng = random.Random(4)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = lambda n: next(c for c in (n + str(k) for k in range(10)) if luhn(c))
    words = lambda n: " ".join(rng.choice("some plain words of a letter".split()) for _ in range(n))
    made = []
    for i in range(300):
        data = [f"u{i}.{d(2)}@mail{d(1)}.example.com", f"10.{i % 200}.3.4", card("4" + d(14)), f"+1 ({d(3)}) 555-{d(4)}", 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        made.append(" ".join(f"{words(rng.randint(3, 9))} {x}" for x in rng.sample(data, 3)) + f" {words(5)} {d(16)} {words(4)} version {d(1)}.{d(1)} {words(3)}")
    return made


def test_the_field_labels_distant_repeats_through_skip_edges_only():
    model = train(mentions())
    alone = Model(model.weights, model.tables * np.array([1, 0, 0])[:, None, None])
    added = lambda text, m: [(k, text[a:b]) for k, a, b, base in find_spans([text], m)[0] if not base and a > 60]
    found = ablated = 0
    for known, form, kind in PLANTED:
        found += (kind, form) in added(known + FAR + form + " again", model)
        ablated += (kind, form) in added(known + FAR + form + " again", alone)
        assert not added("once" + FAR + form + FAR + form + " again", model), form
    assert found >= 4 and ablated == 0
    clean = ["in 1984 about 12 of 300 lines, version 2.0 and 9807915762804490 twice 9807915762804490", "part 555-1000 and 2125551000" + FAR + "2125551000"]
    assert not any(find_spans(clean, model))


def test_an_added_span_never_overlaps_a_base_span():
    rng = random.Random(8)
    for _ in range(500):
        spans = [(a, a + rng.randint(1, 12)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 9)))]
        a = rng.randint(0, 60)
        b = a + rng.randint(1, 9)
        assert Taken(spans).meets(a, b) == any(s < b and a < e for s, e in spans)


def test_base_spans_stay_and_clean_texts_get_none(spark):
    texts = corpus() + ["no personal data in 12 of 300 lines, version 2.0.", "", None]
    df = docs(spark, texts)
    found = {r.doc_id: r.pii_spans for r in detect(extra(df), fit(df)).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i] if s.base] == plain(t or "")
    assert not found[300] and not found[301] and not found[302]


def test_redaction_puts_kinds_for_spans(spark):
    df = docs(spark, ["write to a.b@c.de or +49 (30) 123-4567 ok", "nothing", None, "é 1.2.3.4"])
    model = train([])
    texts = {r.doc_id: r.text for r in redact(detect(df, model)).collect()}
    assert texts == {0: "write to [EMAIL] or [PHONE] ok", 1: "nothing", 2: None, 3: "é [IP]"}


def test_awkward_rows(spark):
    df = awkward(spark)
    assert detect(extra(df), train(corpus())).count() == df.count()
    assert detect(df.limit(0), train([])).count() == 0
    assert find_spans([], train([])) == []


def test_the_sample_is_never_empty(spark):
    df = docs(spark, ["mail a1@b.org today"] * 500, [7] * 500)
    assert fit(df, rows=2).weights.any()
    assert not fit(docs(spark, ["no evidence"] * 3), rows=2).tables.any()
    assert set(KINDS) < set(LABELS)
