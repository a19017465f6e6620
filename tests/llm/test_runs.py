"""Periodic runs against a search of every period, and the cases that the docstring defines."""

import random

import duckdb
import pytest

from folioscope.llm.oracles import ORACLES
from folioscope.llm.queries import QUERIES
from folioscope.llm.runs import Extensions, Powers, kept_words, periodic_runs, runs_of, strongest

from .cases import awkward, docs, extra


def plain(words, least=24, periods=3):
    found = []
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s:
                e = i + q
                smaller = any(all(words[x] == words[x + d] for x in range(s, e - d)) for d in range(1, q))
                if e - s >= max(least, periods * q) and not smaller:
                    found.append((s, e - s, q))
            i += 1
    return sorted(found)


@pytest.mark.parametrize("seed", range(6))
def test_every_run_of_every_period(seed):
    rng, powers = random.Random(seed), Powers()
    for _ in range(300):
        words = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3) if len(words) > 8 else 0):
            s, p = rng.randrange(len(words)), rng.randint(1, 9)
            for i in range(s, min(len(words), s + rng.randint(5, 70))):
                words[i] = words[s + (i - s) % p]
        for least in (1, 24):
            assert runs_of(words, powers, least) == plain(words, least)


def test_wrong_hashes_change_nothing():
    words = [random.Random(4).randrange(2) for _ in range(60)] * 3 + [0, 1] * 40
    extensions = Extensions(words, Powers())
    extensions._same = lambda i, j, k: True
    for i in range(0, 200, 3):
        for j in range(i + 1, 240, 7):
            k = next((k for k in range(len(words) - j) if words[i + k] != words[j + k]), len(words) - j)
            back = next((k for k in range(i) if words[i - k - 1] != words[j - k - 1]), i)
            assert (extensions.right(i, j), extensions.left(i, j)) == (k, back)


def test_long_texts_and_dropped_words(spark):
    texts = ["x " * 50_000, "a b c " * 20_000 + "end", None, "", " \n ", "a b " * 11 + "a b", "a b " * 11 + "a"]
    found = {r.doc_id: r for r in periodic_runs(docs(spark, texts)).withColumn("best", strongest()).collect()}
    assert [tuple(x) for x in found[0].runs] == [(0, 50_000, 1)] and found[0].collapsed == "x"
    assert found[1].n_words == 60_001 and found[1].collapsed == "a b c end"
    assert [(found[i].n_words, found[i].runs, found[i].collapsed, found[i].best) for i in (2, 3, 4)] == [(0, [], "", None)] * 3
    assert found[5].collapsed == "a b" and not found[6].runs and found[6].collapsed == texts[6]
    assert kept_words(6, [(0, 6, 2)]).tolist() == [True, True, False, False, False, False]


def test_strongest_breaks_ties(spark):
    frame = spark.sql("SELECT array(named_struct('start', 5L, 'length', 30L, 'period', 10L), named_struct('start', 9L, 'length', 60L, 'period', 20L), named_struct('start', 20L, 'length', 31L, 'period', 10L)) AS runs")
    assert tuple(frame.select(strongest()).first()[0]) == (20, 31, 10)
    assert tuple(frame.selectExpr("slice(runs, 1, 2) AS runs").select(strongest()).first()[0]) == (5, 30, 10)


def test_awkward_rows(spark):
    given = awkward(spark)
    found = periodic_runs(extra(given)).collect()
    assert len(found) == given.count() and all(x.collapsed == " ".join((r.text or "").split()) or x.runs for x, r in zip(sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(given.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))) if r.doc_id not in (1, 2, None))
    assert periodic_runs(given.where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(given, periods=2)


def test_registered_query(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))) for _ in range(120)] + [None, "", "p q r " * 30]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(ORACLES["op11_periodic_runs"])
    names = [c[0] for c in want.description]
    found = QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want.fetchall()))
    assert sum(r.n_runs > 0 for r in found) >= 5
