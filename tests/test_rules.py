"""Rules of critique, setups and rewards on small cases."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import critique
from folioscope.operators import rewards as rw


def values(spark, rows, kinds, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, kinds).select(*columns).collect()]


def test_signals(spark):
    cases = {
        "An ABLATION of all parts": (True, False, False, False),
        "three heads": (True, False, False, False),
        "model model model, we vary it": (True, False, False, False),
        "model model, we vary it": (False, False, False, False),
        "model model model": (False, False, False, False),
        "p<0.05 on github, faster": (False, True, True, True),
        "5 ± 1 at http://x": (False, True, True, False),
        "": (False, False, False, False),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    found = rows.select("t", *(c.alias(n) for n, c in tx.signals(F.col("t")).items())).collect()
    assert {r.t: (r.has_ablation, r.has_significance, r.has_reproducibility, r.has_speed_metrics) for r in found} == cases


@pytest.mark.parametrize(("heading", "kind"), [("2. Background", "Background"), ("3.1 Results", "Results"), ("II Background", "Unknown"), ("4Method", "Methods"), (" Abstract ", "Abstract"), (None, "Unknown")])
def test_section_types(spark, heading, kind):
    assert values(spark, [(heading,)], "h string", tx.section_type(F.col("h"))) == [(kind,)]


def test_checks_by_paper_type(spark):
    kinds = "p long, paper_type string, n_datasets int, n_tasks int, n_claims int, n_metrics int, has_ablation boolean, has_significance boolean, has_reproducibility boolean, n_future_work int, n_limitations int"
    bad = (0, 2, 1, 1, False, False, False, 0, 1)
    rows = spark.createDataFrame([(1, "experimental", *bad), (2, "survey", *bad), (3, "theoretical", *bad), (4, None, 2, 1, 0, 2, True, False, True, 1, 0)], kinds)
    found = {}
    for r in critique.find_weaknesses(rows, "p").collect():
        found.setdefault(r.p, set()).add(r.weakness)
    everything = {c.name for c in critique.CHECKS} - {"single_dataset_evaluation"}
    assert found == {1: everything, 2: {"missing_statistical_significance", "missing_reproducibility", "missing_limitations_future_work"}, 3: {"missing_limitations_future_work"}}
    assert {r.weakness for r in critique.find_weaknesses(rows.drop("paper_type").where("p = 2"), "p").collect()} == everything


def test_baselines_are_looked_up_by_letters_and_digits(spark):
    uses = spark.createDataFrame([(1, "GPT2", 2025), (1, "gpt 2", 2025), (1, "LSTM", 2010), (2, "f-lstm", 2025), (2, "BERT", 2022), (3, "Attention is all", 2023), (4, "bert", None)], "p long, n string, y int")
    found = {(r.p, r.n): (r.age, r.severity) for r in critique.stale_baselines(uses, "n", "y").collect()}
    assert found == {(1, "GPT2"): (6, "MEDIUM"), (1, "gpt 2"): (6, "MEDIUM"), (1, "LSTM"): (13, "HIGH"), (3, "Attention is all"): (6, "MEDIUM")}
    assert {tuple(r) for r in critique.outdated_papers(uses, "p", "n", "y").collect()} == {(1, 3, 13, "HIGH"), (3, 1, 6, "MEDIUM")}


def test_setups_in_words(spark):
    texts = ["Adam, learning rate of 0.1, batch size 64, 10 epochs on 8 x V100", "SGD, lr = 1e-5, batch size 1024, 500 epochs on a GTX 1080, int8", "nothing here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    s = rows.select("i", *(c.alias(n) for n, c in tx.setup_values(F.col("t")).items()))
    a, b = (s.select(*(F.col(c).alias(f"{c}_{x}") for c in s.columns)) for x in "ab")
    d = tx.setup_divergence({n: F.col(f"{n}_a") for n in s.columns}, {n: F.col(f"{n}_b") for n in s.columns})
    found = {(r.i_a, r.i_b): r for r in a.crossJoin(b).select("i_a", "i_b", *(c.alias(n) for n, c in d.items())).collect()}
    one = found[0, 1]
    assert one.summary == "Setup differences: LR differs 10000x (0.1 vs 1e-05); batch size differs 16x; training duration differs 50x; different optimizers: adam vs sgd; hardware gap: V100 vs GTX."
    assert (one.divergence, one.comparable, one.reason, one.saves_alone) == (1.0, False, "Both LR and hardware differ significantly.", "b")
    assert found[1, 0].saves_alone == "a"
    none = found[0, 2]
    assert (none.divergence, none.summary, none.comparable, none.reason, none.saves_alone) == (0.0, "No major setup differences detected.", True, None, None)


def test_severities(spark):
    rows = [("HIGH",), ("medium",), ("MEDIUM",), ("0.5",), ("0.4",), ("odd",), (None,)]
    found = values(spark, rows, "s string", "s", rw.severity_score(F.col("s")), rw.severe(F.col("s")))
    assert found == [("HIGH", 1.0, True), ("medium", 0.6, False), ("MEDIUM", 0.6, True), ("0.5", 0.5, True), ("0.4", 0.4, False), ("odd", 0.3, False), (None, 0.3, False)]


def test_rewards(spark):
    session = "a long, s double, g double, o long, c double, i long"
    reward = rw.session_reward(*map(F.col, "asgoci"))
    assert values(spark, [(3, 1.0, 1.0, 3, 1.0, 4), (0, None, None, 0, 0.0, 8), (1, 0.6, 0.5, 1, 0.4, 6)], session, F.round(reward, 6)) == [(1.0,), (0.0,), (round(0.25 / 3 + 0.2 * 0.36 + 0.1 + 0.05 + 0.06 + 0.025, 6),)]
    gap = rw.gap_reward(F.col("r"), F.col("n"), F.col("p"), F.col("t"), F.col("x"), F.col("c"), F.col("y"), F.col("k"))
    rows = [(0.0, 5, 10, 10, 0, 1.0, "HIGH", "cross_paper"), (1.0, 0, 0, 0, 0, None, "odd", "limitation")]
    assert values(spark, rows, "r double, n int, p int, t int, x int, c double, y string, k string", F.round(gap, 6)) == [(1.0,), (round(0.14 + 0.09 + 0.06, 6),)]
    end = rw.terminal_reward(*(F.col(c) for c in ("p", "x", "q", "g", "k", "w", "d", "b")))
    rows = [(1, 5, 0, 0, 1.0, False, 9, 0.0), (2, 1, 4, 8, 1.0, True, 0, 0.13)]
    assert values(spark, rows, "p int, x int, q int, g int, k double, w boolean, d int, b double", F.round(end, 6)) == [(round(0.22 * 0.05 + 0.1 * 0.25, 6),), (1.0,)]


def test_agents_in_order(spark):
    rows = [(1, "run_comparator", 1), (1, "run_critic", 2), (1, "run_gap_detector", 3), (1, "run_writer", 4), (2, "run_critic", 1), (2, "run_comparator", 2), (2, "run_critic", 3), (3, "other", 1)]
    found = rw.order_kept(spark.createDataFrame(rows, "s long, a string, t long"), "s", "a", "t").collect()
    assert {r.s: (r.n_in_order, round(r.bonus, 6)) for r in found} == {1: (3, 0.13), 2: (0, 0.0), 3: (0, 0.0)}


def test_a_rescued_caption_keeps_its_digits(spark):
    """The first sentence once lost the zeros at its ends, the second its ones: each was trimmed of its place."""
    from folioscope.functions.scholarly import rescued_caption

    texts = [("Licensed under the License, Version 2.0.\nNo more.",), ("Short.  We have four seeds and a total of 31. End.",), ("Some words that stand here first. ",)]
    found = spark.createDataFrame(texts, "t string").select(rescued_caption(F.col("t"))).collect()
    assert [r[0] for r in found] == ["Licensed under the License, Version 2.0.", "We have four seeds and a total of 31.", "Some words that stand here first."]
