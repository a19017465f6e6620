"""Rules of parsed papers on cases with known answers, slots against a plain loop, and agents' outputs read back."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scholarly as rule
from folioscope.operators import claims
from folioscope.operators import papers as op
from folioscope.sources import outputs, tei


def apply(spark, cases, f, kind="string"):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} {kind}" for k in range(len(cases[0]))))
    return [r.out for r in rows.select("i", f(*(F.col(f"c{k}") for k in range(len(cases[0])))).alias("out")).orderBy("i").collect()]


def test_titles_captions_and_labels(spark):
    titles = ["Published 2018. A study of graphs", "arXiv 2017 ATTENTION is all", "GRAPH nets", "One. Two", "", "Proc of ICML"]
    assert apply(spark, [(t,) for t in titles], rule.clean_title) == ["A study of graphs", "ATTENTION is all", "GRAPH nets", "One. Two", "", "Proc of ICML"]
    captions = ["we execute it. The loss of all models over time. so", "nothing here", "", "A b c d e."]
    assert apply(spark, [(c,) for c in captions], rule.rescued_caption) == ["The loss of all models over time.", "", "", "A b c d e."]
    assert apply(spark, [("We execute",), ("",), (None,), (".23/ 6",), ("1.2/3.4",), ("Accuracy",)], rule.garbled_caption) == [True, True, True, True, True, False]
    assert apply(spark, [("7",), (" (7) ",), ("A.1",), (None,)], rule.formula_label) == ["(7)", "(7)", "A.1", ""]
    assert apply(spark, [("x = y (7)", "(7)"), ("7 x = y 7", "(7)"), ("x = a+b", ""), ("a.c", "(.)")], rule.formula_content) == ["x = y", "x = y", "x = a+b", "a.c"]
    assert apply(spark, [("3.1",), ("3",), ("",), (None,)], rule.section_level) == ["subsection", "section", "unnumbered", "unnumbered"]
    assert apply(spark, [("3.1",), ("3",), ("",)], rule.top_level) == ["3", "3", ""]
    assert apply(spark, [("Figure 2 x",), ("Input-Input Layer5",), ("Results",), (None,)], rule.garbage_heading) == [True, True, False, False]
    assert apply(spark, [("ﬁne  text\n",), (None,)], rule.compatible) == ["fine text", None]


def test_tables_that_are_prose(spark):
    prose = [["we went to the house and sat"]]
    tables = [prose, [["a", "b"], ["c", "d"]], [], None, [["short"]], prose * 3 + [["x"]] * 2, prose + [["x"]] * 4]
    rows = spark.createDataFrame(list(enumerate(tables)), "i int, t array<array<string>>")
    assert [r.g for r in rows.select("i", rule.garbled_table(F.col("t")).alias("g")).orderBy("i").collect()] == [True, False, True, True, False, True, False]


def test_names_ids_and_years(spark):
    assert apply(spark, [("Ada Lovelace",), ("Ada",), ("Google Brain",), ("Mit Romney",)], rule.is_author) == [True, False, False, False]
    assert apply(spark, [("10.1/ab", "T", "2001"), (None, "Attention Is All You Need: now", "2017"), ("", None, None)], rule.paper_id) == ["doi:10.1_ab", "attention_is_all_you_need_2017", "unknown_0000"]
    years = spark.createDataFrame([(0, 2017, "x"), (1, None, "1706.03762"), (2, 3000, "9905.1"), (3, None, "paper")], "i int, y int, n string")
    assert [r.out for r in years.select("i", rule.year_of(F.col("y"), F.col("n")).alias("out")).orderBy("i").collect()] == [2017, 2017, 1999, None]
    assert apply(spark, [("find me papers about graph nets",), ("show me",)], rule.without_filler) == ["graph nets", "show me"]
    assert apply(spark, [("B-Material",), ("I-Task",), ("Method",), ("O",)], rule.entity_type_of) == ["dataset", "task", "method", None]
    names = [("BLEU score", "metric", "kept"), ("foo dataset", "dataset", "kept"), ("Foo", "dataset", "kept"), ("Foo", "metric", None), (" Foo ", "method", "kept"), (" ", "metric", "kept")]
    assert apply(spark, names, rule.normalised) == ["bleu", "foo", "kept", "foo", "foo", " "]
    assert apply(spark, [("Training Setup", "x"), ("x", "Methods"), ("Related", None)], rule.is_setup_section) == [True, True, False]


def test_judged_contradictions_in_order(spark):
    rows = spark.createDataFrame(
        [(0, "a", "b", True, True, True, True, "HIGH"), (1, "a", "a", False, True, True, True, "HIGH"), (2, None, "b", True, True, True, False, "HIGH"), (3, "", "b", None, False, True, True, "HIGH"), (4, "a", "a", True, None, None, None, "HIGH")],
        "i int, a string, b string, comparable boolean, time boolean, hardware boolean, rate boolean, severity string",
    )
    out = op.judged_contradictions(rows, F.col("a"), F.col("b"), F.col("comparable"), F.col("time"), F.col("hardware"), F.col("rate")).orderBy("i").collect()
    assert [(r.filter_reason, r.severity) for r in out] == [("different_subjects", "LOW"), ("incomparable_setup", "HIGH"), ("hardware_variance", "HIGH"), (None, "MEDIUM"), (None, "HIGH")]


def test_slots_equal_a_plain_loop(spark):
    dice, rows = random.Random(5), []
    for claim in range(60):
        for pos in range(dice.randrange(1, 7)):
            raw = dice.choice(["BLEU", "squad v2", "f1", "thing", "other"])
            rows += [(claim, pos, raw, kind, f"{kind}{dice.randrange(3)}", dice.choice([0.0, 0.75, 0.8, 0.9])) for kind in dice.sample(op.ENTITY_TYPES, dice.randrange(1, 5)) for _ in range(2)]
    want = {}
    for claim in {r[0] for r in rows}:
        got = {"metric": None, "dataset": None, "methods": []}
        for pos in sorted({r[1] for r in rows if r[0] == claim}):
            here = [r for r in rows if r[:2] == (claim, pos)]
            raw, best = here[0][2], {}
            for kind in op.ENTITY_TYPES:
                if of := [(-r[5], r[4]) for r in here if r[3] == kind]:
                    best[kind] = min(of)
            if re.match(rule.KNOWN_METRIC, raw):
                kinds = [] if got["metric"] else ["metric"]
            elif re.match(rule.KNOWN_DATASET, raw):
                kinds = [] if got["dataset"] else ["dataset"]
            else:
                kinds = [k for k in ("metric", "dataset") if not got[k]] + ["method", "task"]
            found = [(best[k][0], n, k) for n, k in enumerate(kinds) if k in best and best[k][0] < 0]
            if found:
                kind = min(found)[2]
                if kind in ("metric", "dataset"):
                    got[kind] = best[kind][1]
                else:
                    got["methods"].append(best[kind][1])
        want[claim] = (got["metric"], got["dataset"], got["methods"])
    table = spark.createDataFrame(rows, "claim int, pos int, raw string, entity_type string, canonical string, similarity double")
    assert {r.claim: (r.metric, r.dataset, r.methods) for r in op.resolved_slots(table, ["claim"]).collect()} == want


def test_formulas_and_sections_that_were_split(spark):
    rows = [(1, "", "preamble of it"), (2, "(1)", "x = y"), (3, "", "+ z"), (4, "", "the next begins"), (5, "", "w"), (6, "(2)", "u = v"), (7, "", "left alone at last"), (8, "", "")]
    frame = spark.createDataFrame([(1, *r) for r in rows] + [(2, 1, "", "a"), (2, 2, "", "bcdefghij")], "g int, p int, label string, content string")
    out = op.merged_formulas(frame, "g", ["p"]).orderBy("g", "pos").collect()
    assert [(r.g, r.pos, r.label, r.content) for r in out] == [(1, 1, "(1)", "preamble of it x = y + z"), (1, 2, "(2)", "the next begins w u = v"), (1, 3, "", "left alone at last"), (2, 1, "", "a bcdefghij")]
    parts = [(1, 1, "Figure 1", "lost"), (1, 2, "Intro", "a"), (1, 3, "Table 2", "b"), (1, 4, None, "c"), (1, 5, "layer1", "")]
    out = op.absorbed_sections(spark.createDataFrame(parts, "g int, p int, heading string, text string"), "g", ["p"]).orderBy("pos").collect()
    assert [(r.heading, r.text) for r in out] == [("Intro", "a b"), (None, "c")]


def test_scores_of_steps(spark):
    cases = [(["run_comparator", "run_critic", "run_gap_detector"], 1.0), (["run_critic", "run_comparator"], 0.65), (["run_gap_detector"], 0.25), ([], 0.0), (["run_critic", "run_gap_detector"], 0.6)]
    rows = spark.createDataFrame([(i, ran) for i, (ran, _) in enumerate(cases)], "i int, ran array<string>")
    assert [round(r.s, 9) for r in rows.select("i", op.context_score(F.col("ran")).alias("s")).orderBy("i").collect()] == [want for _, want in cases]


def test_close_claims_are_all_pairs_within_the_tolerance(spark):
    dice = random.Random(3)
    rows = [(i, dice.randrange(6), "m", round(dice.uniform(-2, 2), 2)) for i in range(80)] + [(80, 1, "m", None), (81, 2, None, 0.0)]
    want = sorted((a[0], b[0]) for a in rows[:80] for b in rows[:80] if a[1] < b[1] and abs(a[3] - b[3]) <= 0.25)
    table = spark.createDataFrame(rows, "claim_id int, paper_id int, metric string, value double")
    assert sorted((r.claim_id_a, r.claim_id_b) for r in claims.close_claims(table, ["metric"], 0.25).collect()) == want


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert op.typed_entities(none("paper_id int, source string, entity_type string, text string"), ["x"]).count() == 0
    assert op.pair_overlaps(none("paper_a int, paper_b int"), none("paper_id int, entity_type string, entity string")).count() == 0
    assert op.merged_formulas(none("g int, p int, label string, content string"), "g", ["p"]).count() == 0


def test_outputs_of_agents(spark, tmp_path):
    for name, body in (
        ("comparisons/a.json", {"paper_a": "p", "paper_b": "q", "contradictions": [{"entity": "bert", "text_a": "x", "claim_b": "y"}], "complementary_findings": [{"text": "fits"}]}),
        ("comparisons/b.json", {"paper_a": "p", "paper_b": "z", "contradictions": [{"method": "m"}]}),
        ("critiques/p_critique.json", {"paper_id": "p", "weaknesses": [{"weakness_type": "ablation"}]}),
        ("critiques/other.json", {"paper_id": "no"}),
        ("gaps/g.json", {"gaps": [{"gap_id": "1"}, {"gap_id": "2"}]}),
    ):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(json.dumps(body))
    (tmp_path / "gaps/bad.json").write_text("{")
    comparisons = outputs.read_comparisons(spark, f"{tmp_path}/comparisons")
    contradictions, complements = outputs.findings_among(comparisons, spark.createDataFrame([("p",), ("q",)], "paper_id string"))
    assert [tuple(r) for r in contradictions.collect()] == [("p", "q", "bert", "x", "y", "medium", "unknown")]
    assert [tuple(r) for r in complements.collect()] == [("p", "q", "fits")]
    assert [r.paper_id for r in outputs.read_critiques(spark, f"{tmp_path}/critiques").collect()] == ["p"]
    assert [r.gap_id for r in outputs.read_gaps(spark, f"{tmp_path}/gaps").orderBy("pos").collect()] == ["1", "2"]
    assert outputs.read_gaps(spark, f"{tmp_path}/absent").count() == 0
    sections = spark.createDataFrame([(2, "Second"), (1, "# First")], "n int, text string")
    outputs.write_review(sections, f"{tmp_path}/review", ["n"])
    found = outputs.headings_found(spark, f"{tmp_path}/review", ("first", "third")).where("n_found > 0").collect()
    assert [(r["first"], r["third"], r.n_found) for r in found] == [(True, False, 1)]
    outputs.write_json(sections, f"{tmp_path}/json", "n")
    assert sorted(r.n for r in spark.read.json(f"{tmp_path}/json").collect()) == [1, 2]
    assert outputs.files_named(spark, str(tmp_path), "*_critique.json").count() == 1


@pytest.mark.parametrize("xml, text", [("<a><b>one</b><b>two</b></a>", "one two")])
def test_adjacent_elements_stay_apart(xml, text):
    from xml.etree import ElementTree

    assert tei.running_text(ElementTree.fromstring(xml)) == text


def test_sets_of_papers_are_gathered_once(spark):
    from folioscope import plans

    from .test_queries import SF

    for name in ("collapsed_graph", "pair_ranking"):
        plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lineitem") <= 1 and plan.count("l_orderkey") and plan.count("RepartitionByExpression") == 1  # once, not once for each side of a pair
