"""Papers as files, claims read with their defaults, names merged by a provider, the store of chunks and small rules."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.functions import text as tx
from folioscope.operators import critique, review, store
from folioscope.operators.entities import entity_index, first_mentions
from folioscope.sources.papers import merged_names, read_claims_outputs, write_parsed
from folioscope.sources.tei import parse

from .test_graph import HEAD, NAME


def test_six_parts_of_a_paper(spark, tmp_path):
    xml = HEAD.format("A Study of Words", NAME.format("Ada", "Lovelace"), "<div><head>2 Results</head><p>Good.</p></div>", '<figure xml:id="f"><label>1</label></figure>')
    parsed = parse(spark.createDataFrame([("p1", xml, xml), ("p2", "<TEI>", "<TEI>")], "paper_id string, keep string, xml string"), "xml").withColumnRenamed("keep", "xml")
    for _ in range(2):  # a second run replaces the first
        write_parsed(parsed, str(tmp_path))
    sections = spark.read.json(f"{tmp_path}/sections").collect()
    assert [(r.paper_id, r.section_type, r.heading, r.text) for r in sections] == [("p1", "Results", "2 Results", "Good.")]
    assert spark.read.json(f"{tmp_path}/metadata").first().title == "A Study of Words"
    assert spark.read.json(f"{tmp_path}/figures").first().figure_id == "f"
    assert "".join(r.value for r in spark.read.text(f"{tmp_path}/tei_raw").select("value").collect()) == xml
    text = spark.read.text(f"{tmp_path}/summary", wholetext=True).first().value
    assert "[META] Title:    A Study of Words" in text and "[META] Year:     (not found)" in text and "   1. [Results             ] 2 Results  (5 chars)" in text and "[ABSTRACT]" not in text


def test_claims_outputs(spark, tmp_path):
    def put(name, value):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "claims_output.json").write_text(value if isinstance(value, str) else json.dumps(value))

    put("good/a", {"paper_id": "a", "claims": [{"description": "d", "claim_type": "performance", "value": 3}, {"text": "t", "description": "d", "type": "x"}], "entities": {"method": {"bert": [{"text": "BERT", "confidence": 0.9}]}}})
    put("good/b", {"paper_id": "b"})
    put("bad/c", {"claims": []})
    put("bad/d", '["no object"]')
    rows = {r.paper_id: r for r in read_claims_outputs(spark, f"{tmp_path}/good").collect()}
    assert [(c.text, c.type, c.value) for c in rows["a"].claims] == [("d", "performance", "3"), ("t", "x", None)]
    assert rows["a"].entity_index["method"]["bert"][0].text == "BERT" and (rows["b"].claims, rows["b"].limitations, rows["b"].metadata, rows["b"].entity_index) == ([], [], {}, {})
    with pytest.raises(Exception, match="no paper id"):
        read_claims_outputs(spark, f"{tmp_path}/bad").collect()
    assert {r.paper_id for r in read_claims_outputs(spark, str(tmp_path), strict=False).collect()} == {"a", "b"}


class Merging:
    """Knows that names with a number belong to those without; fails for names of one kind, and never names everything."""

    def answer(self, prompts):
        out = []
        for p in prompts:
            names = [line.split(". ", 1)[1] for line in p.splitlines() if ". " in line]
            out.append("no idea" if "metric" in p else "```json\n" + json.dumps({n: n.rstrip("0123456789") for n in names if n[-1].isdigit()}) + "\n```")
        return out


def test_names_are_merged_in_batches(spark):
    names = [("method", f"bert{i}") for i in range(90)] + [("method", "gpt"), ("metric", "bleu4"), ("method", None), (None, "x"), ("method", "gpt")]
    frame = spark.createDataFrame(names, "kind string, name string")
    found = {(r.kind, r.name): r.canonical for r in merged_names(frame, "kind", "name", Merging).collect()}
    assert found == {**{("method", f"bert{i}"): "bert" for i in range(90)}, ("method", "gpt"): "gpt", ("metric", "bleu4"): "bleu4"}
    assert {r.canonical for r in merged_names(frame, "kind", "name").collect()} == {n for k, n in names if k and n}


def test_store_of_chunks(spark):
    kinds = "chunk_id string, paper_id string, chunk_type string, display_text string, embedding array<double>"
    rows = spark.createDataFrame([("1", "p", "claim", "a", [1.0]), ("1", "p", "section", "b", [1.0]), ("1", "q", "limitation", "c", [1.0]), ("2", "p", "odd", "d", None), ("3", None, "entity", "e", [2.0])], kinds)
    kept = store.upsert_chunks(store.routed(rows.where("false")), rows)
    assert {(r.collection, r.chunk_id, r.document) for r in kept.collect()} == {("claims_and_findings", "1", "c"), ("paper_sections", "1", "b"), ("entities_global", "3", "e")}
    left, gone = store.without_paper(kept, "p")
    assert {tuple(r) for r in gone.collect()} == {("paper_sections", 1)} and {r.document for r in left.collect()} == {"c", "e"}
    with pytest.raises(Exception, match="without an embedding"):
        store.routed(rows.withColumn("embedding", F.lit(None).cast("array<double>"))).collect()
    ids = spark.createDataFrame([("method::a::b",), ("dataset::c",), ("none",), (None,), ("dataset::c",)], "entity_id string")
    assert {tuple(r) for r in store.known_keys(ids).collect()} == {("method", "a::b"), ("dataset", "c")}


def test_checks_are_isolated(spark):
    rows = spark.createDataFrame([(1, 0)], "p int, n_datasets int")
    found, errors = critique.isolated_weaknesses(rows, "p")
    assert [r.weakness for r in found.collect()] == ["no_dataset_reported"] and "missing_ablation_study" in errors and len(errors) == len(critique.CHECKS) - 2
    found, errors = critique.isolated_weaknesses(rows.select("p"), "p")
    assert found.collect() == [] and len(errors) == len(critique.CHECKS)


def test_small_rules(spark):
    rows = spark.createDataFrame([("A survey of it",), ("Theoretical!",), ("no",), (None,)], "a string")
    assert [r[0] for r in rows.select(critique.paper_type(F.col("a"))).collect()] == ["survey", "theoretical", "experimental", "experimental"]
    words = spark.createDataFrame([("The state-of-the-art GPT-2 don't été naïve abc_d x1",)], "t string").select(tx.limitation_tokens(F.col("t")), tx.claim_tokens(F.col("t")), tx.long_words(F.col("t"))).first()
    assert [set(x) for x in words] == [{"state", "art", "gpt", "don"}, {"state-of-the-art", "gpt-2", "don"}, {"state", "naïve", "abc_d"}]
    steps = spark.createDataFrame([(0,), (50,), (100,), (150,)], "s int").select(scores.linear_decay(F.col("s"), 1.0, 0.2, 100), scores.cosine_decay(F.col("s"), 1.0, 0.0, 100)).collect()
    assert [round(r[0], 6) for r in steps] == [1.0, 0.6, 0.2, 0.2] and [round(r[1], 6) for r in steps[:3]] == [1.0, 0.5, 0.0]
    authors = spark.createDataFrame([(["Ada B. Lovelace", "X"], 2020), ([], None), (None, 1999), (list("abcd"), 2001)], "a array<string>, y int")
    made = authors.select(review.citation(F.col("a"), F.col("y")), review.reference(F.lit(1), F.coalesce("a", F.array().cast("array<string>")), F.col("y"), F.lit("T"), F.lit("V"))).collect()
    assert [r[0] for r in made] == ["[Lovelace 2020]", "[Unknown ?]", "[Unknown 1999]", "[a 2001]"] and made[3][1] == "[1] a, b, c et al. (2001). T. V." and made[1][1] == "[1]  (n.d.). T. V."


def test_nested_and_first_mentions(spark):
    rows = spark.createDataFrame([(1, "method", "BERT", 0.5, "Intro", 0), (1, "method", "bert", 0.9, "Results", 1), (1, "task", "QA", 0.1, "Intro", 2), (1, "odd", "x", 1.0, "Intro", 3)], "paper_id int, entity_type string, text string, confidence double, section string, pos int")
    index = entity_index(rows, ["method", "dataset", "task"], ["text", "confidence"], ["pos"]).first()
    assert {k: [tuple(m) for m in v] for k, v in index.method.items()} == {"bert": [("BERT", 0.5), ("bert", 0.9)]} and index.dataset == {} and list(index.task) == ["qa"]
    first = first_mentions(rows.withColumn("key", F.lower("text")), ["paper_id", "key"], "section", "confidence", ["pos"]).where("key = 'bert'").first()
    assert (first.section, first.confidence, first.also_in_sections) == ("Intro", 0.9, ["Results"])


def test_registries_of_both_forms(spark, tmp_path):
    from folioscope.sources.catalog import read_registry

    for name, value in (("new", {"hashes": {"h": "p"}, "arxiv_ids": {"1.2": "q"}}), ("old", {"h1": "p", "h2": "q"}), ("empty", {})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    read = lambda name: {tuple(r) for r in read_registry(spark, f"{tmp_path}/{name}.json").collect()}
    assert read("new") == {("hash", "h", "p"), ("arxiv", "1.2", "q")} and read("old") == {("hash", "h1", "p"), ("hash", "h2", "q")} and read("empty") == set()


def test_gaps_are_boosted(spark):
    gaps = spark.createDataFrame(
        [("a", "combinatorial", "LOW", 0.5, [1, 2]), ("b", "combinatorial", "LOW", 0.95, [1, 1]), ("c", "combinatorial", "LOW", 0.5, [3]), ("d", "limitation", "LOW", 0.5, [3, 1]), ("e", "limitation", "LOW", 0.35, [3]), ("f", "cross_paper", "LOW", 0.5, [1, 3])],
        "gap_id string, gap_type string, priority string, confidence double, papers array<int>",
    )
    weak = spark.createDataFrame([(1, "single_dataset_evaluation", "HIGH"), (1, "outdated_baselines", "MEDIUM"), (2, "outdated_baselines", "HIGH"), (3, "vague_limitations", "LOW"), (3, "single_dataset_evaluation", "MEDIUM")], "paper_id int, weakness string, severity string")
    found = {r.gap_id: (r.priority, round(r.confidence, 6), r.needs_review) for r in critique.boosted_gaps(gaps, weak).collect()}
    assert found == {"a": ("HIGH", 0.65, False), "b": ("HIGH", 1.0, False), "c": ("LOW", 0.5, False), "d": ("LOW", 0.35, True), "e": ("LOW", 0.3, True), "f": ("LOW", 0.5, False)}


def test_statistics_of_other_arms_are_dropped(spark):
    from folioscope.operators.ranking import kept_statistics

    saved = spark.createDataFrame([("x", 1.0, ["x", "y"]), ("y", 2.0, ["x", "y"])], "arm string, a double, arms array<string>")
    assert {tuple(r) for r in kept_statistics(saved, ["x", "y"]).collect()} == {("x", 1.0), ("y", 2.0)}
    assert kept_statistics(saved, ["y", "x"]).count() == kept_statistics(saved, ["x"]).count() == kept_statistics(saved.where("false"), ["x"]).count() == 0


def test_outputs_are_written_and_counted(spark, tmp_path):
    from folioscope.sources import outputs

    rows = spark.createDataFrame([("p", "g1", 1), ("q", "g2", 2)], "paper_id string, g string, n int")
    assert outputs.write_output(rows, str(tmp_path), "claims") == f"{tmp_path}/claims"
    outputs.write_output(rows.where("paper_id = 'p'").withColumn("n", F.lit(9)), str(tmp_path), "claims")
    assert {(r.paper_id, r.n) for r in spark.read.json(f"{tmp_path}/claims").collect()} == {("p", 9), ("q", 2)}
    compared = spark.createDataFrame([("c1", "a", "b", [1, 2], []), ("c2", "a", "c", None, [1])], "comparison_id string, paper_a string, paper_b string, contradictions array<int>, complementary_findings array<int>")
    assert {(r.comparison_id, r.n_contradictions, r.n_complements) for r in outputs.finding_counts(compared).collect()} == {("c1", 2, 0), ("c2", 0, 1)}


def test_prompts(spark):
    from folioscope.functions import prompts

    row = spark.createDataFrame([(1, 2, list("abcdefg"), [], None, "t" * 2000, 0.654)], "a int, b int, m array<string>, d array<string>, c array<string>, t string, p double")
    pair = row.select(prompts.pair_prompt(F.col("a"), F.col("b"), F.col("m"), F.col("d"), F.col("c"), F.col("d"))).first()[0]
    assert "papers 1 and 2" in pair and pair.count("\n- ") == 5 and pair.count("(none)") == 3 and "- f" not in pair
    section = row.select(prompts.section_prompt(F.lit("Results"), F.lit(None).cast("string"), F.col("t"), F.col("m"))).first()[0]
    assert section.endswith("t" * 1500) and "Section Results: \n" in section
    gap = row.select(prompts.validation_prompt(F.lit("gap"), F.lit("why"), F.col("p"))).first()[0]
    assert gap.endswith("Confidence:\n0.65") and "Gap:\ngap\n\nEvidence:\nwhy" in gap
    assert row.select(prompts.critique_prompt(F.col("a"), F.col("m"), F.col("d"), F.col("c"))).first()[0].count("\n- ") == 7


def test_slugs_of_papers(spark):
    rows = spark.createDataFrame([("A Study - of  Words!",), ("abc",)], "t string")
    assert [r[0] for r in rows.select(tx.paper_slug(F.col("t"))).collect()] == ["a_study_of_words", "abc"]
    for short in ("ab", "--", None):
        with pytest.raises(Exception, match="no paper id"):
            spark.createDataFrame([(short,)], "t string").select(tx.paper_slug(F.col("t"))).collect()
