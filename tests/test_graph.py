"""Graphs of statements and comparisons, the repair of parsed papers, and what is read from answers."""

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import graph as op
from folioscope.operators.papers import setup_sections
from folioscope.sources.tei import parse

HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">{0}</title></titleStmt></fileDesc>{1}</teiHeader><text><body>{2}</body>{3}</text></TEI>'
NAME = "<persName><forename>{0}</forename><surname>{1}</surname></persName>"


def test_statements(spark):
    rows = spark.createDataFrame([(1, "limitation", 0, "x" * 90), (1, "limitation", 0, "x" * 90), (1, "future_work", 0, None), (2, "claim", 1, "c"), (2, None, 1, "c")], "paper_id long, kind string, pos int, text string")
    nodes, edges = op.statement_graph(rows)
    assert {tuple(r) for r in nodes.collect()} == {("1::lim::0", "LimitationStatement", "x" * 80), ("1::fw::0", "FutureWork", "")}
    assert {tuple(r) for r in edges.collect()} == {("1", "1::lim::0", "has_limitation"), ("1", "1::fw::0", "has_future_work")}


def test_relations(spark):
    rows = [(1, 1, 1, 1, None), (0, 1, 1, 1, None), (0, 0, 1, 1, None), (0, 0, 0, 1, None), (0, 0, 0, 0, None), (1, 0, 0, 0, "extends")]
    found = spark.createDataFrame(rows, "c int, p int, a int, s int, w string").select(op.relationship(*(F.col(x) for x in "cpas"), F.col("w"))).collect()
    assert [r[0] for r in found] == ["contradicts", "complements", "agrees_with", "parallel", "neutral", "extends"]


def test_comparison_edges(spark):
    pairs = spark.createDataFrame([(1, 2, "contradicts", ["d"]), (1, 3, "complements", []), (1, 4, "extends", []), (2, 3, "parallel", list("gfedcba")), (2, 4, "neutral", []), (3, 4, "agrees_with", ["d"])], "paper_a int, paper_b int, relation string, shared array<string>")
    findings = spark.createDataFrame(
        [(1, 2, "contradiction", "m1", False), (1, 2, "contradiction", "m2", True), (1, 2, "contradiction", "m3", None), (1, 2, "agreement", "m4", False), (1, 3, "contradiction", "m5", False), (3, 4, "agreement", "m6", None)],
        "paper_a int, paper_b int, kind string, detail string, explained boolean",
    )
    edges = op.comparison_edges(pairs, findings)
    want = {(1, 2, 0, "contradicts", "m1"), (1, 2, 0, "contradicts", "m3"), (1, 2, 1, "agrees_with", "m4"), (1, 3, 0, "complements", ""), (1, 4, 0, "extends", ""), (2, 3, 0, "similar_to", "a,b,c,d,e"), (3, 4, 1, "agrees_with", "m6")}
    assert {tuple(r) for r in edges.collect()} == want
    kept = {(r.paper_a, r.paper_b): (r.edge_type, r.detail) for r in op.collapsed(edges, "paper_a", "paper_b", ["place", "detail"]).collect()}
    assert kept == {(1, 2): ("agrees_with", "m4"), (1, 3): ("complements", ""), (1, 4): ("extends", ""), (2, 3): ("similar_to", "a,b,c,d,e"), (3, 4): ("agrees_with", "m6")}
    first = {(r.paper_a, r.paper_b): r.detail for r in op.collapsed(edges, "paper_a", "paper_b", ["place", "detail"], last=False).collect()}
    assert first[1, 2] == "m1"


def test_parsed_papers_are_repaired(spark):
    names = NAME.format("Ada", "Lovelace") + NAME.format("Google", "Brain") + NAME.format("", "Solo") + NAME.format("Ada", "Lovelace")
    body = "<div><head>1 Introduction</head><p>One.</p><p>Two <ref>[1]</ref> three.</p></div><div><head>Figure 2</head><p>gone</p></div><div><head>Empty</head></div>"
    figures = (
        '<figure xml:id="a"><figDesc>We execute the plan in very many words</figDesc></figure><figure xml:id="b"><label>2</label></figure><figure xml:id="c"><figDesc>A long enough caption of it.</figDesc></figure>'
        '<figure xml:id="b"><label>2</label><figDesc>later</figDesc></figure><figure type="table" xml:id="t"><figDesc>in the next part. We show all of the scores</figDesc><table><row><cell>a</cell><cell/></row><row><cell/></row></table></figure>'
        '<figure type="table" xml:id="p"><label>3</label><figDesc>Scores of it.</figDesc><table>' + "<row><cell>we see that the system is the best</cell></row>" * 4 + '</table></figure><figure type="table" xml:id="n"><figDesc>.5/ 6.1</figDesc></figure>'
    )
    rows = spark.createDataFrame([(1, HEAD.format("Journal of it. A Study of Words", names, body, figures)), (2, "<TEI>"), (3, ""), (4, None)], "k int, xml string")
    found = {r.k: r for r in parse(rows, "xml").collect()}
    assert [(found[k].success, found[k].document) for k in (2, 3, 4)] == [(False, None)] * 3 and found[3].error == found[4].error == "empty"
    d = found[1].document
    assert (d.title, d.authors) == ("A Study of Words", ["Ada Lovelace"])
    assert [tuple(s) for s in d.sections] == [("1 Introduction", "One.\nTwo three.")]
    assert [tuple(f) for f in d.figures] == [("b", "2", "later"), ("c", "", "A long enough caption of it.")]
    assert [tuple(t) for t in d.tables] == [("t", "", "We show all of the scores.", [["a"]]), ("p", "3", "Scores of it.", [])]


def test_setup_sections(spark):
    rows = spark.createDataFrame([(1, "Training", ""), (1, "Intro", ""), (2, "Intro", ""), (2, "End", None), (3, None, "Methods"), (3, "x", "y")], "paper_id int, heading string, section_type string")
    assert {(r.paper_id, r.heading) for r in setup_sections(rows).collect()} == {(1, "Training"), (2, "Intro"), (2, "End"), (3, None)}


def test_first_object_of_an_answer(spark):
    cases = {
        '{"a": 1} and {"b": 2}': '{"a": 1}',
        'Here: ```json\n{"a": {"b": "}"}}\n``` done }': '{"a": {"b": "}"}}',
        '{"a": "\\"}"} tail': '{"a": "\\"}"}',
        '{"a": 1': None,
        '{"a": "}': None,
        "none": None,
        "": None,
        "{}": "{}",
    }
    found = spark.createDataFrame([(c,) for c in cases] + [(None,)], "t string").select("t", tx.repair_json(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in found if r.t is not None} == cases and [r.j for r in found if r.t is None] == [None]
