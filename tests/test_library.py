"""Operators outside the query catalogue: sources, providers, sessions, control flow, and properties of the others."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores, text as tx
from folioscope.operators import chunks, claims, entities, ranking, sequences
from folioscope.plans.registry import QUERIES
from folioscope.sources import catalog, feeds, tei
from folioscope.plans import session as plan


def test_papers_prefer_the_claims_file_and_skip_broken_ones(spark, tmp_path):
    for folder, name, body in [("a", "claims_output.json", {"paper_id": "p1", "claims": [{"claim_type": "performance", "description": "d", "value": "3.5", "entities_involved": ["x", "y"]}]}), ("a", "a_enriched.json", {"paper_id": "p1"}), ("b", "b_enriched.json", {"limitations": [{"text": "small data"}]})]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(json.dumps(body))
    (tmp_path / "b" / "broken.json").write_text("{not json")
    papers = catalog.read_papers(spark, str(tmp_path))
    assert {r.paper_id: r.file.rsplit("/", 1)[-1] for r in papers.collect()} == {"p1": "claims_output.json", "b": "b_enriched.json"}
    found = {(r.paper_id, r.chunk_type, r.text, r.numeric_value, r.entities_mentioned) for r in catalog.read_chunks_of(papers).collect()}
    assert found == {("p1", "claim", "d", 3.5, "x,y"), ("b", "limitation", "small data", None, "")}


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path, row = str(tmp_path / "t"), "k string, v int"
    assert catalog.read_or_empty(spark, path, spark.createDataFrame([], row).schema).count() == 0
    catalog.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], row), path, "k")
    catalog.replace_partitions(spark.createDataFrame([("b", 3)], row), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_upserts_are_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    for last, want in ((True, {(1, "a"), (2, "c"), (3, "d")}), (False, {(1, "a"), (2, "b"), (3, "d")})):
        once = chunks.upsert(old, new, ["k"], last)
        assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in chunks.upsert(once, new, ["k"], last).collect()}


def test_upserts_keep_one_row_a_key(spark):
    row = "k int, v string"
    old, new = spark.createDataFrame([(1, "a"), (None, "n")], row), spark.createDataFrame([(2, "c"), (2, "b"), (None, "m"), (None, "o")], row)
    for last, want in ((True, {(1, "a"), (2, "c"), (None, "o")}), (False, {(1, "a"), (None, "n"), (2, "b")})):
        once = chunks.upsert(old, new, ["k"], last)
        assert sorted(map(str, once.collect())) == sorted(map(str, [type(once.first())(k=k, v=v) for k, v in want]))
        assert once.count() == chunks.upsert(once, new, ["k"], last).count() == 3


def test_embedded_texts(spark):
    df = spark.createDataFrame([("limitation", "performance", "Results", "Speed", "It is slow.", ["A", "B"])], "ct string, claim string, section string, heading string, text string, names array<string>")
    c = F.col
    none = F.lit(None).cast("string")
    made = df.select(
        chunks.claim_text(c("ct"), c("claim"), c("section"), c("heading"), c("text"), c("names")),
        chunks.claim_text(F.lit("claim"), c("claim"), c("section"), c("section"), c("text"), F.array().cast("array<string>")),
        chunks.claim_text(F.lit("claim"), none, none, none, c("text"), F.lit(None).cast("array<string>")),
        chunks.entity_text(F.lit("method"), F.lit("STGCN"), c("section"), F.array(F.lit("Abstract"), F.lit("Results")), F.lit("T")),
        chunks.section_text(c("section"), c("heading"), c("text"), F.lit("T")),
        chunks.figure_text(F.lit("2"), F.lit("A plot."), F.lit("T")),
        chunks.figure_text(F.lit(""), F.lit("A plot."), F.lit("T")),
    ).first()
    assert list(made) == [
        "limitation in Results | Speed:\nIt is slow.\nentities: A, B", "performance claim in Results:\nIt is slow.", "claim in :\nIt is slow.", "method: STGCN\nappears in: Results, Abstract\npaper: T",
        "Results section — Speed | paper: T\n\nIt is slow.", "figure 2 caption | paper: T:\nA plot.", "figure caption | paper: T:\nA plot.",
    ]


def test_rules_on_cases_of_their_own(spark):
    df = spark.createDataFrame([("dgx",), ("adam",), ("transformer base",), ("graph system",), ("code model",), ("pointer net",), ("convnet",)], "n string")
    assert [tuple(r) for r in df.select(tx.method_class(F.col("n")), tx.method_family(F.col("n"))).collect()] == [
        ("NOT_METHOD", "dgx"), ("NOT_METHOD", "adam"), ("VALID_METHOD", "transformer models"), ("NOT_METHOD", "graph system"), ("WEAK_METHOD", "code model"), ("WEAK_METHOD", "pointer net"), ("NOT_METHOD", "convolutional models"),
    ]
    kinds = {"Hardware and Schedule": "Experiments", "Why Self-Attention": "Discussion", "Appendix": "References", "Benchmark": "Results", "2 Background": "Background", "Model": "Methods", "x": "Unknown"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in kinds], "h string").select("h", tx.section_type(F.col("h"))).collect()} == kinds
    said = {"quadratic memory in context length hurts scalability": True, "dropout is limited to one layer only": False, "You stupid worthless trash": False, "Only a few runs": False}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in said], "t string").select("t", tx.meaningful_limitation(F.col("t"))).collect()} == said
    asked = {"what is bert?": "entity_lookup", "give an overview": "literature_review", "which pairs have not been tested": "gap", "hello": "general", "does it conflict": "comparison"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in asked], "q string").select("q", tx.intent(F.col("q"))).collect()} == asked


def test_filters_compile(spark):
    df = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "n int, s string")
    count = lambda where: df.where(chunks.compile_filter(where)).count()
    assert (count(None), count({"n": {"$gte": 4, "$lt": 8}}), count({"$or": [{"n": 0}, {"s": {"$eq": "x"}}]}), count({"s": {"$in": ["x"]}})) == (10, 4, 6, 5)
    with pytest.raises(ValueError):
        chunks.compile_filter({"n": {"$like": 1}})


def test_gaps_and_cooccurrence_make_the_product(spark):
    m = spark.createDataFrame([(1, "stgcn", "pemsd7"), (2, "dcrnn", "metr-la"), (2, "dcrnn", "pems-bay")], "paper_id int, method string, dataset string")
    gaps = {(r.method, r.dataset, r.gap_score) for r in entities.gap_matrix(m).collect()}
    assert gaps == {("stgcn", "metr-la", 2), ("stgcn", "pems-bay", 2), ("dcrnn", "pemsd7", 2)}
    assert entities.cooccurrence(m, "method", "dataset").count() + len(gaps) == 2 * 3


def test_similarities_are_bounded_and_symmetric(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (["a"], ["a"])], "x array<string>, y array<string>")
    got = df.select(scores.jaccard(F.col("x"), F.col("y")).alias("a"), scores.jaccard(F.col("y"), F.col("x")).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [1 / 3, 0.0, 1.0]


def test_bandit_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, r = rng.normal(size=(40, 3)), rng.random(40)
    rows = spark.createDataFrame([(i % 2, x[i].tolist(), float(r[i])) for i in range(40)], "arm int, x array<double>, r double")
    for m in ranking.linucb_models(rows, "arm", "x", "r").collect():
        s, t = x[m.arm::2], r[m.arm::2]
        assert np.allclose(m.theta, np.linalg.solve(np.eye(3) + s.T @ s, s.T @ t))


def test_bandit_sums_and_scores_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3)], None if i % 7 == 0 else float(i)) for i in range(40)]
    rows += [(40, "a", None, 1.0), (41, "a", [], 1.0), (42, "b", [1.0, 2.0], 1.0), (43, None, [1.0, None, 3.0], 2.0)]
    table = spark.createDataFrame(rows, "k int, arm string, x array<double>, r double")
    a, b = {}, {}
    for _, arm, x, r in rows:
        for i, j in ((i, j) for i in range(len(x or ())) for j in range(i, len(x))):
            a.setdefault((arm, i, j), []).extend([x[i] * x[j]] if None not in (x[i], x[j]) else [])
            b.setdefault((arm, i, j), []).extend([x[i] * r] if i == j and None not in (x[i], r) else [])
    sums = ranking.linucb_statistics(table, "arm", "x", "r")
    assert "Generate" not in sums._jdf.queryExecution().optimizedPlan().toString()  # no row a cell of each vector
    found = {(s.arm, s.i, s.j): (s.a, s.b) for s in sums.collect()}
    assert found.keys() == a.keys()
    for k, (x, y) in found.items():
        assert (x == pytest.approx(sum(a[k])) if a[k] else x is None) and (y == pytest.approx(sum(b[k])) if b[k] else y is None)
    models = spark.createDataFrame([("p", [1.0, 0.0, 2.0], [float(v) for v in np.eye(3).ravel()]), ("q", [0.0, 0.0, 0.0], [4.0 * float(v) for v in np.eye(3).ravel()])], "arm string, theta array<double>, inverse array<double>")
    for held in (ranking.HELD, 5):  # at once, and an arm or so in a turn
        monkeypatch.setattr(ranking, "HELD", held)
        got = {(s.k, s.arm): s.score for s in ranking.linucb_scores(table.select("k", "x"), models, "x", 0.5).collect()}
        assert len(got) == 2 * len(rows)
        for k, _, x, _ in rows:
            whole = x is not None and len(x) == 3 and None not in x
            want = (x[0] + 2 * x[2] + 0.5 * np.linalg.norm(x), np.linalg.norm(x)) if whole else (None, None)
            assert (got[k, "p"], got[k, "q"]) == (pytest.approx(want) if whole else want)


def test_leaders_partition_the_items(spark):
    items = spark.createDataFrame([(0, i) for i in range(8)], "g int, x int")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 3, 4)], "g int, a int, b int")
    found = {r.x: r.leader for r in ranking.leader_clusters(pairs, items, "g", "x").collect()}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    runs = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        runs.append([tuple(r) for r in QUERIES["gap_matrix_topk"](spark, "/root/testdata/sf0.001").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1] and len(runs[0]) == 20


def test_spans_of_tags(spark):
    rows = spark.createDataFrame(list(enumerate(["B-a", "I-a", "O", "I-b", "B-b", "I-a", "B-subtask", "I-task"])), "i int, tag string").withColumn("g", F.lit(1))
    assert [(r.kind, r.start, r.end) for r in sequences.bio_spans(rows, "g", ["i"], "tag").orderBy("start").collect()] == [("a", 1, 2), ("b", 4, 4), ("b", 5, 5), ("a", 6, 6), ("subtask", 7, 7), ("task", 8, 8)]


def test_last_claims_win(spark):
    c = spark.createDataFrame([(1, 1, "m", 1.0), (2, 1, "m", 5.0), (3, 2, "m", 5.01)], "claim_id int, paper_id int, metric string, value double")
    assert [r.value_a for r in claims.metric_agreements(c, ["metric"], ["claim_id"]).collect()] == [5.0]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">A Title</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ada</forename><surname>Byron</surname></persName></author></analytic><monogr><imprint><date when="2018-05-01"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader><text><body><div><head n="1">1 Introduction</head><p>One <ref>[1]</ref>two.</p></div><div><head>Methods</head><p>Three.</p><p>Four.</p></div>
<figure xml:id="f0"><head>Figure 1</head><label>1</label><figDesc>A figure that shows the thing.</figDesc></figure><figure type="table" xml:id="t0"><head>Table 1</head><label>2</label><figDesc>Numbers</figDesc><table><row><cell>a</cell><cell>1</cell></row><row><cell></cell></row></table></figure></body></text></TEI>"""


def test_tei_is_read_into_parts(spark):
    rows = tei.parse(spark.createDataFrame([("p", TEI), ("q", "<TEI"), ("r", None)], "paper_id string, xml string"), "xml").collect()
    p = {r.paper_id: r for r in rows}
    assert (p["p"].success, p["q"].success, p["r"].success) == (True, False, False)
    d = p["p"].document
    assert (d.title, d.authors, d.year, d.doi, d.abstract) == ("A Title", ["Ada Byron"], 2018, "10.1/x", "Short.")
    assert [(s.heading, s.text) for s in d.sections] == [("1 Introduction", "One two."), ("Methods", "Three.\nFour.")]
    assert [(f.figure_id, f.label) for f in d.figures] == [("f0", "1")] and [t.label for t in d.tables] == ["2"] and [t.rows for t in d.tables] == [[["a", "1"]]]


def test_feed_entries(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1709.04875v4</id><title>T  t</title><summary> s </summary><published>2017</published><author><name>A</name></author><link title="pdf" href="http://x/pdf"/></entry></feed>'
    (row,) = feeds.parse_atom(spark.createDataFrame([(atom,)], "xml string"), "xml").collect()
    assert (row.id, row.title, row.authors, row.abstract, row.pdf_url) == ("1709.04875", "T t", ["A"], "s", "http://x/pdf")
    assert feeds.search_query("graph networks") == '(ti:graph AND ti:networks) OR (abs:graph AND abs:networks)' and feeds.search_query('"a b"') == 'abs:"a b"'


def test_sessions_follow_the_routes():
    log = []
    agents = {n: (lambda state, n=n: log.append(n) or {"trace": [n], "n_papers": 3 if n == "reader" else state.get("n_papers", 0)}) for n in plan.AGENTS}
    state = plan.run_session(agents, {})
    assert log == ["reader", "comparator", "critic", "gap_detector", "writer"] == state["trace"]
    log.clear()
    plan.run_session(agents | {"reader": lambda s: log.append("reader") or {"n_papers": 1}}, {})
    assert log == ["reader", "writer"]


def test_steps_run_only_where_output_is_missing(spark):
    steps = plan.pending(spark.createDataFrame([("a",), ("b",)], "paper_id string"), {"parse": spark.createDataFrame([("a",)], "paper_id string"), "ner": spark.createDataFrame([], "paper_id string")}, "paper_id")
    assert {(r.paper_id, r.step) for r in steps.collect()} == {("b", "parse"), ("a", "ner"), ("b", "ner")}


def test_answers_are_read_leniently(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("none",), ('x {"a": {"b": 2}} y',)], "t string")
    assert [r[0] for r in df.select(tx.repair_json(F.col("t"))).collect()] == ['{"a": 1}', None, '{"a": {"b": 2}}']
