"""Queries over the graph of papers, entities and statements, and over parsed papers and their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as op
from ..operators.papers import setup_sections
from .paper_queries import _PAIR_ROWS, compared_papers, neighbours, results_of_pairs
from .registry import Tables, query

_LINES = """l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
  s AS (SELECT *, CASE pos % 5 WHEN 1 THEN 'limitation' WHEN 3 THEN 'future_work' ELSE 'claim' END AS kind FROM l WHERE trim(line) <> '')"""


def statements(t: Tables) -> DataFrame:
    """Lines of documents as statements, in turn claims, limitations and future work; the place is the number of the line."""
    kind = F.when(F.col("pos") % 5 == 1, "limitation").when(F.col("pos") % 5 == 3, "future_work").otherwise("claim")
    rows = t.documents.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    return rows.select("paper_id", "pos", F.col("line").alias("text"), kind.alias("kind"))


@query(
    "statement_nodes",
    f"""WITH {_LINES} SELECT doc_id || CASE kind WHEN 'limitation' THEN '::lim::' ELSE '::fw::' END || pos AS node_id, CASE kind WHEN 'limitation' THEN 'LimitationStatement' ELSE 'FutureWork' END AS node_type, substr(line, 1, 80) AS label,
      CASE kind WHEN 'limitation' THEN 'has_limitation' ELSE 'has_future_work' END AS edge_type FROM s WHERE kind <> 'claim'""",
)
def statement_nodes(t: Tables) -> DataFrame:
    nodes, edges = op.statement_graph(statements(t))
    return nodes.join(edges, F.col("node_id") == F.col("dst")).select("node_id", "node_type", "label", "edge_type")


_RELATED = f"""{_PAIR_ROWS}, n AS (SELECT paper_a, paper_b, count(*) FILTER (diff > 0.5 * greatest(value_a, value_b)) AS n_against, count(*) FILTER (diff <= 0.1 * greatest(value_a, value_b)) AS n_agree FROM found GROUP BY ALL),
  r AS (SELECT f.*, CASE WHEN cites AND year_diff > 3 THEN 'extends' WHEN coalesce(n_against, 0) > 0 THEN 'contradicts' WHEN setup > 0.8 THEN 'complements' WHEN coalesce(n_agree, 0) > 0 THEN 'agrees_with' WHEN shared_method + shared_dataset > 0 THEN 'parallel' ELSE 'neutral' END AS relation
    FROM f LEFT JOIN n USING (paper_a, paper_b)),
  named AS (SELECT paper_a, paper_b, list_sort(list(DISTINCT a.entity)) AS shared FROM pairs JOIN entities AS a ON a.paper_id = paper_a JOIN entities AS b ON b.paper_id = paper_b AND b.kind = a.kind AND b.entity = a.entity WHERE a.kind = 'dataset' GROUP BY ALL),
  e AS (SELECT paper_a, paper_b, 0 AS place, 'contradicts' AS edge_type, dataset AS detail FROM r JOIN found USING (paper_a, paper_b) WHERE relation = 'contradicts' AND diff > 0.5 * greatest(value_a, value_b) AND subject_a = subject_b
    UNION ALL SELECT paper_a, paper_b, 0, relation, '' FROM r WHERE relation IN ('complements', 'extends')
    UNION ALL SELECT paper_a, paper_b, 0, 'similar_to', array_to_string(shared[1:5], ',') FROM r JOIN named USING (paper_a, paper_b) WHERE relation IN ('parallel', 'neutral')
    UNION ALL SELECT paper_a, paper_b, 1, 'agrees_with', dataset FROM r JOIN found USING (paper_a, paper_b) WHERE diff <= 0.1 * greatest(value_a, value_b))"""


def compared(t: Tables) -> DataFrame:
    """The edges of all given pairs: results that differ by half contradict, unless about other subjects; setups far apart complement;
    close results agree; a cited paper of much earlier is extended."""
    rows = compared_papers(t, ("method", "dataset"))
    most = lambda x: F.greatest(x["value_a"], x["value_b"])
    far = lambda x: x["diff"] > 0.5 * most(x)
    found = F.coalesce("found", F.array().cast(rows.schema["found"].dataType))
    agreed = F.filter(found, lambda x: ~far(x) & (x["diff"] <= 0.1 * most(x)))
    against = F.filter(found, far)
    names = lambda c: F.transform(c, lambda x: x["dataset"])
    other = lambda x: F.coalesce(x["subject_a"] != x["subject_b"], F.lit(False))
    answered = F.when(F.col("cites") & (F.col("year_diff") > 3), "extends")
    relation = op.relationship(F.size(against), (F.col("setup") > 0.8).cast("int"), F.size(agreed), F.col("shared_method") + F.col("shared_dataset"), answered)
    shared = F.coalesce(F.array_intersect("dataset_a", "dataset_b"), F.array().cast("array<string>"))
    return op.nested_edges(rows.select("paper_a", "paper_b", relation.alias("relation"), shared.alias("shared"), names(F.filter(against, lambda x: ~other(x))).alias("against"), names(agreed).alias("agreed")))


@query("comparison_graph", f"WITH {_RELATED} SELECT paper_a, paper_b, edge_type, count(*) AS n, min(detail) AS first FROM e GROUP BY ALL")
def comparison_graph(t: Tables) -> DataFrame:
    """Edges of all five types between compared papers, gathered to one of each type."""
    return compared(t).groupBy("paper_a", "paper_b", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.min("detail").alias("first"))


@query("collapsed_graph", f"WITH {_RELATED} SELECT paper_a, paper_b, edge_type, detail FROM (SELECT *, row_number() OVER (PARTITION BY paper_a, paper_b ORDER BY place DESC, edge_type DESC, detail DESC) AS n FROM e) WHERE n = 1")
def collapsed_graph(t: Tables) -> DataFrame:
    """At most one edge for each pair, the last one added: what a simple graph keeps."""
    return op.collapsed(compared(t), "paper_a", "paper_b", ["place", "edge_type", "detail"]).select("paper_a", "paper_b", "edge_type", "detail")


_CLEAN = "regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')"


@query(
    "parsed_papers",
    f"""WITH d AS (SELECT doc_id, doc_id % 11 <> 0 AS ok, len(list_filter(string_split({_CLEAN}, chr(10)), lambda x: regexp_matches(x, '[^ -~]|[!-~]'))) AS n FROM documents)
    SELECT doc_id, ok AS success, CASE WHEN ok THEN 'A Study of Words' ELSE '' END AS title, CASE WHEN ok THEN 'Ada Lovelace' ELSE '' END AS authors, CASE WHEN ok THEN 1 + (doc_id % 3 = 1)::INT ELSE -1 END AS n_figures,
      CASE WHEN ok THEN 1 ELSE -1 END AS n_tables, CASE WHEN NOT ok THEN '' WHEN doc_id % 2 = 0 THEN 'These are the results of all runs.' ELSE 'Scores of the systems.' END AS caption,
      CASE WHEN NOT ok THEN -1 WHEN doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_rows, CASE WHEN ok THEN n::INT ELSE -1 END AS n_sections FROM d""",
)
def parsed_papers(t: Tables) -> DataFrame:
    """Documents as parsed papers: a section for each line, some figures and a table, garbled here and there, and repaired by the reader."""
    from ..sources.tei import parse

    k = F.col("doc_id")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    escaped = F.replace(F.replace(F.replace(clean, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<div><head>2 Results</head><p>"), x, F.lit("</p></div>"))), "")
    wrong = F.lit("<div><head>Figure 3</head><p>no section</p></div>")
    figures = F.concat(
        F.lit('<figure xml:id="f0"><label>1</label><figDesc>short</figDesc></figure><figure xml:id="f0"><label>1</label><figDesc>a plot</figDesc></figure><figure xml:id="f1"><figDesc>'),
        F.when(k % 3 == 0, "We execute the plan in very many words").when(k % 3 == 1, "A caption that is long enough to stay.").otherwise("short"), F.lit("</figDesc></figure>"),
    )
    rows = F.when(k % 5 == 0, "<row><cell>we see that the system is the best of all</cell></row>" * 5).otherwise("<row><cell>a</cell><cell> </cell><cell>1</cell></row><row/><row><cell>b</cell><cell>2</cell></row>")
    table = F.concat(F.lit('<figure type="table" xml:id="t0"><figDesc>'), F.when(k % 2 == 0, "We execute it. These are the results of all runs").otherwise("Scores of the systems."), F.lit("</figDesc><table>"), rows, F.lit("</table></figure>"))
    head = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">Proceedings of it. A Study of Words</title></titleStmt></fileDesc><persName><forename>Ada</forename><surname>Lovelace</surname></persName><persName><forename>Google</forename><surname>Brain</surname></persName></teiHeader><text><body>'
    xml = F.when(k % 11 == 0, "<TEI>").otherwise(F.concat(F.lit(head), body, wrong, F.lit("</body>"), figures, table, F.lit("</text></TEI>")))
    d = F.col("document")
    text, size = (lambda c: F.coalesce(c, F.lit(""))), (lambda c: F.coalesce(F.array_size(c), F.lit(-1)))
    return parse(t.documents.select("doc_id", xml.alias("xml")), "xml").select(
        "doc_id", "success", text(d["title"]).alias("title"), text(F.array_join(d["authors"], ";")).alias("authors"), size(d["figures"]).alias("n_figures"), size(d["tables"]).alias("n_tables"),
        text(d["tables"][0]["caption"]).alias("caption"), size(d["tables"][0]["rows"]).alias("n_rows"), size(d["sections"]).alias("n_sections"),
    )


@query(
    "setup_sections",
    """WITH s AS (SELECT p_brand AS paper, p_partkey AS section, p_name || CASE WHEN p_size % 10 = 0 AND p_brand LIKE '%1' THEN ' training procedure' ELSE '' END AS heading FROM part),
    m AS (SELECT *, regexp_matches(lower(heading), 'experiments|experimental|implementation|training|setup|methodology|methods|hyperparameters') AS own FROM s)
    SELECT paper, section FROM (SELECT *, bool_or(own) OVER (PARTITION BY paper) AS any_own FROM m) WHERE own OR NOT any_own""",
)
def setup_sections_of_papers(t: Tables) -> DataFrame:
    """Sections that may say how a paper's experiments were set up: those whose heading says so, else all."""
    heading = F.concat("p_name", F.when((F.col("p_size") % 10 == 0) & F.col("p_brand").endswith("1"), " training procedure").otherwise(""))
    rows = t.part.select(F.col("p_brand").alias("paper"), F.col("p_partkey").alias("section"), heading.alias("heading"), F.lit("").alias("section_type"))
    return setup_sections(rows, "paper").select("paper", "section")


_LIST = "coalesce(nullif(array_to_string(list_transform({0}[1:{1}], lambda x: '- ' || x), chr(10)), ''), '(none)')"


@query(
    "pair_prompts",
    f"""WITH {_PAIR_ROWS}, same AS (SELECT p.paper_a, p.paper_b, list_sort(list(DISTINCT a.entity) FILTER (a.kind = 'method')) AS m, list_sort(list(DISTINCT a.entity) FILTER (a.kind = 'dataset')) AS d FROM pairs AS p
      JOIN entities AS a ON a.paper_id = p.paper_a JOIN entities AS b ON b.paper_id = p.paper_b AND b.kind = a.kind AND b.entity = a.entity GROUP BY ALL),
    against AS (SELECT paper_a, paper_b, list_sort(list(dataset) FILTER (diff > 0.5 * greatest(value_a, value_b))) AS c FROM found GROUP BY ALL)
    SELECT p.paper_a, p.paper_b, sha256('Task:' || chr(10) || 'Compare papers ' || p.paper_a || ' and ' || p.paper_b || '. Answer with one JSON object: relationship, and for each contradiction real, explains or neutral.' || chr(10) || chr(10)
      || 'Shared methods:' || chr(10) || {_LIST.format("m", 5)} || chr(10) || chr(10) || 'Shared datasets:' || chr(10) || {_LIST.format("d", 5)} || chr(10) || chr(10) || 'Contradictions:' || chr(10) || {_LIST.format("c", 3)} || chr(10) || chr(10) || 'Complements:' || chr(10) || '(none)') AS hash
    FROM pairs AS p LEFT JOIN same USING (paper_a, paper_b) LEFT JOIN against USING (paper_a, paper_b)""",
)
def pair_prompts(t: Tables) -> DataFrame:
    """What a model is asked about each pair of papers, by its hash."""
    from ..functions.prompts import pair_prompt

    sets = t.mentions.groupBy("paper_id").agg(F.collect_set("method").alias("m"), F.collect_set("dataset").alias("d"))
    side = lambda x: sets.select(F.col("paper_id").alias(f"paper_{x}"), F.col("m").alias(f"m{x}"), F.col("d").alias(f"d{x}"))
    found = results_of_pairs(t).where(F.col("diff") > 0.5 * F.greatest("value_a", "value_b")).groupBy("paper_a", "paper_b").agg(F.array_sort(F.collect_list("dataset")).alias("c"))
    rows = neighbours(t).select("paper_a", "paper_b").join(side("a"), "paper_a", "left").join(side("b"), "paper_b", "left").join(found, ["paper_a", "paper_b"], "left")
    shared = lambda k: F.array_sort(F.array_intersect(f"{k}a", f"{k}b"))
    text = pair_prompt(F.col("paper_a"), F.col("paper_b"), shared("m"), shared("d"), F.col("c"), F.array().cast("array<string>"))
    return rows.select("paper_a", "paper_b", F.sha2(text, 256).alias("hash"))


@query(
    "critique_prompts",
    """WITH {CLAIMS}, c AS (SELECT paper_id, list(metric || ' ' || coalesce(dataset, 0) ORDER BY claim_id) AS l FROM claims WHERE paper_id IS NOT NULL GROUP BY paper_id), w AS (SELECT doc_id, ['low quality'] AS w FROM labels WHERE quality = 0 GROUP BY doc_id)
    SELECT paper_id, sha256('Task:' || chr(10) || 'Name further weaknesses of paper ' || paper_id || ' as one JSON list. Claim nothing to be absent that is listed.' || chr(10) || chr(10) || 'Claims:' || chr(10) || """ + _LIST.format("l", 8) + """ || chr(10) || chr(10)
      || 'Limitations:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Found already:' || chr(10) || """ + _LIST.format("w", 6) + """) AS hash FROM c LEFT JOIN w ON doc_id = paper_id""",
)
def critique_prompts(t: Tables) -> DataFrame:
    """What a model is asked about each paper beside what rules have found, by its hash; no more claims are gathered than it shows."""
    from pyspark.sql import Window

    from ..functions.prompts import CAPS, critique_prompt

    first = F.row_number().over(Window.partitionBy("paper_id").orderBy("claim_id"))
    claims = t.claims.where("paper_id IS NOT NULL").select("paper_id", "claim_id", F.concat_ws(" ", "metric", F.coalesce("dataset", F.lit(0)).cast("string")).alias("line")).withColumn("n", first).where(F.col("n") <= CAPS["claims"])
    lines = claims.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("l"))
    weak = t.labels.where("quality = 0").select(F.col("doc_id").alias("paper_id"), F.array(F.lit("low quality")).alias("w")).distinct()
    rows = lines.join(weak, "paper_id", "left")
    return rows.select("paper_id", F.sha2(critique_prompt(F.col("paper_id"), F.col("l"), F.array().cast("array<string>"), F.col("w")), 256).alias("hash"))
