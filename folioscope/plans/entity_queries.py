"""Queries over papers and their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fixed
from ..operators import entities as op
from .registry import Tables, query

_FINISHED = "o_orderpriority LIKE '1%' AND o_orderstatus = 'F'"


def gap_cells(t: Tables) -> DataFrame:
    """Parts as methods and nations as datasets, of finished orders of the first priority."""
    papers = t.orders.where(_FINISHED).select(F.col("o_orderkey").alias("paper_id"))
    return op.gap_matrix(t.mentions.join(papers, "paper_id", "left_semi"), "part_id", "dataset")


GAPS = f"""{{MENTIONS}},
e AS (SELECT * FROM mentions WHERE paper_id IN (SELECT o_orderkey FROM orders WHERE {_FINISHED})),
m AS (SELECT part_id, count(DISTINCT paper_id) AS n_method_papers FROM e GROUP BY part_id),
d AS (SELECT dataset, count(DISTINCT paper_id) AS n_dataset_papers FROM e GROUP BY dataset),
seen AS (SELECT DISTINCT a.part_id, b.dataset FROM e AS a JOIN e AS b USING (paper_id)),
gaps AS (
  SELECT part_id, dataset, n_method_papers, n_dataset_papers, n_method_papers + n_dataset_papers AS gap_score
  FROM m CROSS JOIN d ANTI JOIN seen USING (part_id, dataset))"""


@query("gap_matrix_topk", f"WITH {GAPS} SELECT part_id, dataset, n_method_papers, n_dataset_papers, gap_score, gap_score / 10.0 AS display_score FROM gaps ORDER BY gap_score DESC, part_id, dataset LIMIT 20")
def gap_matrix_topk(t: Tables) -> DataFrame:
    top = gap_cells(t).orderBy(F.col("gap_score").desc(), "part_id", "dataset").limit(20)
    return top.select("part_id", "dataset", "n_method_papers", "n_dataset_papers", "gap_score", (F.col("gap_score") / 10.0).alias("display_score"))


@query("gap_matrix_cells", f"WITH {GAPS} SELECT part_id, dataset, gap_score FROM gaps")
def gap_matrix_cells(t: Tables) -> DataFrame:
    return gap_cells(t).select("part_id", "dataset", "gap_score")


@query(
    "entity_linking",
    """WITH {MENTIONS}, p AS (SELECT DISTINCT paper_id, part_id FROM mentions), g AS (SELECT part_id, list_sort(list(paper_id)) AS papers FROM p GROUP BY part_id)
    SELECT paper_id, part_id, array_to_string(list_filter(papers, lambda x: x <> paper_id), ',') AS also_in_papers, CAST(len(papers) AS INTEGER) AS appears_in_n_papers FROM p JOIN g USING (part_id)""",
)
def entity_linking(t: Tables) -> DataFrame:
    return op.link_across_papers(t.mentions, ["part_id"]).withColumn("also_in_papers", F.array_join("also_in_papers", ","))


@query(
    "entity_spread",
    """WITH {MENTIONS}, p AS (SELECT DISTINCT paper_id, lower(raw_text) AS entity, method FROM mentions), g AS (SELECT entity, method, count(*) AS n FROM p GROUP BY entity, method)
    SELECT paper_id, entity, method, n AS appears_in_n_papers FROM p JOIN g USING (entity, method)""",
)
def entity_spread(t: Tables) -> DataFrame:
    return op.spread_across_papers(t.mentions.select("paper_id", F.lower("raw_text").alias("entity"), "method"), ["entity", "method"])


@query(
    "overlap_ranking",
    """WITH {MENTIONS}, p AS (SELECT DISTINCT paper_id, part_id FROM mentions), n AS (SELECT paper_id, count(*) AS n FROM p GROUP BY paper_id),
    s AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS n_shared FROM p AS a JOIN p AS b USING (part_id) WHERE a.paper_id < b.paper_id GROUP BY 1, 2),
    j AS (SELECT paper_a, paper_b, n_shared, n_shared * 1.0 / (x.n + y.n - n_shared) AS j FROM s JOIN n AS x ON x.paper_id = paper_a JOIN n AS y ON y.paper_id = paper_b)
    SELECT paper_a, paper_b, n_shared, floor(j * 10000 + 0.5) / 10000 AS jaccard FROM j WHERE j >= 0.01 ORDER BY j DESC, paper_a, paper_b LIMIT 20""",
)
def overlap_ranking(t: Tables) -> DataFrame:
    top = op.closest_pairs(t.mentions, "paper_id", "part_id", 20).where("jaccard >= 0.01").orderBy(F.col("jaccard").desc(), "a", "b")
    return top.select(F.col("a").alias("paper_a"), F.col("b").alias("paper_b"), "n_shared", fixed(F.col("jaccard")).alias("jaccard"))


_PAPERS = "SELECT o_orderkey AS paper_id, year(o_orderdate) AS year FROM orders WHERE o_orderkey IN (SELECT paper_id FROM mentions WHERE {0})"


@query("papers_using_method", "WITH {MENTIONS} " + _PAPERS.format("method = 'Brand#1'"))
def papers_using_method(t: Tables) -> DataFrame:
    papers = t.orders.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").cast("long").alias("year"))
    return op.papers_with(t.mentions, papers, F.col("method") == "Brand#1")


@query("papers_on_dataset", "WITH {MENTIONS} " + _PAPERS.format("dataset = 'NATION_3'"))
def papers_on_dataset(t: Tables) -> DataFrame:
    papers = t.orders.select(F.col("o_orderkey").alias("paper_id"), F.year("o_orderdate").cast("long").alias("year"))
    return op.papers_with(t.mentions, papers, F.col("dataset") == "NATION_3")


@query(
    "entities_of_paper",
    """WITH {MENTIONS}, f AS (SELECT paper_id, method, min(pos) AS first FROM mentions GROUP BY paper_id, method)
    SELECT paper_id, string_agg(method, ',' ORDER BY first, method) AS methods, count(*) AS n_methods FROM f GROUP BY paper_id""",
)
def entities_of_paper(t: Tables) -> DataFrame:
    firsts = t.mentions.groupBy("paper_id", "method").agg(F.min("pos").alias("first"))
    rows = F.array_sort(F.collect_list(F.struct("first", "method")))
    return firsts.groupBy("paper_id").agg(F.array_join(F.transform(rows, lambda r: r["method"]), ",").alias("methods"), F.count(F.lit(1)).alias("n_methods"))


_EDGE_TYPES = {"method": "uses", "dataset": "evaluates_on", "task": "addresses"}


@query(
    "graph_summary",
    """WITH {MENTIONS}, nodes AS (SELECT DISTINCT 'paper' AS kind, CAST(paper_id AS VARCHAR) AS id FROM mentions UNION ALL SELECT DISTINCT 'method', lower(method) FROM mentions
      UNION ALL SELECT DISTINCT 'dataset', lower(dataset) FROM mentions UNION ALL SELECT DISTINCT 'task', lower(task) FROM mentions),
    edges AS (SELECT DISTINCT 'uses' AS kind, paper_id, lower(method) AS e FROM mentions UNION ALL SELECT DISTINCT 'evaluates_on', paper_id, lower(dataset) FROM mentions
      UNION ALL SELECT DISTINCT 'addresses', paper_id, lower(task) FROM mentions)
    SELECT 'node' AS part, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind""",
)
def graph_summary(t: Tables) -> DataFrame:
    nodes, edges = op.graph_nodes_and_edges(t.mentions, _EDGE_TYPES)
    count = lambda df, kind, part: df.groupBy(F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return count(nodes, F.col("node_type"), "node").unionByName(count(edges, F.col("edge_type"), "edge"))


@query(
    "canonical_entities",
    """WITH {MENTIONS}, k AS (SELECT trim(regexp_replace(regexp_replace(lower(raw_text), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', ' ', 'g')) AS c, raw_text, paper_id FROM mentions)
    SELECT 'method::' || c AS entity_id, c AS canonical_text, array_to_string(list_sort(list(DISTINCT raw_text)), '|') AS raw_variants, count(DISTINCT paper_id) AS n_papers,
           min(paper_id) AS first_paper FROM k GROUP BY c""",
)
def canonical_entities(t: Tables) -> DataFrame:
    found = op.canonical_entities(t.mentions, "method", "raw_text")
    return found.select("entity_id", "canonical_text", F.array_join("raw_variants", "|").alias("raw_variants"), "n_papers", "first_paper")


@query(
    "best_mention",
    """WITH {MENTIONS} SELECT paper_id, method, task, dataset, confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY paper_id, method ORDER BY confidence DESC, pos, part_id, dataset, price) AS n FROM mentions) WHERE n = 1""",
)
def best_mention(t: Tables) -> DataFrame:
    best = op.best_mention(t.mentions, ["paper_id", "method"], "confidence", ["pos", "part_id", "dataset", "price"])
    return best.select("paper_id", "method", "task", "dataset", "confidence")


@query(
    "entity_dedup_sections",
    """WITH {MENTIONS}, f AS (SELECT paper_id, method, task, min(pos) AS first, max(confidence) AS c FROM mentions GROUP BY ALL)
    SELECT paper_id, method, max(c) AS confidence, string_agg(task, ',' ORDER BY first, task) AS sections FROM f GROUP BY paper_id, method""".replace("GROUP BY ALL", "GROUP BY paper_id, method, task"),
)
def entity_dedup_sections(t: Tables) -> DataFrame:
    return op.dedup_mentions(t.mentions, ["paper_id", "method"], "task", "confidence", "pos").withColumn("sections", F.array_join("sections", ","))


@query(
    "entity_index_counts",
    """WITH {MENTIONS} SELECT 'method' AS kind, lower(method) AS entity, count(*) AS n_mentions, count(DISTINCT paper_id) AS n_papers FROM mentions GROUP BY 2
    UNION ALL SELECT 'dataset', lower(dataset), count(*), count(DISTINCT paper_id) FROM mentions GROUP BY 2
    UNION ALL SELECT 'task', lower(task), count(*), count(DISTINCT paper_id) FROM mentions GROUP BY 2""",
)
def entity_index_counts(t: Tables) -> DataFrame:
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lower(k).alias("entity")) for k in ("method", "dataset", "task"))))
    rows = t.mentions.select("paper_id", kinds.alias("e")).select("paper_id", "e.kind", "e.entity")
    per_paper = rows.groupBy("kind", "entity", "paper_id").agg(F.count(F.lit(1)).alias("n"))
    return per_paper.groupBy("kind", "entity").agg(F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_papers"))


@query(
    "coverage_gain",
    """WITH {MENTIONS}, k AS (SELECT DISTINCT part_id, dataset FROM mentions WHERE paper_id % 2 = 0),
    m AS (SELECT DISTINCT paper_id, part_id, dataset FROM mentions WHERE paper_id % 2 = 1)
    SELECT paper_id, count(*) FILTER (k.part_id IS NULL) AS n_new, count(*) AS n_entities, count(*) FILTER (k.part_id IS NULL) * 1.0 / count(*) AS coverage_gain
    FROM m LEFT JOIN k USING (part_id, dataset) GROUP BY paper_id""",
)
def coverage_gain(t: Tables) -> DataFrame:
    m = t.mentions
    return op.coverage_gain(m.where("paper_id % 2 = 1"), m.where("paper_id % 2 = 0"), ["part_id", "dataset"])


@query(
    "entropy_diversity",
    """WITH {MENTIONS}, c AS (SELECT dataset, task, count(*) AS n FROM mentions GROUP BY 1, 2), p AS (SELECT dataset, n * 1.0 / sum(n) OVER (PARTITION BY dataset) AS p FROM c),
    h AS (SELECT dataset, -sum(p * log2(p)) AS h, count(*) AS k FROM p GROUP BY dataset)
    SELECT dataset, floor(CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END * 1000000 + 0.5) / 1000000 AS entropy, k AS n_kinds FROM h""",
)
def entropy_diversity(t: Tables) -> DataFrame:
    return op.type_entropy(t.mentions, "dataset", "task").withColumn("entropy", fixed(F.col("entropy"), 6))


@query(
    "task_dataset_cooccurrence",
    "WITH {MENTIONS} SELECT a.task, b.dataset, count(DISTINCT paper_id) AS n_papers FROM mentions AS a JOIN mentions AS b USING (paper_id) GROUP BY 1, 2",
)
def task_dataset_cooccurrence(t: Tables) -> DataFrame:
    m = t.mentions
    pairs = m.select("paper_id", "task").distinct().join(m.select("paper_id", "dataset").distinct(), "paper_id")
    return pairs.groupBy("task", "dataset").agg(F.count(F.lit(1)).alias("n_papers"))


@query(
    "array_setops",
    """WITH {MENTIONS}, s AS (SELECT paper_id, list_sort(list(DISTINCT method)) AS m, list_sort(list(DISTINCT replace(dataset, 'NATION_', 'Brand#'))) AS d FROM mentions GROUP BY paper_id)
    SELECT paper_id, array_to_string(list_sort(list_distinct(list_concat(m, d))), ',') AS either, array_to_string(list_sort(list_intersect(m, d)), ',') AS both,
           array_to_string(list_filter(m, lambda x: NOT list_contains(d, x)), ',') AS only_methods FROM s""",
)
def array_setops(t: Tables) -> DataFrame:
    s = t.mentions.groupBy("paper_id").agg(F.array_sort(F.collect_set("method")).alias("m"), F.array_sort(F.collect_set(F.replace("dataset", F.lit("NATION_"), F.lit("Brand#")))).alias("d"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select("paper_id", text(F.array_union("m", "d")).alias("either"), text(F.array_intersect("m", "d")).alias("both"), text(F.array_except("m", "d")).alias("only_methods"))


@query(
    "top_per_group",
    """WITH {MENTIONS}, c AS (SELECT task, method, count(DISTINCT paper_id) AS n FROM mentions GROUP BY 1, 2)
    SELECT task, method, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, method) AS r FROM c) WHERE r <= 10""",
)
def top_per_group(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    c = t.mentions.select("task", "method", "paper_id").distinct().groupBy("task", "method").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(F.col("n").desc(), "method"))).where("rank <= 10")


@query(
    "batch_of_40",
    """SELECT p_name, CAST((row_number() OVER (ORDER BY p_name) - 1) // 40 AS INTEGER) AS batch FROM (SELECT DISTINCT p_name || '-' || p_brand AS p_name FROM part)""",
)
def batch_of_40(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    names = t.part.select(F.concat_ws("-", "p_name", "p_brand").alias("p_name")).distinct()
    return names.select("p_name", F.floor((F.row_number().over(Window.orderBy("p_name")) - 1) / 40).cast("int").alias("batch"))


@query(
    "paper_flatten",
    """WITH {MENTIONS} SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY pos, part_id, dataset, price, confidence) - 1 AS INTEGER) AS pos, method, dataset FROM mentions""",
)
def paper_flatten(t: Tables) -> DataFrame:
    """Mentions nested into one row a paper, then flattened with their position."""
    row = F.struct("pos", "part_id", "dataset", "price", "confidence", "method")
    nested = t.mentions.groupBy("paper_id").agg(F.array_sort(F.collect_list(row)).alias("mentions"))
    flat = nested.select("paper_id", F.posexplode("mentions").alias("pos", "m"))
    return flat.select("paper_id", "pos", "m.method", "m.dataset")
