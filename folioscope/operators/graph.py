"""The graph of papers, entities and statements, as tables of nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The kinds of statements with the part of their id, the type of their node and of the edge from their paper.
STATEMENTS = {"limitation": ("lim", "LimitationStatement", "has_limitation"), "future_work": ("fw", "FutureWork", "has_future_work")}
LABEL = 80
#: Fixed value: how many shared names an edge between similar papers carries.
SHARED = 5


def statement_graph(statements: DataFrame, paper: str = "paper_id", kind: str = "kind", place: str = "pos", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, node_type, label) and edges (src, dst, edge_type) of limitations and future work: one node a statement, named
    by its paper, kind and place. Other kinds have no node. Repeated rows give one node, with the least of their labels."""
    known = F.create_map(*(F.lit(x) for k, v in STATEMENTS.items() for x in (k, F.struct(*(F.lit(y).alias(n) for n, y in zip(("tag", "node", "edge"), v))))))
    rows = statements.where(F.col(kind).isin(*STATEMENTS)).withColumn("__k", known[F.col(kind)])
    rows = rows.select(F.col(paper).cast("string").alias("src"), F.concat_ws("::", F.col(paper).cast("string"), "__k.tag", F.col(place).cast("string")).alias("dst"), F.col("__k.node").alias("node_type"), F.col("__k.edge").alias("edge_type"), F.substring(F.coalesce(text, F.lit("")), 1, LABEL).alias("label"))
    nodes = rows.groupBy(F.col("dst").alias("node_id"), "node_type").agg(F.min("label").alias("label"))
    return nodes, rows.select("src", "dst", "edge_type").distinct()


def relationship(n_contradictions: Column, n_complements: Column, n_agreements: Column, n_shared: Column, answered: Column | None = None) -> Column:
    """What two papers are to each other: an answer if there is one, else by what was found: contradicts, complements, agrees_with,
    parallel (they share a method or dataset), neutral."""
    found = F.when(n_contradictions > 0, "contradicts").when(n_complements > 0, "complements").when(n_agreements > 0, "agrees_with").when(n_shared > 0, "parallel").otherwise("neutral")
    return found if answered is None else F.coalesce(answered, found)


def comparison_edges(pairs: DataFrame, findings: DataFrame, a: str = "paper_a", b: str = "paper_b", relation: str = "relation", shared: str = "shared") -> DataFrame:
    """``(a, b, place, edge_type, detail)``: the edges of compared pairs, in the order in which they are added.

    ``pairs`` has the relation and the names that both share; ``findings`` (a, b, kind, detail, explained) their contradictions and
    agreements. A contradicting pair has an edge for each contradiction that was not explained away, complementing and extending
    ones have one edge, parallel and neutral ones an edge with up to five shared names, if there are any. Agreements come last.
    """
    key = [a, b]
    named = findings.join(pairs.select(*key, relation), key)
    against = named.where((F.col("kind") == "contradiction") & (F.col(relation) == "contradicts") & ~F.coalesce("explained", F.lit(False))).select(*key, F.lit(0).alias("place"), F.lit("contradicts").alias("edge_type"), "detail")
    one = pairs.where(F.col(relation).isin("complements", "extends")).select(*key, F.lit(0).alias("place"), F.col(relation).alias("edge_type"), F.lit("").alias("detail"))
    alike = pairs.where(F.col(relation).isin("parallel", "neutral") & (F.size(shared) > 0)).select(*key, F.lit(0).alias("place"), F.lit("similar_to").alias("edge_type"), F.array_join(F.slice(F.array_sort(shared), 1, SHARED), ",").alias("detail"))
    agree = named.where(F.col("kind") == "agreement").select(*key, F.lit(1).alias("place"), F.lit("agrees_with").alias("edge_type"), "detail")
    return against.unionByName(one).unionByName(alike).unionByName(agree)


def nested_edges(pairs: DataFrame, a: str = "paper_a", b: str = "paper_b", relation: str = "relation", shared: str = "shared", against: str = "against", agreed: str = "agreed") -> DataFrame:
    """``comparison_edges`` of pairs that bring their findings along: ``against`` (contradictions not explained away) and ``agreed``
    are arrays of details, so that no finding is joined to its pair."""
    edge = lambda place, kind, detail: F.struct(F.lit(place).alias("place"), kind.alias("edge_type"), detail.alias("detail"))
    each = lambda c, place, kind: F.transform(c, lambda x: edge(place, F.lit(kind), x))
    r = F.col(relation)
    names = F.array_join(F.slice(F.array_sort(shared), 1, SHARED), ",")
    first = F.when(r == "contradicts", each(against, 0, "contradicts")).when(r.isin("complements", "extends"), F.array(edge(0, r, F.lit(""))))
    first = first.when(r.isin("parallel", "neutral") & (F.size(shared) > 0), F.array(edge(0, F.lit("similar_to"), names)))
    return pairs.select(a, b, F.inline(F.concat(F.coalesce(first, F.array().cast("array<struct<place:int,edge_type:string,detail:string>>")), each(agreed, 1, "agrees_with"))))


def collapsed(edges: DataFrame, src: str, dst: str, order: Sequence[str], last: bool = True) -> DataFrame:
    """At most one edge for each ordered pair of nodes, as a simple graph keeps it: the last one added, or the first."""
    by = [F.col(c).desc() if last else F.col(c) for c in order]
    return edges.withColumn("__n", F.row_number().over(Window.partitionBy(src, dst).orderBy(*by))).where("__n = 1").drop("__n")
