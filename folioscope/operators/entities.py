"""Entities across papers: linking, roll-ups, co-occurrence and the gap matrix.

Inputs are long tables with a paper column and entity columns; results never depend on row order, as ties are broken by
explicit keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def entity_papers(mentions: DataFrame, entity: str, paper: str = "paper_id") -> DataFrame:
    """Each entity with the number of distinct papers that mention it."""
    return mentions.select(entity, paper).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("n_papers"))


def cooccurrence(mentions: DataFrame, a: str, b: str, paper: str = "paper_id") -> DataFrame:
    """Distinct pairs (a, b) that some paper has both of; one equi-join on the paper."""
    left, right = mentions.select(paper, a).distinct(), mentions.select(paper, b).distinct()
    return left.join(right, paper).select(a, b).distinct()


def gap_matrix(mentions: DataFrame, method: str = "method", dataset: str = "dataset", paper: str = "paper_id") -> DataFrame:
    """Pairs (method, dataset) that no paper has, with a score: papers of the method plus papers of the dataset.

    The product of the two entity lists is the matrix itself, so it is written as a product; observed cells leave by an
    anti-join.
    """
    methods = entity_papers(mentions, method, paper).withColumnRenamed("n_papers", "n_method_papers")
    datasets = entity_papers(mentions, dataset, paper).withColumnRenamed("n_papers", "n_dataset_papers")
    cells = methods.crossJoin(datasets).join(cooccurrence(mentions, method, dataset, paper), [method, dataset], "left_anti")
    return cells.withColumn("gap_score", F.col("n_method_papers") + F.col("n_dataset_papers"))


def link_across_papers(mentions: DataFrame, key: list[str], paper: str = "paper_id") -> DataFrame:
    """For each paper and entity key: the other papers that have it, and in how many papers it appears.

    The list of an entity is as long as the entity is common; for common ones take ``spread_across_papers``, whose rows stay small.
    """
    pairs = mentions.select(paper, *key).distinct()
    everywhere = pairs.groupBy(*key).agg(F.collect_set(paper).alias("papers"))
    others = F.array_sort(F.array_except("papers", F.array(paper)))
    return pairs.join(everywhere, key).select(paper, *key, others.alias("also_in_papers"), F.size("papers").alias("appears_in_n_papers"))


def spread_across_papers(mentions: DataFrame, key: list[str], paper: str = "paper_id") -> DataFrame:
    """For each paper and entity key: in how many papers it appears. Rows stay small however common an entity is."""
    pairs = mentions.select(paper, *key).distinct()
    return pairs.join(pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("appears_in_n_papers")), key).select(paper, *key, "appears_in_n_papers")


def overlap_pairs(members: DataFrame, owner: str, member: str) -> DataFrame:
    """Pairs of owners (a < b) with a shared member, their shared count and Jaccard similarity, by an inverted-index join."""
    m = members.select(owner, member).distinct()
    size = m.groupBy(owner).agg(F.count(F.lit(1)).alias("n"))
    x, y = m.select(F.col(owner).alias("a"), member), m.select(F.col(owner).alias("b"), member)
    shared = x.join(y, member).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))
    sized = shared.join(size.select(F.col(owner).alias("a"), F.col("n").alias("n_a")), "a").join(size.select(F.col(owner).alias("b"), F.col("n").alias("n_b")), "b")
    return sized.withColumn("jaccard", F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared")))


def closest_pairs(members: DataFrame, owner: str, member: str, k: int) -> DataFrame:
    """The ``k`` first of ``overlap_pairs`` by falling similarity, then owners.

    Owners with the same members come first of all. Where these alone are ``k`` pairs no other pair is formed: of one set's owners,
    only the first ``k + 1`` can be in the first ``k`` pairs. Null owners and members stay out.
    """
    members = members.select(owner, member).dropna()
    sets = members.groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias("items"))
    first = sets.withColumn("__n", F.row_number().over(Window.partitionBy("items").orderBy(owner))).where(F.col("__n") <= k + 1)
    owners = first.groupBy("items").agg(F.array_sort(F.collect_list(owner)).alias("o")).where("size(o) > 1").select(F.size("items").alias("n"), "o")
    later = lambda a, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = owners.select("n", F.inline(F.flatten(F.transform("o", later))))
    n = F.col("n").cast("long")
    same = cut(pairs.orderBy("a", "b").limit(k).select("a", "b", n.alias("n_shared"), n.alias("n_a"), n.alias("n_b"), F.lit(1.0).alias("jaccard")))
    if same.count() == k:
        return same
    return overlap_pairs(members, owner, member).orderBy(F.col("jaccard").desc(), "a", "b").limit(k)


def papers_with(mentions: DataFrame, papers: DataFrame, entity: Column, paper: str = "paper_id") -> DataFrame:
    """Papers that have an entity: a semi-join, so a paper comes once."""
    return papers.join(mentions.where(entity).select(paper), paper, "left_semi")


def best_mention(mentions: DataFrame, key: list[str], score: str, pos: list[str]) -> DataFrame:
    """The mention of each key with the highest score; the first position wins ties."""
    order = Window.partitionBy(*key).orderBy(F.col(score).desc(), *pos)
    return mentions.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def dedup_mentions(mentions: DataFrame, key: list[str], section: str, score: str, pos: str) -> DataFrame:
    """One row per key: its highest score, and its sections in order of first appearance."""
    firsts = mentions.groupBy(*key, section).agg(F.min(pos).alias("__first"), F.max(score).alias("__score"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("__first"), F.col(section).alias("s"))))
    return firsts.groupBy(*key).agg(F.max("__score").alias("confidence"), F.transform(rows, lambda r: r["s"]).alias("sections"))


def first_mentions(mentions: DataFrame, key: list[str], section: str, score: str, order: list[str]) -> DataFrame:
    """The first mention of each key, its confidence raised to the highest, and the other sections that name it, sorted."""
    rows = mentions.withColumn("__o", F.struct(*order))
    g = rows.groupBy(*key).agg(F.min_by(section, "__o").alias(section), F.max(score).alias(score), F.array_sort(F.collect_set(section)).alias("__all"))
    return g.select(*key, section, score, F.array_remove("__all", F.col(section)).alias("also_in_sections"))


def entity_index(mentions: DataFrame, kinds: list[str], fields: list[str], order: list[str], paper: str = "paper_id", kind: str = "entity_type", text: str = "text") -> DataFrame:
    """One row a paper: for each of the kinds a map from the text in lower case to its mentions (``fields``), in order."""
    rows = mentions.where(F.col(kind).isin(kinds)).withColumn("__k", F.lower(text))
    lists = rows.groupBy(paper, kind, "__k").agg(F.array_sort(F.collect_list(F.struct(*order, *(F.col(f).alias(f"__{f}") for f in fields)))).alias("m"))
    lists = lists.withColumn("m", F.transform("m", lambda x: F.struct(*(x[f"__{f}"].alias(f) for f in fields))))
    entries = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.struct("__k", "m")))))
    return lists.groupBy(paper).agg(*(entries(k).alias(k) for k in kinds))


def counts_of(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """A count column for each of the given values, zero where there are none."""
    return rows.groupBy(*by).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v.lower()}") for v in values), F.count(F.lit(1)).alias("n_total"))


def canonical_key(text: Column) -> Column:
    """Lower case, punctuation but hyphens dropped, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", ""), r"\s+", " "))


def canonical_entities(mentions: DataFrame, kind: str, raw: str, paper: str = "paper_id") -> DataFrame:
    """entity_id = kind::canonical text, with its sorted raw variants, its number of papers and the first of them.

    Which papers they are is a join on the entity away; a list of them would be as long as the entity is common.
    """
    name = canonical_key(F.col(raw))
    return (
        mentions.select(F.concat_ws("::", F.lit(kind), name).alias("entity_id"), name.alias("canonical_text"), raw, paper)
        .groupBy("entity_id", "canonical_text")
        .agg(F.array_sort(F.collect_set(raw)).alias("raw_variants"), F.count_distinct(paper).alias("n_papers"), F.min(paper).alias("first_paper"))
    )


def graph_nodes_and_edges(mentions: DataFrame, kinds: dict[str, str], paper: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Typed nodes and edges of the paper-entity graph; ``kinds`` maps an entity column to its edge type. One edge per (paper,
    entity, type), which keeps the first mention's place."""
    nodes = mentions.select(F.concat_ws("::", F.lit("paper"), F.col(paper).cast("string")).alias("node_id"), F.lit("paper").alias("node_type")).distinct()
    edges = None
    for column, edge_type in kinds.items():
        entity = F.concat_ws("::", F.lit(column), F.lower(F.col(column)))
        nodes = nodes.unionByName(mentions.select(entity.alias("node_id"), F.lit(column).alias("node_type")).distinct())
        part = mentions.groupBy(F.col(paper).alias("paper_id"), entity.alias("entity_id")).agg(F.min("pos").alias("pos")).withColumn("edge_type", F.lit(edge_type))
        edges = part if edges is None else edges.unionByName(part)
    return nodes, edges


def coverage_gain(new: DataFrame, known: DataFrame, key: list[str], paper: str = "paper_id") -> DataFrame:
    """Of each paper's distinct entities: how many are not known yet, and their share."""
    mine = new.select(paper, *key).distinct()
    seen = known.select(*key).distinct().withColumn("__known", F.lit(True))
    joined = mine.join(seen, key, "left")
    return joined.groupBy(paper).agg(F.count_if(F.col("__known").isNull()).alias("n_new"), F.count(F.lit(1)).alias("n_entities")).withColumn("coverage_gain", F.col("n_new") / F.col("n_entities"))


def type_entropy(rows: DataFrame, by: str, kind: str) -> DataFrame:
    """Shannon entropy over the kinds of each group, normalised by the log of their number (one kind: 0)."""
    counts = rows.groupBy(by, kind).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    p = counts.withColumn("p", F.col("n") / total)
    agg = p.groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count(F.lit(1)).alias("k"))
    return agg.select(by, F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(F.lit(0.0)).alias("entropy"), F.col("k").alias("n_kinds"))
