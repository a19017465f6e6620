"""Sections of a review without a model: ordered lines with a cap, or a fixed sentence when there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a section says when it has nothing, and how many lines each list may have.
NOTHING = {
    "methods": "No method entities were extracted from the corpus.", "results": "No numeric performance claims were extracted from the corpus.", "contradictions": "No contradictions or complements found.",
    "limitations": "No limitations found.", "gaps": "No gaps detected.",
}
CAPS = {"methods": 10, "results": 8, "contradictions": 5, "complements": 4, "limitations": 6, "weaknesses": 5, "gaps": 6}
CONCLUSION = "This review covered %d papers, identifying %d cross-paper contradictions and %d unexplored research gaps. Future work should address the detected gaps to advance the field."


def citation(authors: Column, year: Column) -> Column:
    """[LastName year] of an array of authors; Unknown and ? where they are missing."""
    last = F.element_at(F.split(F.trim(F.try_element_at(authors, F.lit(1))), r"\s+"), -1)
    return F.concat(F.lit("["), F.coalesce(F.nullif(last, F.lit("")), F.lit("Unknown")), F.lit(" "), F.coalesce(year.cast("string"), F.lit("?")), F.lit("]"))


def reference(place: Column, authors: Column, year: Column, title: Column, venue: Column) -> Column:
    """A line of the list of references, with three authors and et al. beyond."""
    names = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))
    return F.concat(F.lit("["), place.cast("string"), F.lit("] "), names, F.lit(" ("), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce(title, F.lit("Untitled")), F.lit(". "), F.coalesce(venue, F.lit("")), F.lit("."))


def lines_of(rows: DataFrame, line: Column, order: list[Column], cap: int) -> DataFrame:
    """One row (text): the first ``cap`` lines in order, null if there are none. Only these lines reach one task."""
    top = rows.orderBy(*order).limit(cap).select(F.monotonically_increasing_id().alias("__n"), line.alias("__line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__line"))), lambda x: x["__line"]), "\n")
    return top.agg(F.nullif(text, F.lit("")).alias("text"))


def section(name: str, *parts: tuple[str, DataFrame]) -> DataFrame:
    """``(section, text)`` of parts, each with a heading (empty: none) and a row of text; those without text are left out."""
    out = None
    for heading, part in parts:
        text = part.select(F.concat(F.lit(f"{heading}\n" if heading else ""), "text").alias("text"))
        out = text if out is None else out.crossJoin(text.withColumnRenamed("text", "__more")).select(F.concat_ws("\n\n", "text", "__more").alias("text"))  # two single rows
    return out.select(F.lit(name).alias("section"), F.coalesce(F.nullif("text", F.lit("")), F.lit(NOTHING[name])).alias("text"))


def session_report(papers: DataFrame, contradictions: DataFrame, weaknesses: DataFrame, gaps: DataFrame) -> DataFrame:
    """``(agent, n_items, n_high, n_papers)``: what each agent of a session has to report, one row an agent."""
    high = F.count_if(F.col("severity") == "HIGH")
    one = lambda df, agent, n_high, paper: df.agg(F.lit(agent).alias("agent"), F.count(F.lit(1)).alias("n_items"), n_high.alias("n_high"), F.count_distinct(paper).alias("n_papers"))
    return (
        one(papers, "reader", F.lit(0).cast("long"), "paper_id")
        .unionByName(one(contradictions, "comparator", high, "paper_a"))
        .unionByName(one(weaknesses, "critic", high, "paper_id"))
        .unionByName(one(gaps, "gap_detector", F.count_if(F.col("priority") == "HIGH"), "paper_a"))
    )
