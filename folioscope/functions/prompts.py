"""Prompts for a model, as columns: what is known of a paper, a pair, a gap or a weakness, in capped lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many items of each list a prompt holds.
CAPS = {"methods": 5, "datasets": 5, "claims": 8, "contradictions": 3, "complements": 3, "limitations": 4, "datasets_of_gap": 3, "weaknesses": 6}
LONGEST = 1500


def listed(items: Column, cap: int, none: str = "(none)") -> Column:
    """The first ``cap`` items of an array, a line each; a note if there are none."""
    lines = F.array_join(F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, cap), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(lines == "", none).otherwise(lines)


def _parts(*parts: tuple[str, Column]) -> Column:
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{name}:\n"), text) for name, text in parts))


def section_prompt(section_type: Column, heading: Column, text: Column, hints: Column) -> Column:
    """Asks for the claims of a section; entities that were found in it are hints, long texts are cut."""
    head = F.concat(F.lit("Section "), section_type, F.lit(": "), F.coalesce(heading, F.lit("")))
    return _parts(("Task", F.lit("List the claims, limitations and future work of this section as one JSON object.")), ("Section", head), ("Known entities", listed(hints, CAPS["methods"])), ("Text", F.substring(F.coalesce(text, F.lit("")), 1, LONGEST)))


def pair_prompt(paper_a: Column, paper_b: Column, methods: Column, datasets: Column, contradictions: Column, complements: Column) -> Column:
    """Asks what two papers are to each other, and which contradictions their setups explain."""
    who = F.concat(paper_a.cast("string"), F.lit(" and "), paper_b.cast("string"))
    return _parts(
        ("Task", F.concat(F.lit("Compare papers "), who, F.lit(". Answer with one JSON object: relationship, and for each contradiction real, explains or neutral."))), ("Shared methods", listed(methods, CAPS["methods"])),
        ("Shared datasets", listed(datasets, CAPS["datasets"])), ("Contradictions", listed(contradictions, CAPS["contradictions"])), ("Complements", listed(complements, CAPS["complements"])),
    )


def validation_prompt(description: Column, evidence: Column, confidence: Column) -> Column:
    """Asks how much surer or less sure a gap should be."""
    return _parts(("Task", F.lit("Is this research gap real? Answer with one JSON object: delta from -0.2 to 0.2, and reason.")), ("Gap", description), ("Evidence", evidence), ("Confidence", F.format_string("%.2f", confidence)))


def critique_prompt(paper: Column, claims: Column, limitations: Column, weaknesses: Column) -> Column:
    """Asks for further weaknesses of a paper beside those that rules have found."""
    return _parts(
        ("Task", F.concat(F.lit("Name further weaknesses of paper "), paper.cast("string"), F.lit(" as one JSON list. Claim nothing to be absent that is listed."))), ("Claims", listed(claims, CAPS["claims"])),
        ("Limitations", listed(limitations, CAPS["limitations"])), ("Found already", listed(weaknesses, CAPS["weaknesses"])),
    )
