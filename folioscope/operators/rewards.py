"""What a session of agents, a chosen gap and the end of an episode are worth: weighted sums of parts between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weights of each reward, what severities count, headings that a review should have, and the usual invocations.
SESSION = {"contradiction_yield": 0.25, "critique_depth": 0.20, "gap_novelty": 0.20, "sequence_score": 0.15, "review_completeness": 0.15, "efficiency": 0.05}
GAP = {"novelty": 0.20, "specificity": 0.18, "coverage": 0.18, "consistency": 0.14, "confidence": 0.18, "priority": 0.12}
TERMINAL = {"contradiction_yield": 0.22, "critique_depth": 0.18, "gap_novelty": 0.18, "review_completeness": 0.32, "efficiency": 0.10}
SEVERITY = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}
PRIORITY = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.0}
HEADINGS = ("## Methods", "## Results", "## Contradictions", "## Gaps", "## Conclusion")
USUAL = 4
#: Agents that should come one before the other, and what each such pair adds at the end of an episode.
IN_ORDER = (("run_comparator", "run_critic", 0.05), ("run_critic", "run_gap_detector", 0.04), ("run_gap_detector", "run_writer", 0.04))


def _weighted(weights: dict[str, float], parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(parts[name], F.lit(0.0))
    return total


def _clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def severity_score(severity: Column) -> Column:
    """A number as it is, HIGH 1.0, MEDIUM 0.6, anything else 0.3."""
    named = F.coalesce(*(F.when(F.upper(severity) == s, F.lit(x)) for s, x in SEVERITY.items()), F.lit(0.3))
    return F.coalesce(severity.try_cast("double"), named)


def severe(severity: Column) -> Column:
    """Whether a contradiction counts: a number of 0.5 or more, or HIGH or MEDIUM as written."""
    return F.coalesce(severity.try_cast("double") >= 0.5, F.lit(False)) | F.coalesce(severity.isin("HIGH", "MEDIUM"), F.lit(False))


def order_kept(actions: DataFrame, session: str, action: str, at: str) -> DataFrame:
    """``(session, n_in_order, bonus)``: of the agents that should follow one another, how many pairs first ran in that order."""
    first = {a: F.min(F.when(F.col(action) == a, F.col(at))) for a in dict.fromkeys(x for a, b, _ in IN_ORDER for x in (a, b))}
    g = actions.groupBy(session).agg(*(c.alias(f"__{a}") for a, c in first.items()))
    kept = [(F.coalesce(F.col(f"__{a}") < F.col(f"__{b}"), F.lit(False)).cast("int"), w) for a, b, w in IN_ORDER]
    return g.select(session, sum((k for k, _ in kept[1:]), kept[0][0]).alias("n_in_order"), sum((k * w for k, w in kept[1:]), kept[0][0] * kept[0][1]).alias("bonus"))


def novel_gaps(gaps: DataFrame, session: str, combination: str) -> DataFrame:
    """``(session, gap_novelty)``: the share of a session's gaps whose combination no other session has."""
    owners = gaps.groupBy(combination).agg(F.min(session).alias("__x"), F.max(session).alias("__y"))
    rows = gaps.join(owners, combination)
    return rows.groupBy(session).agg((F.count_if(F.col("__x") == F.col("__y")) / F.count(F.lit(1))).alias("gap_novelty"))


def review_completeness(review: Column) -> Column:
    """The share of the expected headings that a review has."""
    return sum((F.coalesce(review.contains(h), F.lit(False)).cast("int") for h in HEADINGS[1:]), F.coalesce(review.contains(HEADINGS[0]), F.lit(False)).cast("int")) / len(HEADINGS)


def session_reward(n_severe: Column, mean_severity: Column, gap_novelty: Column, n_in_order: Column, completeness: Column, invocations: Column) -> Column:
    """Three severe contradictions are enough; the mean severity of critiques counts squared; invocations beyond the usual cost."""
    parts = {
        "contradiction_yield": F.least(F.coalesce(n_severe, F.lit(0)) / 3.0, F.lit(1.0)),
        "critique_depth": mean_severity * mean_severity,
        "gap_novelty": F.least(F.coalesce(gap_novelty, F.lit(0.0)), F.lit(1.0)),
        "sequence_score": n_in_order / 3.0,
        "review_completeness": completeness,
        "efficiency": F.greatest(1.0 - F.greatest(invocations - USUAL, F.lit(0)) / USUAL, F.lit(0.0)),
    }
    return _clipped(_weighted(SESSION, parts))


def gap_reward(redundancy: Column, n_entities: Column, n_papers: Column, all_papers: Column, n_conflicts: Column, confidence: Column, priority: Column, gap_type: Column) -> Column:
    """What choosing a gap is worth: new, specific, shared by papers, without contradicted entities, sure and urgent."""
    urgent = F.coalesce(*(F.when(priority == p, F.lit(x)) for p, x in PRIORITY.items()), F.lit(0.5))
    parts = {
        "novelty": 1.0 - redundancy,
        "specificity": F.least(n_entities / 5.0, F.lit(1.0)),
        "coverage": F.least(n_papers / F.greatest(all_papers, F.lit(1)), F.lit(1.0)),
        "consistency": 1.0 - n_conflicts / F.greatest(n_entities, F.lit(1)),
        "confidence": F.coalesce(confidence, F.lit(0.5)),
        "priority": F.least(urgent + F.when(gap_type == "cross_paper", 0.25).otherwise(0.0), F.lit(1.0)),
    }
    return _clipped(_weighted(GAP, parts))


def terminal_reward(papers: Column, contradictions: Column, critiques: Column, gaps: Column, context: Column, wrote: Column, duplicates: Column, bonus: Column) -> Column:
    """What an episode is worth at its end; a repeated agent costs 0.18 of the efficiency, which is 0.25 at least."""
    pairs = F.greatest(papers * (papers - 1) / 2, F.lit(1.0))
    parts = {
        "contradiction_yield": F.when(papers >= 2, F.least(contradictions / pairs, F.lit(1.0))).otherwise(0.05),
        "critique_depth": F.when(critiques > 0, F.pow(F.least(critiques / F.greatest(papers * 2, F.lit(1)), F.lit(1.0)), F.lit(0.65))).otherwise(0.0),
        "gap_novelty": F.least(F.greatest(gaps, F.lit(0)) / 8.0, F.lit(1.0)),
        "review_completeness": F.when(wrote, context).otherwise(0.0),
        "efficiency": F.greatest(1.0 - duplicates * 0.18, F.lit(0.25)),
    }
    return _clipped(_weighted(TERMINAL, parts) + bonus)
