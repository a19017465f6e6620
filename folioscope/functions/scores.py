"""Scores, ratios and roundings as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int = 4) -> Column:
    """Round half up by arithmetic, the same on every engine."""
    return F.floor(x * 10**digits + 0.5) / 10.0**digits


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def weighted(score: Column, confidence: Column) -> Column:
    """A score times its confidence; a confidence of 0 or null counts as 1."""
    return score * F.when(F.coalesce(confidence, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(confidence)


def softmax(scores: Column) -> Column:
    """Of an array, shifted by its maximum; null members (masked) stay null."""
    powers = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + F.coalesce(y, F.lit(0.0))))


def rank_of(value: Column, order: Sequence[str], default: int | None = None) -> Column:
    """Position of a value in a fixed order."""
    found = F.lit(default)
    for i, name in enumerate(order):
        found = F.when(value == name, F.lit(i)).otherwise(found)
    return found


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (name, pattern) that matches."""
    found = F.lit(default)
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def linear_decay(step: Column, start: float, end: float, steps: int) -> Column:
    """From ``start`` to ``end`` in equal parts over ``steps``, then ``end``."""
    return F.when(step >= steps, F.lit(end)).otherwise(start + step / steps * (end - start))


def cosine_decay(step: Column, start: float, least: float, steps: int) -> Column:
    """Cosine annealing from ``start`` down to ``least`` over ``steps``."""
    return least + 0.5 * (1.0 + F.cos(F.pi() * step / max(steps, 1))) * (start - least)
