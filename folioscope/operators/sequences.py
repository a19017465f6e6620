"""Operators on ordered rows: runs, carry-forward, rolling statistics, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stop_after_run(rows: DataFrame, group: str, order: list[str], flag: str, length: int) -> DataFrame:
    """Rows of each group up to the end of its first run of ``length`` flagged rows."""
    w = Window.partitionBy(group).orderBy(*order)
    run = F.sum(F.col(flag).cast("int")).over(w.rowsBetween(-(length - 1), 0))
    numbered = rows.withColumn("__n", F.row_number().over(w)).withColumn("__hit", F.when(run == length, F.col("__n")))
    stop = F.min("__hit").over(Window.partitionBy(group))
    return numbered.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col("__n") <= F.col("__stop"))).drop("__n", "__hit", "__stop")


def runs(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``run``: the number, from 0, of the stretch of equal values a row is in (gaps and islands)."""
    w = Window.partitionBy(group).orderBy(*order)
    new = F.coalesce((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(new)
    return rows.withColumn("__new", first).withColumn("run", F.sum("__new").over(w).cast("long")).drop("__new")


def merge_runs(rows: DataFrame, group: str, order: list[str], value: str, text: str, sep: str = "\n\n") -> DataFrame:
    """Consecutive rows of one value become one, their texts joined in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return runs(rows, group, order, value).groupBy(group, "run", value).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias(text), F.count(F.lit(1)).alias("n_rows"))


def carry_forward(rows: DataFrame, group: str, order: list[str], value: Column, to: str) -> DataFrame:
    """``rows`` with the last non-null value up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(w))


def rolling_mean(rows: DataFrame, group: str, order: list[str], value: str, width: int, to: str = "rolling", valid: bool = False) -> DataFrame:
    """Mean of the last ``width`` values, nulls skipped; ``valid`` keeps only rows with a full window."""
    w = Window.partitionBy(group).orderBy(*order)
    out = rows.withColumn(to, F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") >= width).drop("__n") if valid else out


def precedence(rows: DataFrame, group: str, step: str, action: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Share of pairs (before, after) of actions whose first ``before`` comes earlier than the first ``after``."""
    names = sorted({x for p in pairs for x in p})
    firsts = rows.groupBy(group).agg(*(F.min(F.when(F.col(action) == n, F.col(step))).alias(f"__{n}") for n in names))
    hits = [F.coalesce((F.col(f"__{a}") < F.col(f"__{b}")).cast("int"), F.lit(0)) for a, b in pairs]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return firsts.select(group, (total / len(pairs)).alias("score"))


def generalized_advantage(rows: DataFrame, group: str, order: list[str], delta: str, discount: float) -> DataFrame:
    """A_t = delta_t + discount * A_(t+1), by one backward fold over each group's ordered deltas; groups are episodes, so short."""
    steps = F.reverse(F.array_sort(F.collect_list(F.struct(*order, F.col(delta).alias("d")))))
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        a = x["d"].cast("double") + discount * acc["a"]
        return F.struct(a.alias("a"), F.concat(F.array(a), acc["all"]).alias("all"))

    folded = rows.groupBy(group).agg(F.aggregate(steps, start, step, lambda acc: acc["all"]).alias("advantages"))
    return folded.select(group, F.posexplode("advantages").alias("step", "advantage"))


def normalise(rows: DataFrame, group: str, value: str, to: str) -> DataFrame:
    """(x - mean) / (population standard deviation + 1e-8) within each group."""
    w = Window.partitionBy(group)
    return rows.withColumn(to, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-8))


def bio_spans(rows: DataFrame, group: str, order: list[str], tag: str) -> DataFrame:
    """Spans of B-/I- tags: a span starts at B-, or at an I- that does not continue the type before it; O ends it."""
    w = Window.partitionBy(group).orderBy(*order)
    kind = F.regexp_extract(tag, "^[BI]-(.*)$", 1)
    goes_on = (F.lag(kind).over(w) == kind) & (F.lag(tag).over(w) != "O")
    starts = (F.col(tag).startswith("B-")) | (F.col(tag).startswith("I-") & ~F.coalesce(goes_on, F.lit(False)))
    numbered = rows.withColumn("__kind", kind).withColumn("__at", F.row_number().over(w)).withColumn("__start", starts.cast("int"))
    spans = numbered.withColumn("span", F.sum("__start").over(w)).where(F.col(tag) != "O")
    return spans.groupBy(group, "span").agg(F.first("__kind").alias("kind"), F.min("__at").alias("start"), F.max("__at").alias("end"))
