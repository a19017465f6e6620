"""What needs a model or a network sits behind these interfaces; the defaults work offline and are deterministic."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship


class TextProvider(Protocol):
    """Answers prompts in order; raises nothing for a single bad prompt but gives None."""

    def answer(self, prompts: list[str]) -> list[str | None]: ...


class NoAnswers:
    """The default: no model, so every caller takes its rule-based branch."""

    def answer(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts)


def ask(rows: DataFrame, prompt: str, make: Callable[[], TextProvider] = NoAnswers, to: str = "answer", batch: int = 32) -> DataFrame:
    """``rows`` with the answer to each prompt. ``make`` builds the provider once for each task; equal prompts are asked once a
    batch, which is what a cache of answers comes to."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            new = list(dict.fromkeys(pdf[prompt].dropna()))
            known = {p: a for i in range(0, len(new), batch) for p, a in zip(new[i : i + batch], provider.answer(new[i : i + batch]))}
            pdf[to] = [known.get(p) for p in pdf[prompt]]
            yield pdf

    return rows.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"{to} string"]))


#: How often a prompt is asked, the seconds by which a further attempt waits for each one before it, and the rate.
ATTEMPTS, BACKOFF, PER_MINUTE = 6, 15.0, 12.0


def ask_within_rate(
    rows: DataFrame, key: str, prompt: str, make: Callable[[], TextProvider] = NoAnswers, per_minute: float = PER_MINUTE, attempts: int = ATTEMPTS, backoff: float = BACKOFF, tasks: int = 1, wait: Callable[[float], None] = time.sleep
) -> DataFrame:
    """``(key, prompt, answer, attempts)``: prompts asked one at a time, all tasks together at most ``per_minute`` a minute.

    The rate is divided over ``tasks`` tasks whatever the partitions of ``rows``: each waits ``tasks`` intervals before every
    request, the first too, so a task that is started again does not ask faster. Fewer free cores than tasks only make it slower.
    A prompt fails if the provider raises or gives None; it is asked again in the next round, after a pause that grows with the
    attempts. What is open is a column of the rows, kept after each round, so a lost executor costs no answer of an earlier
    round. A prompt that fails every attempt ends with a null answer; null prompts are never asked. Keys are distinct.
    """
    ship(rows.sparkSession)
    interval = 60.0 / per_minute * tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in batches:
            for i in range(len(pdf)):
                one = pdf.iloc[i : i + 1].copy()
                wait(interval)
                try:
                    one["answer"] = provider.answer([one[prompt].iloc[0]])
                except Exception:  # a failed request is what the attempts are for
                    one["answer"] = [None]
                one["attempts"] += 1
                yield one

    held = cut(rows.select(key, prompt, F.lit(None).cast("string").alias("answer"), F.lit(0).alias("attempts")))
    done, open_ = held.where(F.col(prompt).isNull()), held.where(F.col(prompt).isNotNull())
    for n in range(attempts):
        if open_.first() is None:
            break
        if n:
            wait(backoff * n)
        asked = cut(open_.repartition(tasks).mapInPandas(run, held.schema))
        done, open_ = done.unionByName(asked.where("answer IS NOT NULL")), asked.where("answer IS NULL")
    return done.unionByName(open_)
