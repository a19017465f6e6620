"""Answers of a provider that are kept: each question is asked once, however many rows, runs and crashes there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from .providers import NoAnswers, TextProvider
from .versions import Versions

ANSWERS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "question", "answer")])
#: Fixed value: an answer as long as this, or of several lines, is none.
LONGEST = 80


def question_of(raw: Column) -> Column:
    """What rows are asked by: lower case, without spaces around."""
    return F.lower(F.trim(raw))


def accepted(answer: Column) -> Column:
    """The answer in lower case without quotes around; null if it is empty, long or of several lines."""
    clean = F.btrim(F.btrim(F.lower(F.trim(answer)), F.lit('"')), F.lit("'"))
    return F.when((clean != "") & (F.char_length(clean) < LONGEST) & ~clean.contains("\n"), clean)


class AnswerTable:
    """Kept answers below ``path``: every version adds answers to questions that no earlier one answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.versions = Versions(spark, path, ANSWERS)

    def known(self) -> DataFrame:
        return self.versions.read(*self.versions.complete())

    def missing(self, questions: DataFrame) -> DataFrame:
        """Distinct (kind, question) without an answer."""
        return questions.select("kind", "question").where("question IS NOT NULL AND question <> ''").distinct().join(self.known(), ["kind", "question"], "left_anti")

    def fill(self, questions: DataFrame, make: Callable[[], TextProvider], slices: int = 8, batch: int = 32) -> int:
        """Ask what is missing, one request a question, and keep what is accepted; how many questions were asked.

        The work is published in slices (by a hash of the question): a run that is killed loses the slice it was in and no other.
        Questions without an accepted answer stay missing and are asked again next time.
        """
        ship(questions.sparkSession)
        open_ = cut(self.missing(questions).withColumn("slice", F.pmod(F.xxhash64("kind", "question"), F.lit(slices))))
        asked = 0
        for r in sorted(open_.groupBy("slice").count().collect(), key=lambda r: r["slice"]):
            rows = open_.where(F.col("slice") == r["slice"])

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                provider = make()
                for pdf in batches:
                    for i in range(0, len(pdf), batch):
                        part = pdf.iloc[i : i + batch].copy()
                        part["answer"] = provider.answer(list(part["question"]))
                        yield part[["kind", "question", "answer"]]

            answers = rows.mapInPandas(run, ANSWERS).withColumn("answer", accepted(F.col("answer"))).where("answer IS NOT NULL")
            self.versions.write(answers, (self.versions.complete() or [0])[-1] + 1)
            asked += r["count"]
        return asked

    def compact(self) -> None:
        """All answers as one version; the earlier ones go only after it is committed."""
        old = self.versions.complete()
        if len(old) > 1:
            self.versions.write(cut(self.versions.read(*old).distinct()), old[-1] + 1)
            for n in old:
                self.versions.drop(n)


def normalised(rows: DataFrame, kind: str, raw: str, rule: Column, table: AnswerTable, make: Callable[[], TextProvider] = NoAnswers, to: str = "canonical") -> DataFrame:
    """``rows`` with the canonical form of ``raw``: the rule's, else the kept or newly asked answer, else lower case without spaces
    around. An empty or blank name stays as it is. Rules come first, so only what they don't know is ever asked."""
    named = rows.withColumn("__rule", rule).withColumn("question", F.when(F.col("__rule").isNull(), question_of(F.col(raw)))).withColumn("kind", F.lit(kind))
    table.fill(named, make)
    found = named.join(table.known(), ["kind", "question"], "left")
    blank = F.trim(raw) == ""
    return found.select(*rows.columns, F.when(blank, F.col(raw)).otherwise(F.coalesce("__rule", "answer", question_of(F.col(raw)))).alias(to))
