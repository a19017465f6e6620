"""What a stream of papers adds to what is known: state by entity, in the order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

FIRST = T.StructType([T.StructField("paper", T.LongType()), T.StructField("place", T.LongType())])
SEEN = T.StructType([T.StructField("entity", T.StringType()), T.StructField("paper", T.LongType()), T.StructField("place", T.LongType()), T.StructField("is_new", T.BooleanType())])


class FirstPaper(StatefulProcessor):
    """State of an entity: the paper that brought it first. One row an entity, however often it is mentioned."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", FIRST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = int(self.first.get()[0]) if self.first.exists() else None
        earliest: dict[int, int] = {}
        for pdf in rows:
            for paper, place in zip(pdf["paper"], pdf["place"]):
                earliest[int(paper)] = min(int(place), earliest.get(int(paper), int(place)))
        if known is None and earliest:
            known = min(earliest, key=lambda p: (earliest[p], p))
            self.first.update((known, earliest[known]))
        out = sorted((place, paper) for paper, place in earliest.items())
        yield pd.DataFrame({"entity": [key[0]] * len(out), "paper": [p for _, p in out], "place": [x for x, _ in out], "is_new": [p == known for _, p in out]})

    def close(self) -> None:
        pass


def new_entities(mentions: DataFrame) -> DataFrame:
    """``(entity, paper, place, is_new)`` from a stream of (entity, paper, place): whether the paper was the first with the entity.

    Batches arrive in order of ``place``; within one, the lowest place comes first. A paper's repeated mentions in one batch are
    one row (its first), in later batches further rows with the same answer. State grows with the number of distinct entities,
    not of mentions; it is kept by the state store on the executors' disks, partitioned by entity.
    """
    ship(mentions.sparkSession)
    rows = mentions.select("entity", F.col("paper").cast("long").alias("paper"), F.col("place").cast("long").alias("place")).where("entity IS NOT NULL AND paper IS NOT NULL")
    return rows.groupBy("entity").transformWithStateInPandas(FirstPaper(), outputStructType=SEEN, outputMode="Append", timeMode="None")


def gain_of(seen: DataFrame) -> DataFrame:
    """``(paper, n_entities, n_new, coverage_gain)`` from what ``new_entities`` gave."""
    each = seen.groupBy("paper", "entity").agg(F.bool_or("is_new").alias("is_new"))
    out = each.groupBy("paper").agg(F.count(F.lit(1)).alias("n_entities"), F.count_if("is_new").alias("n_new"))
    return out.withColumn("coverage_gain", F.col("n_new") / F.col("n_entities"))
