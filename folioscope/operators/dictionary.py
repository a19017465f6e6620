"""Names inside texts: every text that holds a name of a dictionary, and where first.

A dictionary of a checked size is sent to the tasks as one Aho-Corasick automaton, which reads each text once whatever the number
of names. A larger one meets the texts by its names' rarest grams, so that a name is compared only with texts that hold this gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship

#: A dictionary with so many bytes of names or fewer is sent to every task.
SENT_BYTES = 32 << 20
GRAM = 4


def _grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters."""
    letters = F.split(text, "")
    held = F.transform(F.array(letters), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - q), lambda i: F.concat(*(F.get(x, i + k) for k in range(q)))))[0]
    return F.when(F.char_length(text) >= q, F.array_distinct(held))


def _by_automaton(texts: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(names)
    kind = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("name", T.StringType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for name in sent.value:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for batch in batches:
            at, found, places = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                first: dict[str, int] = {}
                for end, name in automaton.iter(value) if value else ():
                    first.setdefault(name, end - len(name) + 2)
                at += [i] * len(first)
                found += first.keys()
                places += first.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int64())], [key, "name", "place"])

    return texts.select(key, text).mapInArrow(run, kind)


def _by_grams(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    held = texts.select(F.col(key).alias("k"), F.col(text).alias("t"))
    found = None
    for q in range(1, GRAM + 1):
        mine = names.where(F.char_length("name") == q if q < GRAM else F.char_length("name") >= q)
        if q < GRAM and mine.first() is None:
            continue
        inside = held.select("k", F.explode(_grams(F.col("t"), q)).alias("g"))
        frequency = inside.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
        anchor = mine.select("name", F.explode(_grams(F.col("name"), q)).alias("g")).join(frequency, "g", "left")
        anchor = anchor.groupBy("name").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "g")).alias("a")).where("a.df > 0").select("name", F.col("a.g").alias("g"))
        pairs = inside.join(anchor, "g").select("k", "name")
        found = pairs if found is None else found.unionByName(pairs)
    placed = cut(found).join(held, "k").select(F.col("k").alias(key), "name", F.expr("instr(t, name)").cast("long").alias("place"))
    return placed.where("place > 0")


def occurrences(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(key, name, place)``: one row for each text and each name inside it, with the place where it first begins (from 1).

    Matching is exact, character by character, and needs no word boundaries. Null texts and null or empty names match nothing;
    repeated names count once. ``key`` names one text: rows of one key that differ in text are looked at separately where the
    dictionary is sent, and must not occur beyond that size.
    """
    ship(texts.sparkSession)
    words = cut(names.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct())
    size = words.agg(F.sum(F.octet_length("name"))).first()[0]
    if not size:
        return texts.select(key).where("false").withColumns({"name": F.lit(""), "place": F.lit(0).cast("long")})
    if size <= sent_bytes:
        return _by_automaton(texts, key, text, sorted(r["name"] for r in words.collect()))
    return _by_grams(texts, key, text, words)


def first_occurrence(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(key, name)``: of the names inside a text the one that begins first; of these the first by value."""
    found = occurrences(texts, key, text, names, name, sent_bytes)
    return found.groupBy(key).agg(F.min(F.struct("place", "name")).alias("m")).select(key, F.col("m.name").alias("name"))


def resolve_names(names: DataFrame, name: str, known: DataFrame, known_name: str, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``(name, known, score)``: for each name the known one that equals it (1.0), or else that it holds or is held by (0.85);
    the first by value. Names that match nothing are left out."""
    mine = names.select(F.col(name).alias("name")).where("name IS NOT NULL AND name <> ''").distinct()
    theirs = known.select(F.col(known_name).alias("known")).where("known IS NOT NULL AND known <> ''").distinct()
    inside = occurrences(mine.withColumn("t", F.col("name")).withColumnRenamed("name", "key"), "key", "t", theirs, "known", sent_bytes).select(F.col("key").alias("name"), F.col("name").alias("known"))
    around = occurrences(theirs.withColumn("t", F.col("known")).withColumnRenamed("known", "key"), "key", "t", mine, "name", sent_bytes).select("name", F.col("key").alias("known"))
    hits = inside.unionByName(around).withColumn("score", F.when(F.col("name") == F.col("known"), 1.0).otherwise(0.85))
    return hits.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "known")).alias("m")).select("name", F.col("m.known").alias("known"), (-F.col("m.s")).alias("score"))
