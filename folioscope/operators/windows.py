"""Overlapping windows of sentences, the unit that entity recognisers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def sentence_windows(docs: DataFrame, doc_id: str, text: str, max_words: int = 400, overlap: int = 2) -> DataFrame:
    """Windows of whole sentences with at most ``max_words`` words (a longer sentence is a window of its own); each repeats the
    last ``overlap`` sentences of the one before, where they fit. One fold over the sentences of a document."""
    n_words = lambda s: F.size(F.split(F.trim(s), r"\s+"))
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("now"), F.lit(0).alias("n"), F.array().cast("array<array<string>>").alias("done"))

    def step(acc: Column, s: Column) -> Column:
        size = n_words(s)
        kept = F.slice(acc["now"], F.greatest(F.size(acc["now"]) - overlap + 1, F.lit(1)), overlap)
        kept_size = F.aggregate(kept, F.lit(0), lambda a, x: a + n_words(x))
        kept = F.when(kept_size + size <= max_words, kept).otherwise(empty)
        kept_size = F.when(kept_size + size <= max_words, kept_size).otherwise(F.lit(0))
        full = (acc["n"] + size > max_words) & (F.size(acc["now"]) > 0)
        return F.when(full, F.struct(F.concat(kept, F.array(s)).alias("now"), (kept_size + size).alias("n"), F.concat(acc["done"], F.array(acc["now"])).alias("done"))).otherwise(
            F.struct(F.concat(acc["now"], F.array(s)).alias("now"), (acc["n"] + size).alias("n"), acc["done"].alias("done"))
        )

    done = F.aggregate(sentences(F.col(text)), start, step, lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    rows = docs.select(doc_id, F.posexplode(done).alias("window", "sentences"))
    return rows.select(doc_id, "window", F.size("sentences").alias("n_sentences"), F.array_join("sentences", " ").alias("text"))
