"""Which folder belongs to a paper: by its exact name, else by a name that begins with it, else by the id that is inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_folders(wanted: DataFrame, stem: str, folders: DataFrame, name: str, inside: str) -> DataFrame:
    """``(stem, folder, rule)`` for each distinct stem that has a folder: ``exact``, else ``prefix`` (the first by name), else
    ``inside`` (the first by name whose inner id is the stem).

    All three are equi-joins: names are looked up by their beginnings, but only by beginnings as long as some stem. Null or
    empty stems and names match nothing.
    """
    stems = wanted.select(F.col(stem).alias("stem")).where("stem IS NOT NULL AND stem <> ''").distinct()
    rows = folders.select(F.col(name).alias("folder"), F.col(inside).alias("id")).where("folder IS NOT NULL AND folder <> ''").distinct()
    lengths = sorted(r[0] for r in stems.select(F.char_length("stem")).distinct().collect())  # as many as file names may be long
    beginnings = F.filter(F.array(*(F.when(F.char_length("folder") >= n, F.substring("folder", 1, n)) for n in lengths)), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    by_name = rows.select("folder", F.explode(beginnings).alias("stem")).distinct().select("stem", F.when(F.col("folder") == F.col("stem"), 0).otherwise(1).alias("rank"), "folder")
    by_id = rows.select(F.col("id").alias("stem"), F.lit(2).alias("rank"), "folder").where("stem IS NOT NULL")
    best = by_name.unionByName(by_id).join(stems, "stem", "left_semi").groupBy("stem").agg(F.min(F.struct("rank", "folder")).alias("b"))
    rule = F.element_at(F.array(F.lit("exact"), F.lit("prefix"), F.lit("inside")), F.col("b.rank") + 1)
    return best.select("stem", F.col("b.folder").alias("folder"), rule.alias("rule"))
