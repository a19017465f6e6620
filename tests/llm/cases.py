"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, texts, ids=None, source="s"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", source, None if t is None else len(t)) for i, t in zip(ids, texts)], SCHEMA)


def awkward(spark):
    """Ids repeat, are null, texts are null, empty, blank, equal, very long, without spaces, and not ASCII."""
    passage = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (None, "no id here at all"), (None, None), (3, ""), (4, " \n\t "), (5, "x" * 5000), (6, "é" * 300 + " ß"),
        (7, passage + " tail one"), (8, "head two " + passage), (9, passage), (2, "another text with the id two"), (10, "😀".encode("utf-16", "surrogatepass").decode("utf-16") * 60), (11, passage + " " + passage),
    ]
    return docs(spark, [t for _, t in rows], [i for i, _ in rows])


def extra(df):
    """Columns whose names the operators use inside or in their results."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(1).alias(c) for c in ("fp", "kept", "spans", "part", "hashes", "key", "component_id", "ids", "shard", "__part")))
