"""Reading and keeping tables: documents from JSON folders, tables that evolve, logs that grow, partitions that are replaced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _list(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(kind)


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_TEXT, _NUMBER = T.StringType(), T.DoubleType()
#: A parsed paper with its claims; the value of a claim may be a number or text, so it is read as text.
PAPER = _row(
    paper_id=_TEXT,
    metadata=_row(title=_TEXT, authors=_list(_TEXT), year=T.IntegerType(), venue=_TEXT, doi=_TEXT, abstract=_TEXT),
    entities=_list(_row(text=_TEXT, entity_type=_TEXT, confidence=_NUMBER, section_type=_TEXT, section_heading=_TEXT)),
    claims=_list(_row(claim_type=_TEXT, description=_TEXT, entities_involved=_list(_TEXT), value=_TEXT, confidence=_NUMBER, section_type=_TEXT, section_heading=_TEXT)),
    limitations=_list(_row(text=_TEXT, entities_involved=_list(_TEXT), confidence=_NUMBER, section_type=_TEXT)),
    future_work=_list(_row(text=_TEXT, entities_involved=_list(_TEXT), confidence=_NUMBER, section_type=_TEXT)),
)


def read_papers(spark: SparkSession, folder: str, name: str = "*.json", bad: str = "_corrupt_record") -> DataFrame:
    """Papers of all JSON files in a folder tree, one a row, with ``file``; unreadable files are skipped. Of several files for
    one paper, one called claims_output.json wins, then the first by name. A missing id is the name of the file's folder."""
    raw = spark.read.schema(T.StructType([*PAPER.fields, T.StructField(bad, T.StringType())])).option("columnNameOfCorruptRecord", bad)
    rows = raw.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder)
    rows = rows.select(*PAPER.names, bad, F.input_file_name().alias("file")).where(F.col(bad).isNull()).drop(bad)
    rows = rows.withColumn("paper_id", F.coalesce("paper_id", F.element_at(F.split("file", "/"), -2)))
    preferred = F.when(F.col("file").endswith("/claims_output.json"), 0).otherwise(1)
    best = rows.groupBy("paper_id").agg(F.min(F.struct(preferred.alias("kind"), "file")).alias("best"))
    return rows.join(best, "paper_id").where("file = best.file").drop("best")


def read_chunks_of(papers: DataFrame) -> DataFrame:
    """Claims, limitations and future work of papers as rows with their position."""
    parts = []
    for column, kind, text in (("claims", "claim", "description"), ("limitations", "limitation", "text"), ("future_work", "future_work", "text")):
        rows = papers.select("paper_id", F.posexplode(column).alias("pos", "x"))
        own = F.col("x.claim_type") if kind == "claim" else F.lit(kind)
        number = F.col("x.value").try_cast("double") if kind == "claim" else F.lit(None).cast("double")
        parts.append(rows.select("paper_id", "pos", F.lit(kind).alias("chunk_type"), own.alias("claim_type"), F.col(f"x.{text}").alias("text"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), number.alias("numeric_value"), F.array_join(F.coalesce("x.entities_involved", F.array().cast("array<string>")), ",").alias("entities_mentioned")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def evolve(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``rows`` with every missing column added and null ones filled by their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write ``rows`` over those partitions of ``by`` that they hold; others stay."""
    rows.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or no rows if there is none yet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) else spark.createDataFrame([], schema)


def count_or_zero(spark: SparkSession, table: str) -> int:
    return spark.table(table).count() if spark.catalog.tableExists(table) else 0


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, key, paper_id)`` of a registry of hashes and ids in one JSON file; a flat file of an older form holds hashes only."""
    pairs = "map<string,string>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"hashes {pairs}, arxiv_ids {pairs}").alias("r"), F.from_json("value", pairs).alias("flat"))
    old = F.col("r.hashes").isNull() & F.col("r.arxiv_ids").isNull()
    named = lambda kind, m: rows.select(F.lit(kind).alias("kind"), F.explode(m).alias("key", "paper_id"))
    return named("hash", F.when(old, F.col("flat")).otherwise(F.col("r.hashes"))).unionByName(named("arxiv", F.col("r.arxiv_ids")))
