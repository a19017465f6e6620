"""Parsed papers written as files by part, claims of papers read with their defaults, and names merged by a provider."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import repair_json, section_type
from .providers import NoAnswers, TextProvider, ask

PARTS = ("metadata", "sections", "figures", "tables", "tei_raw", "summary")


def summary(document: Column) -> Column:
    """A paper at a glance: what was found of its metadata, its sections and the beginning of its abstract."""
    d, bar = document, "=" * 50
    found = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("(not found)"))
    head = [F.lit(bar), F.lit("Parse Summary"), F.lit(bar), F.lit("")]
    meta = [F.concat(F.lit(f"[META] {n}: "), F.lit(" " * (8 - len(n))), found(c)) for n, c in (("Title", d["title"]), ("Authors", F.array_join(d["authors"], ", ")), ("Year", d["year"]), ("Venue", d["venue"]), ("DOI", d["doi"]))]
    count = F.concat(F.lit("\n[SECTIONS] "), F.size(d["sections"]).cast("string"), F.lit(" sections extracted:\n"))
    line = lambda s, i: F.format_string("  %2d. [%-20s] %s  (%d chars)", i + 1, section_type(s["heading"]), s["heading"], F.char_length(s["text"]))
    lines = F.concat(F.array_join(F.transform(d["sections"], line), "\n"), F.when(F.size(d["sections"]) > 0, "\n").otherwise(""))
    abstract = F.when(F.coalesce(d["abstract"], F.lit("")) != "", F.concat(F.lit("\n[ABSTRACT]\n"), F.substring(d["abstract"], 1, 500), F.when(F.char_length(d["abstract"]) > 500, "...").otherwise(""), F.lit("\n"))).otherwise("")
    return F.concat(F.array_join(F.array(*head, *meta), "\n"), F.lit("\n"), count, F.lit("\n"), lines, abstract)


def write_parsed(papers: DataFrame, folder: str, paper: str = "paper_id", document: str = "document", xml: str = "xml") -> None:
    """The six parts of each successfully parsed paper, each part below ``folder`` in a folder for each paper: metadata, sections
    (with their types), figures and tables as JSON, the XML and a summary as text. Papers written before are replaced."""
    d = F.col(document)
    rows = papers.where(d.isNotNull()).select(F.col(paper).alias("paper_id"), d.alias("d"), F.col(xml).alias("x"))
    rows = rows.withColumn("sections", F.transform("d.sections", lambda s: F.struct(section_type(s["heading"]).alias("section_type"), s["heading"].alias("heading"), s["text"].alias("text"))))
    out = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id")
    out(rows.select("paper_id", *(f"d.{c}" for c in ("title", "authors", "year", "venue", "doi", "abstract")))).json(f"{folder}/metadata")
    out(rows.select("paper_id", F.posexplode("sections").alias("pos", "s")).select("paper_id", "pos", "s.*")).json(f"{folder}/sections")
    for part in ("figures", "tables"):
        out(rows.select("paper_id", F.posexplode(f"d.{part}").alias("pos", "s")).select("paper_id", "pos", "s.*")).json(f"{folder}/{part}")
    out(rows.select("paper_id", F.col("x").alias("value"))).text(f"{folder}/tei_raw")
    out(rows.select("paper_id", summary(F.col("d")).alias("value"))).text(f"{folder}/summary")


_TEXT, _NUMBER = T.StringType(), T.DoubleType()
_ITEM = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("text", "description", "type", "claim_type", "value", "section_type", "section_heading")] + [T.StructField("confidence", _NUMBER), T.StructField("entities_involved", T.ArrayType(_TEXT))]))
_MAP = T.MapType(_TEXT, T.MapType(_TEXT, T.ArrayType(T.StructType([T.StructField("text", _TEXT), T.StructField("confidence", _NUMBER)]))))
CLAIMS_OUTPUT = T.StructType([T.StructField("paper_id", _TEXT), T.StructField("metadata", T.MapType(_TEXT, _TEXT)), T.StructField("claims", _ITEM), T.StructField("limitations", _ITEM), T.StructField("future_work", _ITEM), T.StructField("entity_index", _MAP), T.StructField("entities", _MAP)])


def read_claims_outputs(spark: SparkSession, folder: str, name: str = "claims_output.json", strict: bool = True) -> DataFrame:
    """Outputs of claim extraction, one a row: text and type from their older names, entities as the index where that is missing, and
    empty lists and maps for what is missing. A file without a paper id, or that is no object, is an error (``strict``), or left out."""
    bad = "_corrupt_record"
    reader = spark.read.schema(T.StructType([*CLAIMS_OUTPUT.fields, T.StructField(bad, _TEXT)])).option("columnNameOfCorruptRecord", bad).option("multiLine", True)
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", name).json(folder).withColumn("file", F.input_file_name())
    wrong = F.col(bad).isNotNull() | F.col("paper_id").isNull()
    known = F.when(wrong, F.raise_error(F.concat(F.lit("no paper id, or no object, in "), F.col("file")))).otherwise(F.col("paper_id")) if strict else F.col("paper_id")
    rows = rows if strict else rows.where(~wrong)
    item = lambda x: F.struct(F.coalesce(x["text"], x["description"]).alias("text"), F.coalesce(x["type"], x["claim_type"]).alias("type"), *(x[c].alias(c) for c in ("value", "section_type", "section_heading", "confidence", "entities_involved")))
    items = {c: F.transform(F.coalesce(c, F.array().cast(_ITEM)), item).alias(c) for c in ("claims", "limitations", "future_work")}
    return rows.select(known.alias("paper_id"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), *items.values(), F.coalesce("entity_index", "entities", F.create_map().cast(_MAP)).alias("entity_index"), "file")


def merged_names(names: DataFrame, kind: str, name: str, make: Callable[[], TextProvider] = NoAnswers, batch: int = 40) -> DataFrame:
    """``(kind, name, canonical)``: names of each kind, put to a provider in batches, in order; a name that the answer leaves out, or all
    names of a batch whose answer is no JSON object, are their own canonical form. Names are distinct within a kind."""
    distinct = names.select(F.col(kind).alias("kind"), F.col(name).alias("name")).where("kind IS NOT NULL AND name IS NOT NULL").distinct()
    placed = distinct.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("kind").orderBy("name")) - 1) / batch))
    listed = F.array_sort(F.collect_list("name"))
    prompts = placed.groupBy("kind", "batch").agg(listed.alias("names"))
    lines = F.array_join(F.transform("names", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    prompts = prompts.withColumn("prompt", F.concat(F.lit("Group names of one "), F.col("kind"), F.lit(" and give a JSON object from each name to its canonical form.\n"), lines))
    told = ask(prompts, "prompt", make).withColumn("map", F.from_json(repair_json(F.col("answer")), "map<string,string>"))
    each = told.select("kind", "map", F.explode("names").alias("name"))
    return each.select("kind", "name", F.coalesce(F.try_element_at("map", F.col("name")), F.col("name")).alias("canonical"))
