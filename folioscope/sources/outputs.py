"""What agents leave behind: folders of JSON outputs read as tables and written again, reviews as one text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _NUMBER, _FLAG = T.StringType(), T.DoubleType(), T.BooleanType()


def _row(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


def _list(**kinds: T.DataType) -> T.ArrayType:
    return T.ArrayType(_row(**kinds))


CONTRADICTION = {"metric": _TEXT, "dataset": _TEXT, "method": _TEXT, "entity": _TEXT, "claim_a": _TEXT, "claim_b": _TEXT, "text_a": _TEXT, "text_b": _TEXT, "severity": _TEXT, "type": _TEXT, "value_a": _NUMBER, "value_b": _NUMBER, "diff": _NUMBER}
COMPARISON = _row(comparison_id=_TEXT, paper_a=_TEXT, paper_b=_TEXT, pair_score=_NUMBER, overall_relationship=_TEXT, contradictions=_list(**CONTRADICTION), complementary_findings=_list(finding_id=_TEXT, detail=_TEXT, text=_TEXT, confidence=_NUMBER))
CRITIQUE = _row(paper_id=_TEXT, overall_score=_NUMBER, weaknesses=_list(weakness_type=_TEXT, description=_TEXT, severity=_TEXT, confidence=_NUMBER, evidence=_TEXT, needs_review=_FLAG))
GAPS = _row(gaps=_list(gap_id=_TEXT, gap_type=_TEXT, description=_TEXT, priority=_TEXT, confidence=_NUMBER, entities_involved=T.ArrayType(_TEXT), papers_involved=T.ArrayType(_TEXT), needs_review=_FLAG, addressed_status=_TEXT))


def _read(spark: SparkSession, folder: str, schema: T.StructType, name: str) -> DataFrame:
    """JSON files of one folder, one a row, with ``file``; unreadable ones are skipped, a missing folder has none."""
    bad = "_corrupt_record"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("file", _TEXT)]))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, _TEXT)])).option("columnNameOfCorruptRecord", bad).option("multiLine", True).option("pathGlobFilter", name).json(folder)
    return rows.select(*schema.names, bad, F.input_file_name().alias("file")).where(F.col(bad).isNull()).drop(bad)


def read_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, COMPARISON, "*.json")


def read_critiques(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, CRITIQUE, "*_critique.json")


def read_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps of all files, a row each, with their place in the file."""
    return _read(spark, folder, GAPS, "*.json").select("file", F.posexplode("gaps").alias("pos", "gap")).select("file", "pos", "gap.*")


def findings_among(comparisons: DataFrame, papers: DataFrame, paper: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """Contradictions and complements of those comparisons both of whose papers are given, a row each; two semi-joins."""
    ids = papers.select(F.col(paper).alias("__id")).distinct()
    inside = comparisons.join(ids, F.col("paper_a") == F.col("__id"), "left_semi").join(ids, F.col("paper_b") == F.col("__id"), "left_semi")
    first = lambda x, *names: F.coalesce(*(x[n] for n in names), F.lit(""))
    c, d = F.col("c"), F.col("d")
    contradictions = inside.select("paper_a", "paper_b", F.explode("contradictions").alias("c")).select(
        "paper_a", "paper_b", first(c, "method", "entity").alias("method"), first(c, "claim_a", "text_a").alias("claim_a"), first(c, "claim_b", "text_b").alias("claim_b"),
        F.coalesce(c["severity"], F.lit("medium")).alias("severity"), F.coalesce(c["type"], F.lit("unknown")).alias("type"),
    )
    return contradictions, inside.select("paper_a", "paper_b", F.explode("complementary_findings").alias("d")).select("paper_a", "paper_b", first(d, "detail", "text").alias("detail"))


def parts_of_papers(papers: DataFrame, wanted: DataFrame, column: str, paper: str = "paper_id") -> DataFrame:
    """Claims, limitations or future work (``column``) of the wanted papers, in order; one join instead of a look-up a paper."""
    return papers.join(wanted.select(paper).distinct(), paper, "left_semi").select(paper, F.posexplode(column).alias("pos", "__x")).select(paper, "pos", "__x.*")


def write_json(rows: DataFrame, folder: str, by: str) -> None:
    """Rows as JSON lines in a folder for each value of ``by``, which must be text or a number; other values' folders stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(folder)


#: What agents write: the folder of each kind of output and the column whose values name its files.
WRITTEN = {
    "entities": ("enriched", "paper_id"), "claims": ("claims", "paper_id"), "critiques": ("critiques", "paper_id"), "papers": ("papers", "paper_id"), "comparisons": ("comparisons", "comparison_id"), "gaps": ("gaps", "gap_type"),
    "candidates": ("candidates", "collection"), "gap_matrix": ("gap_matrix", "dataset"),
}


def write_output(rows: DataFrame, root: str, kind: str) -> str:
    """Rows of a kind of output below ``root``; what was written before for the same names is replaced. The folder."""
    folder, by = WRITTEN[kind]
    write_json(rows, f"{root.rstrip('/')}/{folder}", by)
    return f"{root.rstrip('/')}/{folder}"


def finding_counts(comparisons: DataFrame) -> DataFrame:
    """How many contradictions and complements each comparison has; none for missing lists."""
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return comparisons.select("comparison_id", "paper_a", "paper_b", n("contradictions").alias("n_contradictions"), n("complementary_findings").alias("n_complements"))


def review_text(sections: DataFrame, order: list[str], text: str = "text") -> DataFrame:
    """The sections of one review (a handful of rows) joined by an empty line, as a table of one text."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t")))), lambda s: s["__t"])
    return sections.agg(F.array_join(parts, "\n\n").alias("value"))


def write_review(sections: DataFrame, folder: str, order: list[str], text: str = "text") -> None:
    review_text(sections, order, text).write.mode("overwrite").text(folder)


def headings_found(spark: SparkSession, path: str, headings: tuple[str, ...]) -> DataFrame:
    """Which headings each text file has, and how many."""
    found: list[Column] = [F.contains(F.lower("value"), F.lit(h.lower())) for h in headings]
    total = F.lit(0)
    for c in found:
        total = total + c.cast("int")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), *(c.alias(h) for c, h in zip(found, headings)), total.alias("n_found"))


def files_named(spark: SparkSession, folder: str, name: str = "*.pdf") -> DataFrame:
    """Paths and sizes of the files of a kind in order of their paths, without their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", True).load(folder).select("path", "length").orderBy("path")
