"""The corpus pipeline: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``. Null texts and ids, repeated rows and empty tables are defined
by the operators; a stage that changes texts sets n_chars to the new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import pii, quality_crf
from folioscope.llm.common import cut, fresh_path, part_count
from folioscope.llm.jaccard import surplus, with_ids
from folioscope.llm.packing import best_fit, word_count
from folioscope.llm.simhash import near_duplicates
from folioscope.llm.suffix_array import deduplicate_bytes
from folioscope.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go."""
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _documents(quality_crf.classify(_documents(docs), model).where("quality_predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates go: of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the
    smallest id stays.

    Of rows with the same id and text one stays, that with the least other columns. Rows that share an id but not the text can't
    be named by it, nor can documents without an id: they all stay.
    """
    docs = _documents(docs)
    named = docs.where("doc_id IS NOT NULL")
    repeated = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = with_ids(named, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x"))
    again = cut(again.select("doc_id", "text", "x.*").select(*COLUMNS))
    shared = again.groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = with_ids(named, repeated, "left_anti").select(*COLUMNS).unionByName(with_ids(again, shared, "left_anti").select(*COLUMNS))
    stays = with_ids(again, shared, "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))
    return with_ids(once, surplus(once, shingle_words=5), "left_anti").select(*COLUMNS).unionByName(stays)


def exact_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier 100-byte string go; characters cut in the middle go with them, and so do documents of which
    nothing but white space is left (blank from the start, they stay)."""
    found = deduplicate_bytes(_documents(docs), length=100)
    kept = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.expr("try_validate_utf8(cast(kept as string))"))
    kept = F.coalesce(kept, F.when(F.size("spans") > 0, F.regexp_replace(F.expr("make_valid_utf8(cast(kept as string))"), "�", "")))
    left = found.withColumn("text", kept)
    left = left.where((F.size("spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(left.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets."""
    found = pii.detect(_documents(docs), pii.fit(docs))
    clean = pii.redact(found)
    return _documents(clean.withColumn("n_chars", F.when(F.size("pii_spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in bins of 2,048 words. Documents that op1 still links share no bin."""
    found = near_duplicates(docs, max_bits=4, shingle_words=4, carry={"size": word_count(), "source": F.col("source")})
    return best_fit(found, capacity=2048, per_source=4, size=F.col("size"), cluster=F.col("component_id"), shards=part_count(docs, 8))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", exact_substrings),
    ("PII", personal_data),
    ("best-fit packing", packing),
]

#: SQL can't express the fields, the fingerprints' components or best-fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder before the next reads it."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
