"""The registered queries of this subpackage: each runs one operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality_crf
from .bpe import decode, encode
from .common import part_count
from .oracles import ORACLES
from .ngram_join import near_duplicate_sets
from .packing import best_fit, word_count
from .quality_rules import let, quality_rules
from .runs import periodic_runs, strongest
from .simhash import near_duplicates
from .substring import deduplicate_words
from .suffix_array import deduplicate_bytes
from .token_store import read_tokens, write_tokens
from .vector_search import top_k
from .whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_documents(spark, sf_dir), max_bits=4, shingle_words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_words(_documents(spark, sf_dir), length=20)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality_crf.classify(docs, model, threshold=0.3)
    return found.select("doc_id", quality_crf.held_out().alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def _digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = pii.detect(docs, pii.fit(docs)).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("pii_spans")).alias("spans"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate_bytes(_documents(spark, sf_dir), length=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes are words, clusters the components of near-duplicates: no bin holds two documents that op1 links."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = near_duplicates(docs, max_bits=4, shingle_words=4, carry={"size": word_count(), "source": F.col("source")})
    return best_fit(found, capacity=2048, per_source=4, size=F.col("size"), cluster=F.col("component_id"), shards=part_count(docs, 8))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = decode(encode(_documents(spark, sf_dir), path, pattern).drop("text"), path, pattern)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def _with_runs(docs: DataFrame) -> DataFrame:
    """``docs``, where the contract asks for it with the words from some position on repeating what stands there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")

        def turned(x: Column) -> Column:
            a, p = x["a"], x["p"]
            return F.transform(w, lambda own, i: F.when(i >= a, F.get(w, (a + F.pmod(i - a, p)).cast("int"))).otherwise(own))

        start = F.pmod(g, n)
        return F.array_join(let(F.struct(start.alias("a"), (F.lit(1) + F.floor((n - start) / (3 + g % 8))).alias("p")), turned), " ")

    changed = let(words, lambda w: F.when(F.size(w) > 0, repeated(w)))
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(changed, F.col("text"))).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_with_runs(_documents(spark, sf_dir)), least=24, periods=3).withColumn("best", strongest("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_sets(_documents(spark, sf_dir), shingle_words=5)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=256.0, components=4)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = found.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_store": op2_token_store,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_vector_search": op4_vector_search,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_crf": op6_quality_crf,
    "op7_pii": op7_pii,
    "op8_suffix_array": op8_suffix_array,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ngram_join": op12_ngram_join,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLES", "QUERIES"]
