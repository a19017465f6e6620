"""Collections of chunks with their vectors: routed by type, one row an id, deleted by paper; keys of known entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import route, upsert

STORED = ("collection", "chunk_id", "paper_id", "embedding", "document")


def routed(chunks: DataFrame, kind: str = "chunk_type", text: str = "display_text") -> DataFrame:
    """Chunks with the collection of their type; those of unknown types are left out. A chunk of a known type without a vector is an
    error: it has to be embedded first."""
    rows = chunks.withColumn("collection", route(F.col(kind))).where("collection IS NOT NULL")
    vector = F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("chunk without an embedding: "), F.coalesce(F.col("chunk_id"), F.lit("null")))))
    return rows.select("collection", "chunk_id", "paper_id", vector.alias("embedding"), F.col(text).alias("document"))


def upsert_chunks(store: DataFrame, chunks: DataFrame, kind: str = "chunk_type", text: str = "display_text") -> DataFrame:
    """``store`` with new chunks put in, one row a collection and id; the last of repeated ones by text and paper counts."""
    return upsert(store.select(*STORED), routed(chunks, kind, text), ["collection", "chunk_id"], last=True, order=["document", "paper_id"])


def counts_of_collections(store: DataFrame) -> DataFrame:
    return store.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def without_paper(store: DataFrame, paper: object) -> tuple[DataFrame, DataFrame]:
    """``store`` without a paper, and (collection, n) of what was deleted; collections without any are not listed."""
    mine = F.col("paper_id").eqNullSafe(F.lit(paper))
    return store.where(~mine), counts_of_collections(store.where(mine))


def known_keys(entities: DataFrame, entity_id: str = "entity_id") -> DataFrame:
    """``(entity_type, key)`` of entity ids, split at their first ``::``; ids without one are left out."""
    parts = F.split(F.col(entity_id), "::", 2)
    return entities.where(F.contains(F.col(entity_id), F.lit("::"))).select(parts[0].alias("entity_type"), parts[1].alias("key")).distinct()
