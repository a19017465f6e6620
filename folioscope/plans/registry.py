"""Registered queries: a name, a function of (tables), and the DuckDB SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @property
    def mentions(self) -> DataFrame:
        """Entity mentions of papers: an order is a paper, a line item a mention of a method, a task and a dataset."""
        lines = self.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_extendedprice")
        parts = self.part.select("p_partkey", "p_brand", "p_type", "p_name")
        places = self.supplier.select("s_suppkey", "s_nationkey").join(self.nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
        joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        return joined.select(
            F.col("l_orderkey").alias("paper_id"),
            F.col("l_linenumber").alias("pos"),
            F.col("p_brand").alias("method"),
            F.col("p_type").alias("task"),
            F.col("n_name").alias("dataset"),
            F.col("p_name").alias("raw_text"),
            F.col("l_partkey").alias("part_id"),
            (1 - F.col("l_discount")).alias("confidence"),
            F.col("l_extendedprice").alias("price"),
        )

    @property
    def claims(self) -> DataFrame:
        """Numeric claims: an event is a claim of its user's paper about a metric on a dataset."""
        return self.events.select(
            F.col("event_id").alias("claim_id"),
            F.col("user_id").alias("paper_id"),
            F.col("event_type").alias("metric"),
            F.get_json_object("props", "$.k").cast("int").alias("dataset"),
            "value",
            "ts",
        )


MENTIONS = """mentions AS (
  SELECT l_orderkey AS paper_id, l_linenumber AS pos, p_brand AS method, p_type AS task, n_name AS dataset, p_name AS raw_text,
         l_partkey AS part_id, 1 - l_discount AS confidence, l_extendedprice AS price
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
CLAIMS = """claims AS (
  SELECT event_id AS claim_id, user_id AS paper_id, event_type AS metric, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS dataset, value, ts
  FROM events)"""


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql.replace("{MENTIONS}", MENTIONS).replace("{CLAIMS}", CLAIMS)
        return f

    return register
