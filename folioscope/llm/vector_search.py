"""Exact top-k by inner product with vector-approximation files.

The file holds a byte for every component of every candidate: which of 64 cells of the component's range it is in. Queries
meet the file in blocks of bounded size; only these codes are shuffled, never the candidates' vectors. A scan gives each
candidate's highest and lowest possible score; a candidate goes on if its highest is not under what the query is sure to get:
the k-th best exact score among a bounded sample that every task has, or the k-th best lowest score of the block. Exact vectors
are then read for what is left in order of the highest possible score, in two waves: the first few of each query, and after
them those whose highest possible score reaches the k-th best exact score so far. Then the k-th result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import cut, in_share, schema

CELLS = 64
SCAN_QUERIES = 128
#: Candidates whose exact vectors every task has, to know early what a query is sure to get.
SEEN = 2048


class Grid:
    """CELLS equal cells of each component's range of integers."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, (high - low) // CELLS + 1

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors - self.low) // self.width).astype(np.uint8)

    def bounds(self, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A score for the corner of each cell, and what to add for the lowest and for the highest score within the cell, with
        room for what single precision loses."""
        q = queries.astype(np.float64)
        corner = (q * self.width).astype(np.float32) @ codes.astype(np.float32).T + (q @ self.low.astype(np.float64)).astype(np.float32)[:, None]
        room = np.abs(q) @ (CELLS * self.width + np.abs(self.low)).astype(np.float64) * 2.0**-22 * (1 + queries.shape[1] / 64) + 1
        rest = (self.width - 1).astype(np.float64)
        return corner, np.minimum(q, 0) @ rest - room, np.maximum(q, 0) @ rest + room


def scan(query_ids: np.ndarray, queries: np.ndarray, sure: np.ndarray, ids: np.ndarray, codes: np.ndarray, grid: Grid, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, highest possible score) of the pairs of a block that may be among a query's k best; ``sure`` is what
    each query gets at least for its k-th. Candidates with the query's id are left out."""
    at, who, most_of = [], [], []
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    for i in range(0, len(queries), SCAN_QUERIES):
        corner, least, most = grid.bounds(queries[i : i + SCAN_QUERIES], codes)
        for j, line in enumerate(corner):
            q = i + j
            line[order[np.searchsorted(sorted_ids, query_ids[q]) : np.searchsorted(sorted_ids, query_ids[q], side="right")]] = -np.inf
            floor = sure[q]
            if len(line) >= k:
                floor = max(floor, float(np.partition(line, len(line) - k)[len(line) - k]) + least[j])
            near = np.flatnonzero((line + most[j] >= floor) & np.isfinite(line))
            at.append(np.full(len(near), q))
            who.append(near)
            most_of.append(line[near] + most[j])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return join(at, np.int64), join(who, np.int64), join(most_of, np.float64)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten() if len(column) else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _kth(query_ids: list[int], queries: list[np.ndarray], seen: list[tuple[int, np.ndarray]], k: int) -> list[float]:
    """Each query's k-th best exact score among the vectors seen, its own id left out; minus infinity if there are fewer."""
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for i, q in zip(query_ids, queries):
        if len(q) not in by:
            own = [(a, v) for a, v in seen if len(v) == len(q)]
            by[len(q)] = np.array([a for a, _ in own], np.int64), np.array([v for _, v in own], np.float64).reshape(len(own), len(q))
        ids, vectors = by[len(q)]
        score = (vectors @ q.astype(np.float64))[ids != i]
        room = float(np.abs(score).max(initial=0)) * 2.0**-40
        out.append(float(np.partition(score, len(score) - k)[len(score) - k]) - room if len(score) >= k else -np.inf)
    return out


def _grids(exact: DataFrame) -> dict[int, Grid]:
    """The grid of each length of vectors: every task names the ends of each component once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                v = _matrix(batch.column("cells").filter(pa.array(dims == dim)), dim)
                low, high = ends.get(dim, (v[0], v[0]))
                ends[dim] = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        for dim, (low, high) in ends.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], ["dim", "at", "low", "high"])

    found = exact.select("dim", "cells").where("dim > 0").mapInArrow(run, schema(dim="int", at="int", low="long", high="long"))
    by: dict[int, list] = {}
    for r in found.groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "at").collect():
        by.setdefault(r["dim"], []).append((r["low"], r["high"]))
    return {dim: Grid(*np.array(ends, np.int64).T) for dim, ends in by.items()} | {0: Grid(np.zeros(0, np.int64), np.zeros(0, np.int64))}


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 32_768, query_block: int = 2_048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best by integer inner product of floor(scale * component).

    ``queries`` says which rows of ``vectors`` are queries; every row but those with the query's own id is a candidate, ties go
    to the smaller id. Rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part.
    Vectors of different lengths are not compared. A repeated query row counts once; repeated candidates count as often as
    given. An empty table gives no rows. Blocks hold about ``block`` candidates and ``query_block`` queries. Of equal vectors
    only the k + 1 with the smallest ids go into the file: no other can be a result.
    """
    ship(vectors.sparkSession)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    cells = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(queries, F.lit(False)).alias("asks"), cells.alias("cells"))
    rows = rows.withColumn("dim", F.size("cells")).withColumn("key", F.xxhash64("cells"))
    times = rows.groupBy("dim", "key", "cells", "vec_id").agg(F.count(F.lit(1)).alias("times"), F.max("asks").alias("asks"))
    equal = Window.partitionBy("dim", "key", "cells").orderBy("vec_id")
    exact = cut(times.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k + 1).drop("n", "asks"))
    asked = cut(times.where("asks").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query_key"), F.col("cells").alias("query"), "dim"))
    n = exact.count()
    n_queries = asked.count()
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_queries // query_block))
    grids = _grids(exact)
    seen = [(r["vec_id"], np.array(r["cells"], np.int64)) for r in exact.where(in_share(min(1.0, SEEN / max(1, n)), "vec_id", "key")).select("vec_id", "cells").limit(2 * SEEN).collect()]
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    block_of = lambda column, blocks: F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                codes = grids[dim].codes(_matrix(part.column("cells"), dim))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("dim", "key", "vec_id", "cb")), pa.array([x.tobytes() for x in codes], pa.binary())], ["dim", "key", "vec_id", "cb", "codes"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure = _kth(batch.column("query_id").to_pylist(), [np.array(x, np.int64) for x in batch.column("query").to_pylist()], seen, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sure, pa.float64())], [*batch.schema.names, "sure"])

    file = exact.withColumn("cb", block_of("vec_id", c_blocks)).mapInArrow(code, schema(dim="int", key="long", vec_id="long", cb="int", codes="binary"))
    file = file.select("*", spread(q_blocks).alias("qb"))
    wanted = asked.mapInArrow(bound, T.StructType([*asked.schema.fields, T.StructField("sure", T.DoubleType())])).select("*", block_of("query_id", q_blocks).alias("qb")).select("*", spread(c_blocks).alias("cb"))
    pairs = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("key", pa.int64()), ("most", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pairs.empty_table()
        dim = left.column("dim")[0].as_py()
        ids, sure = left.column("query_id").to_numpy(), left.column("sure").to_numpy()
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, dim)
        found = right.column("vec_id").to_numpy()
        at, who, most = scan(ids, _matrix(left.column("query"), dim), sure, found, codes, grids[dim], k)
        return pa.Table.from_arrays([pa.array(ids[at]), pa.array(left.column("query_key").to_numpy()[at]), pa.array(found[who]), pa.array(right.column("key").to_numpy()[who]), pa.array(most)], schema=pairs)

    keys = ["dim", "cb", "qb"]
    left = wanted.groupBy(*keys).cogroup(file.groupBy(*keys)).applyInArrow(run, schema(query_id="long", query_key="long", vec_id="long", key="long", most="double"))
    query = ["query_id", "query_key"]
    first = Window.partitionBy(*query).orderBy(F.col("most").desc(), "vec_id", "key")
    left = cut(left.withColumn("n", F.row_number().over(first)))
    product = F.aggregate(F.zip_with("query", "cells", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)

    def read(wave: DataFrame) -> DataFrame:
        """The exact scores of a wave."""
        near = wave.join(exact.drop("dim"), ["vec_id", "key"]).join(asked.drop("dim"), query)
        return near.select(*query, "vec_id", "times", product.alias("score"))

    best = Window.partitionBy(*query).orderBy(F.col("score").desc(), "vec_id")
    early = cut(read(left.where(F.col("n") <= 2 * k)))
    reached = early.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(*query, F.col("score").alias("reached"))
    late = left.where(F.col("n") > 2 * k).join(reached, query, "left").where(F.col("most") >= F.coalesce(F.col("reached").cast("double"), F.lit(float("-inf"))))
    found = early.unionByName(read(late.select(*query, "vec_id", "key")))
    found = found.select(*query, "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
