"""Whitening of embeddings without a covariance: TSQR.

Vectors become integers, and every distinct one is fitted once. Rows are centred by their exact integer sums, each partition
reduces its rows to the R of a QR factorisation a batch at a time, and R factors of a fixed size (width x width) are merged in a
tree of tasks; only the last one reaches the driver. Its singular value decomposition gives the principal directions: with
X = QR and R = U D W', the covariance X'X / n is W (D^2 / n) W', so nothing is squared and small components keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import cut, fresh_path, schema

#: R factors that one task of the tree merges.
FAN = 16
#: Under this share of the largest singular value a component counts as constant.
RANK = 1e-13


def quantised(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows that take part: x is floor(scale * c) of each entry as a long."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", F.transform("v", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def _exact(n: int, x: np.ndarray, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as integers of 64 bits if no entry can overflow, else as Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if bound < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: its size is that of the kept components and does not grow with the rows."""

    n: int
    sums: list[int]
    directions: np.ndarray  # width x kept
    scales: np.ndarray  # square roots of the kept eigenvalues
    explained: np.ndarray
    identity_error: float

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whitened rows, and n * x - sums."""
        moved = _exact(self.n, x, self.sums)
        return (moved / self.n).astype(np.float64) @ self.directions / self.scales, moved


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension: each partition adds up its batches, one row a partition and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                exact = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 2**62 else x.astype(object).sum(axis=0)
                total = exact.astype(object) if total is None else total + exact
                n += len(x)
        if n:
            at = list(range(len(total)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n] * len(at), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["at", "n", "s"])

    parts = rows.mapInArrow(run, "at int, n long, s decimal(38,0)")
    found = sorted(parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect(), key=lambda r: r["at"])
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def _factor(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows / sqrt(n), merged in a tree."""
    width = len(sums)

    def packed(part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], ["part", "r"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = (_exact(n, _matrix(batch.column("x").slice(k, 4096)), sums) / n).astype(np.float64)
                r = np.linalg.qr(np.concatenate((r, x)), mode="r")
        if len(r):
            yield packed(TaskContext.get().partitionId(), r)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        r = np.zeros((0, width))
        for part in sorted(zip(table.column("part").to_pylist(), table.column("r").to_pylist())):
            r = np.linalg.qr(np.concatenate((r, np.frombuffer(part[1], "<f8").reshape(-1, width))), mode="r")
        return pa.Table.from_batches([packed(key[0].as_py(), r)])

    left = cut(rows.mapInArrow(reduce, schema(part="long", r="binary")))
    while left.count() > FAN:
        left = cut(left.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInArrow(merge, schema(part="long", r="binary")))
    last = left.groupBy(F.lit(0).cast("long").alias("up")).applyInArrow(merge, schema(part="long", r="binary")).collect()
    return np.frombuffer(last[0]["r"], "<f8").reshape(-1, width) / np.sqrt(n)


def _error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity: two passes, centred before multiplying."""
    kept, n = len(model.scales), model.n

    def add(of) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                if batch.num_rows:
                    total = total + of(model.apply(_matrix(batch.column("x")))[0])
            if isinstance(total, np.ndarray):
                flat = total.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "s"])

        found = rows.mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        return np.array([r["s"] for r in sorted(found, key=lambda r: r["at"])])

    mean = add(lambda w: w.sum(axis=0)) / n
    covariance = add(lambda w: (w - mean).T @ (w - mean)).reshape(kept, kept) / n
    return float(np.abs(covariance - np.eye(kept)).max())


def fit(x: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` (an array of longs, none of them null); None if there are none of any width.

    All vectors must have the same width. Where fewer components vary than are asked for, only those are kept.
    """
    path = fresh_path(x.sparkSession, "fit")
    x.select("x").distinct().write.parquet(path)
    rows = x.sparkSession.read.parquet(path)
    n, sums = _totals(rows)
    if not sums:
        return None
    _, singular, right = np.linalg.svd(_factor(rows, n, sums))
    eigen = singular**2
    kept = min(components, int((singular > RANK * singular[0]).sum())) if singular[0] > 0 else 0
    model = Whitening(n, sums, right[:kept].T.copy(), singular[:kept], eigen[:kept] / eigen.sum() if kept else eigen[:0], 0.0)
    if not kept:
        return model
    return Whitening(model.n, model.sums, model.directions, model.scales, model.explained, _error(rows, model))


def whiten(vectors: DataFrame, scale: float = 256.0, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of ``vectors`` that takes part: vec_id, n (distinct vectors), deviation (exact sum of the squares of
    n * x - S, a decimal), whitened (one double a component, by falling eigenvalue), explained, identity_error.

    A vector that is null, or holds a null, NaN or infinite entry, takes no part; one that has no entries, or not as many as the
    longest, neither. Vectors of which all are equal have no components: whitened is empty, as it is short where fewer than
    ``components`` directions vary. Repeated vectors are fitted once and returned as often as given, null ids as given. An empty
    table gives no rows; other columns are not read. ``deviation`` fails beyond 38 digits instead of being wrong.
    """
    x = quantised(vectors, scale, id_col, vector_col)
    width = x.agg(F.max(F.size("x"))).first()[0] or 0
    x = x.where((F.size("x") == width) & (F.size("x") > 0))
    model = fit(x, components)
    kept = 0 if model is None else len(model.scales)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            white, moved = model.apply(_matrix(batch.column("x")))
            small = moved.dtype != object and int(np.abs(moved).max(initial=0)) < 2**31 // max(1, moved.shape[1])
            squares = (moved if small else moved.astype(object)) ** 2
            deviation = pa.array([Decimal(int(s)) for s in squares.sum(axis=1)], pa.decimal128(38, 0))
            ends = pa.array(np.arange(len(white) + 1) * kept, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(ends, pa.array(white.ravel()))], ["vec_id", "deviation", "whitened"])

    kind = T.StructType([T.StructField("vec_id", x.schema["vec_id"].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    found = x.mapInArrow(run, kind)
    explained: Column = F.array(*(F.lit(float(e)) for e in model.explained)) if kept else F.array().cast("array<double>")
    n, error = (0, 0.0) if model is None else (model.n, model.identity_error)
    return found.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
