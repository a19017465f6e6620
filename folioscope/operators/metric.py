"""Threshold joins in a metric space, across all rows: pivots, and the triangle inequality.

A bounded number of rows serve as pivots; each row belongs to the cell of its nearest one. If u and v are within r of each other
and v is in the cell of p, then u is not nearer to its own pivot than to p by more than r allows, nor farther from p than the
cell's radius and r. So u is also sent to the few other cells that this leaves, and within a cell only rows whose distances to
the pivot differ by r or less are compared. A cell with many rows is cut into chunks, and each pair of chunks is a task.

Where distances hardly differ, no pivot prunes anything and rows would be sent to nearly all cells. What would be sent is counted
first; if blocks of all rows against each other send less, these meet instead, by products of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship
from . import blocks

#: Rows of a cell that are aimed at, at most how many pivots every task has, and rows of a chunk.
CELL_ROWS, MOST_PIVOTS, CHUNK = 500, 2048, 1000
#: Room for what double precision loses, and for what products of matrices lose of a square; rows of a tile of them.
ROOM, SQUARE_ROOM, TILE = 1e-9, 1e-9, 512
#: What single precision loses of a term, with room to spare, and squares up to which it is used.
SINGLE, SINGLE_MOST = 2.4e-7, 1e30


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0))


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def _cells(rows: DataFrame, radius: float, pivots: int | None, most: int | None = None) -> DataFrame | None:
    """Rows (id, v) with the cells that they are sent to: distance to the pivot, whether it is their own, and the chunks that meet.
    None if more than ``most`` rows would be sent."""
    id_type = rows.schema["id"].dataType
    n = rows.count()
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(MOST_PIVOTS, n // CELL_ROWS if pivots is None else pivots))).collect()
    centres = np.array([r["v"] for r in chosen]) if chosen else np.zeros((1, 1))
    apart = _distances(centres, centres)
    fields = [T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.DoubleType()))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), centres)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(d[np.arange(len(own)), own])], ["id", "v", "own", "d"])

    assigned = cut(rows.mapInArrow(assign, T.StructType([*fields, T.StructField("own", T.IntegerType()), T.StructField("d", T.DoubleType())])))
    reach = np.full(len(centres), -np.inf)
    for r in assigned.groupBy("own").agg(F.max("d").alias("d")).collect():  # one number a pivot
        reach[r["own"]] = r["d"]

    def to_cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = batch.column("own").to_numpy()
        d = _distances(_matrix(batch.column("v")), centres)
        mine = d[np.arange(len(own)), own]
        with np.errstate(divide="ignore", invalid="ignore"):
            beyond = (d**2 - mine[:, None] ** 2) / (2 * apart[own])  # how far the half space of p is
        near = (d <= reach + radius + ROOM) & ~(beyond > radius + ROOM)
        near &= np.arange(len(centres)) >= own[:, None]  # a pair meets in the cell with the higher number
        return *np.nonzero(near), own, d

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, cell, own, d = to_cells(batch)
                at_rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at_rows), batch.column("v").take(at_rows), pa.array(cell, pa.int32()), pa.array(own[at] == cell), pa.array(d[at, cell])], ["id", "v", "cell", "inner", "d"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(centres), np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(to_cells(batch)[1], minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres)), pa.int32()), pa.array(n)], ["cell", "n"])

    counts = cut(assigned.mapInArrow(tally, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 0"))  # a row a pivot
    chunks = counts.select("cell", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    if most is not None and (chunks.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0) > most:
        return None
    sent = assigned.mapInArrow(send, T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("inner", T.BooleanType()), T.StructField("d", T.DoubleType())]))
    parts = sent.join(F.broadcast(chunks.drop("n")), "cell").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parts.select("id", "v", "inner", "d", "cell", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine")


def _compared(table: pa.Table, low: int, high: int, radius: float) -> Iterator[tuple[int, np.ndarray]]:
    """Positions that are compared: of a table in order of distance to the pivot, what the triangle inequality leaves."""
    d, inner, chunk = table.column("d").to_numpy(), table.column("inner").to_numpy(zero_copy_only=False), table.column("mine").to_numpy()
    last = np.searchsorted(d, d + radius + ROOM, side="right")
    for i in range(len(d)):
        j = np.arange(i + 1, last[i])
        j = j[(inner[i] | inner[j]) & ((low == high) | (chunk[j] != chunk[i]))]
        if len(j):
            yield i, j


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``scores.dot`` of rows: entries are added in order, as there."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total = total + x[:, d] * y[:, d]
    return total


def close_pairs(vectors: DataFrame, vec_id: str, vector: str, radius: float, pivots: int | None = None, dots: bool = False) -> DataFrame:
    """``(a, b, distance)``, a < b: all pairs of rows within ``radius`` in Euclidean distance; with ``dots`` their ``dot`` too.

    Rows with a null id, a null vector or one with a null or non-finite entry take no part; all vectors have one length and ids
    are distinct. The pivots (a number that grows with the rows, up to MOST_PIVOTS) decide how much is compared, never what is found.
    """
    ship(vectors.sparkSession)
    rows = cut(_usable(vectors, vec_id, vector))
    id_type = rows.schema["id"].dataType

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("d")
        x = _matrix(table.column("v"))
        left, right, far, products = [], [], [], [np.zeros(0)]
        for i, j in _compared(table, key[1].as_py(), key[2].as_py(), radius):
            distance = np.sqrt(((x[j] - x[i]) ** 2).sum(axis=1))
            ok = distance <= radius
            left += [i] * int(ok.sum())
            right += j[ok].tolist()
            far += distance[ok].tolist()
            if dots:
                products.append(_dots(np.broadcast_to(x[i], (int(ok.sum()), x.shape[1])), x[j[ok]]))
        ids = table.column("id").combine_chunks()
        a, b = ids.take(pa.array(left, pa.int64())), ids.take(pa.array(right, pa.int64()))
        swap = pc.greater(a, b)
        columns = {"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b), "distance": pa.array(far, pa.float64())}
        return pa.table(columns | ({"dot": pa.array(np.concatenate(products))} if dots else {}))

    kind = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("distance", T.DoubleType()), *([T.StructField("dot", T.DoubleType())] if dots else [])])
    n = rows.count()
    most = n * max(1, -(-n // blocks.VECTORS)) if pivots is None and n > CHUNK else None
    cells = _cells(rows, radius, pivots, most)
    return _block_pairs(rows, radius, kind) if cells is None else cells.groupBy("cell", "low", "high").applyInArrow(compare, kind)


def _may_be_near(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of rows of ``x`` and ``y``, a tile at a time, that lie within ``radius``, and few others: squares of distances are one
    product of matrices in single precision, with room for what it loses, or of larger numbers in double precision."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most = xx.max(initial=0.0) + yy.max(initial=0.0)
    kind, lost = (np.float32, SINGLE * (x.shape[1] + 8)) if most < SINGLE_MOST else (np.float64, SQUARE_ROOM)
    bound = kind(radius**2 + SQUARE_ROOM + lost * most)
    left = np.concatenate((-2 * x, xx[:, None], np.ones((len(x), 1))), axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate((y, np.ones((len(y), 1)), yy[:, None]), axis=1).astype(kind).T)
    for first in range(0, len(x), TILE):
        at = np.flatnonzero(~(left[first : first + TILE] @ right > bound))
        yield at // len(y) + first, at % len(y)


def _block_pairs(rows: DataFrame, radius: float, kind: T.StructType) -> DataFrame:
    """All blocks of rows (id, v) against each other, packed and kept once; a product of matrices leaves out what is surely farther,
    the rest is measured."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (low, high), table in blocks.met_tables(batches):
            size = pc.list_value_length(table.column("v")).to_numpy()
            for n in np.unique(size):  # lengths never meet
                yield from compare(low, high, table.filter(pa.array(size == n)))

    def compare(low: int, high: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        block, ids, v = table.column("__block").to_numpy(), table.column("id").combine_chunks(), _matrix(table.column("v"))
        left, right = (np.flatnonzero(block == k) for k in (low, high))
        x, y = v[left], v[right]
        for i, j in _may_be_near(x, y, radius) if len(x) and len(y) else ():
            if low == high:  # each pair is met from both sides
                i, j = i[i < j], j[i < j]
            distance = np.sqrt(((y[j] - x[i]) ** 2).sum(axis=1))
            near = distance <= radius
            a, b = ids.take(pa.array(left[i[near]])), ids.take(pa.array(right[j[near]]))
            swap = pc.greater(a, b)
            columns = [pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(distance[near]), *([pa.array(_dots(x[i[near]], y[j[near]]))] if "dot" in kind.names else [])]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return blocks.meeting_blocks(blocks.packed_blocks(rows, "id", block_rows=blocks.VECTORS)).mapInArrow(run, kind)


def comparisons(vectors: DataFrame, vec_id: str, vector: str, radius: float, pivots: int | None = None) -> DataFrame:
    """``(cell, low, high, rows, compared)``: what each task of ``close_pairs`` holds and how many pairs it measures."""
    ship(vectors.sparkSession)

    def count(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("d")
        n = sum(len(j) for _, j in _compared(table, key[1].as_py(), key[2].as_py(), radius))
        return pa.table({"cell": [key[0].as_py()], "low": [key[1].as_py()], "high": [key[2].as_py()], "rows": [table.num_rows], "compared": [n]})

    cells = _cells(cut(_usable(vectors, vec_id, vector)), radius, pivots)
    return cells.groupBy("cell", "low", "high").applyInArrow(count, "cell long, low long, high long, rows long, compared long")
