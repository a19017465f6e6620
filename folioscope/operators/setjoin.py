"""Joins of sets by similarity or overlap, block by block: shared members of all sets of two blocks are counted together.

Blocks are cut by size, so that blocks whose sizes rule out a similarity never meet, and sets of one size are dealt by their owner's
hash. Each two blocks that can meet are a group of its own: members that many of its sets have are counted by products of matrices,
rarer ones by the sets that hold them. Only what is similar leaves a group; no pair is shuffled, nor a set once a pair. Where sets of
one table meet, blocks are packed and kept once and read from there, so a set is not sent once a block either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .blocks import meeting_blocks, met_tables, packed

#: Sets and members of a block that are aimed at, groups that a task takes, about, and tasks at most.
SETS, ITEMS, GROUPS, MOST_PARTS = 2_048, 1_000_000, 4, 20_000
#: Members whose sets meet in more than one of so many pairs of a group are counted by matrices; columns of these, and pairs counted at once.
RARE, COLUMNS, AT_ONCE = 600, 1_024, 4_000_000


def collected_sets(members: DataFrame, owner: str, member: str) -> DataFrame:
    """``(owner, items, n)``: each owner's distinct members. Null members are none."""
    sets = members.where(F.col(member).isNotNull()).groupBy(owner).agg(F.collect_set(member).alias("items"))
    return sets.withColumn("n", F.size("items"))


def _meetings(a: np.ndarray, a_at: np.ndarray, x: int, b: np.ndarray, b_at: np.ndarray, y: int) -> np.ndarray:
    """How many members each of ``x`` sets shares with each of ``y``: members ``a`` of sets ``a_at``, and ``b`` of ``b_at``."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    in_a, in_b = np.bincount(a, minlength=n), np.bincount(b, minlength=n)
    common = in_a * in_b > x * y // RARE
    shared = np.zeros((x, y), np.float32)
    columns = np.flatnonzero(common)
    place = np.full(n, -1)
    place[columns] = np.arange(len(columns))
    for first in range(0, len(columns), COLUMNS):
        sides = []
        for members, at, size in ((a, a_at, x), (b, b_at, y)):
            c = place[members] - first
            here = (place[members] >= 0) & (c >= 0) & (c < COLUMNS)
            m = np.zeros((size, min(COLUMNS, len(columns) - first)), np.float32)
            m[at[here], c[here]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    order = np.argsort(b, kind="stable")
    starts = np.cumsum(in_b) - in_b
    rare = np.flatnonzero(~common[a] & (in_b[a] > 0))
    many = in_b[a[rare]]
    ends = np.cumsum(many)
    low = 0
    while low < len(rare):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        m, some = many[low:high], rare[low:high]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        met = np.repeat(a_at[some], m) * y + b_at[order[np.repeat(starts[a[some]], m) + inner]]
        shared += np.bincount(met, minlength=x * y).reshape(x, y)
        low = high
    return shared


def _found(table: pa.Table, low: int, high: int, a: str, b: str, wanted: Callable) -> Iterator[pa.RecordBatch]:
    """``(a, b, n_shared, n_a, n_b)`` of the pairs of two blocks that ``wanted(shared, n_a, n_b)`` marks; rows have __block, the one of these
    that is theirs. Where both are one block, each two of its sets meet once."""
    block = table.column("__block").to_numpy()
    items = table.column("items").combine_chunks()
    sizes = pc.list_value_length(items).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = items.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(block)), sizes)
    sides = []
    for k in (low, high):
        rows = np.flatnonzero(block == k)
        place = np.full(len(block), -1)
        place[rows] = np.arange(len(rows))
        here = place[owner] >= 0
        sides.append((rows, codes[here], place[owner[here]]))
    (left, x, x_at), (right, y, y_at) = sides
    if not len(left) or not len(right):
        return
    shared = _meetings(x, x_at, len(left), y, y_at, len(right))
    mask = wanted(shared, sizes[left][:, None], sizes[right][None, :])
    i, j = np.nonzero(np.triu(mask, 1) if low == high else mask)
    names_a, names_b = table.column(a).combine_chunks(), table.column(b).combine_chunks()
    for k in range(0, len(i), 100_000):
        u, v = left[i[k : k + 100_000]], right[j[k : k + 100_000]]
        n = shared[i[k : k + 100_000], j[k : k + 100_000]].astype(np.int32)
        if a == b:  # of two owners of one kind the smaller is a
            ordered = pc.less(names_a.take(pa.array(u)), names_a.take(pa.array(v))).to_numpy(zero_copy_only=False)
            u, v = np.where(ordered, u, v), np.where(ordered, v, u)
        columns = [names_a.take(pa.array(u)), names_b.take(pa.array(v)), pa.array(n), pa.array(sizes[u].astype(np.int32)), pa.array(sizes[v].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_shared", "n_a", "n_b"])


def _met(dealt: DataFrame, a: str, b: str, wanted: Callable, n_groups: int) -> DataFrame:
    """``_found`` of rows that have __low and __high, their group, too."""
    ship(dealt.sparkSession)
    parts = min(MOST_PARTS, max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_groups // GROUPS))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _found(pa.Table.from_batches(list(batches)), *(k.as_py() for k in key), a, b, wanted)

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    rows = dealt.select("__low", "__high", "__block", *dict.fromkeys([a, b]), "items").repartition(parts, "__low", "__high")
    return rows.groupBy("__low", "__high").applyInArrow(run, f"a {kinds[a]}, b {kinds[b]}, n_shared int, n_a int, n_b int")


def _bands(counts: list[tuple[int, int]], threshold: float) -> list[tuple[int, int, int, int, int]]:
    """``(n, first, blocks, from, to)`` for each size: its blocks, and the blocks with whose sets its own can be similar."""
    bands: list[list] = []  # sizes, sets, members, blocks
    for n, count in sorted(counts):
        if bands and bands[-1][1] + count <= SETS and bands[-1][2] + n * count <= ITEMS:
            bands[-1][0].append(n)
            bands[-1][1:3] = bands[-1][1] + count, bands[-1][2] + n * count
        else:
            bands.append([[n], count, n * count])
    blocks = [max(1, -(-sets // SETS), -(-members // ITEMS)) for _, sets, members in bands]
    first = np.cumsum(blocks) - blocks
    out = []
    for i, (sizes, _, _) in enumerate(bands):
        near = [j for j, (other, _, _) in enumerate(bands) if min(max(sizes), max(other)) >= threshold * max(min(sizes), min(other)) - 1e-9]
        out += [(n, int(first[i]), blocks[i], int(first[near[0]]), int(first[near[-1]]) + blocks[near[-1]] - 1) for n in sizes]
    return out


def similar_arrays(sets: DataFrame, owner: str, threshold: float) -> DataFrame:
    """``similar_sets`` of sets that are collected: ``(owner, items, n)``, items distinct. They are read twice; sets of one owner are no pair."""
    sets = sets.where("n > 0")
    bands = _bands([tuple(r) for r in sets.groupBy("n").count().collect()], threshold)  # a row for each size that a set has
    sizes = F.broadcast(sets.sparkSession.createDataFrame(bands, "n int, __first int, __blocks int, __from int, __to int"))
    block = (F.col("__first") + F.pmod(F.xxhash64(owner), F.col("__blocks"))).cast("int").alias("__block")
    dealt = sets.join(sizes, "n").select(owner, "items", block, "__to")
    parts = max(1, min(isqrt(MOST_PARTS), max((first + blocks for _, first, blocks, _, _ in bands), default=1)))
    ship(sets.sparkSession)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"__block": pa.array([key[0].as_py()], pa.int32()), "__to": pa.array([key[1].as_py()], pa.int32()), "__rows": pa.array([packed(table.select([owner, "items"]))], pa.binary())})

    kept = cut(dealt.repartition(parts, "__block").groupBy("__block", "__to").applyInArrow(pack, "__block int, __to int, __rows binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in met_tables(batches):
            yield from _found(table, *key, owner, owner, lambda shared, n_a, n_b: shared >= threshold * (n_a + n_b - shared.astype(np.float64)) - 1e-9)

    kind = sets.schema[owner].dataType.simpleString()
    return meeting_blocks(kept, "__high <= __to").mapInArrow(run, f"a {kind}, b {kind}, n_shared int, n_a int, n_b int").where("a <> b")


def similar_sets(members: DataFrame, owner: str, member: str, threshold: float) -> DataFrame:
    """``(a, b, n_shared, n_a, n_b)``, a < b: pairs of owners whose sets have a Jaccard similarity of ``threshold`` or more.

    Empty sets are similar to none.
    """
    return similar_arrays(cut(collected_sets(members, owner, member)), owner, threshold)


def overlapping_sets(left: DataFrame, right: DataFrame, left_owner: str, right_owner: str, member: str, least: int) -> DataFrame:
    """``(a, b, n_shared, n_a, n_b)``: owners of the left and of the right table whose sets share ``least`` members or more."""
    x, y = (cut(collected_sets(rows, own, member).where(F.col("n") >= least)) for rows, own in ((left, left_owner), (right, right_owner)))
    return overlapping_arrays(x, y, left_owner, right_owner, least)


def overlapping_arrays(x: DataFrame, y: DataFrame, left_owner: str, right_owner: str, least: int) -> DataFrame:
    """``overlapping_sets`` of sets that are arrays: ``(owner, items, n)``, a row a set, items distinct and neither they nor the array
    null, n their number or a bound of it. Their n is read first, then they are read once. An owner may be a struct, so that what is
    known of it need not be joined to the pairs."""
    blocks = []
    for sets in (x, y):
        n, members = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        blocks.append(max(1, -(-n // SETS), -(-members // ITEMS)))
    kind_a, kind_b = x.schema[left_owner].dataType, y.schema[right_owner].dataType

    def side(sets: DataFrame, owner: str, mine: int, others: int, shift: int) -> DataFrame:
        """Blocks of the right table follow those of the left."""
        own = F.pmod(F.xxhash64(owner), F.lit(mine)).cast("int") + shift
        other = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        names = [F.col(owner).alias("__a") if shift == 0 else F.lit(None).cast(kind_a).alias("__a"), F.col(owner).alias("__b") if shift else F.lit(None).cast(kind_b).alias("__b")]
        dealt = sets.select(*names, "items", own.alias("__block"), other.alias("__other"))
        low, high = ("__block", F.col("__other") + blocks[0]) if shift == 0 else ("__other", F.col("__block"))
        return dealt.withColumn("__low", F.col(low)).withColumn("__high", high).drop("__other")

    dealt = side(x, left_owner, *blocks, 0).unionByName(side(y, right_owner, *blocks[::-1], blocks[0]))
    return _met(dealt, "__a", "__b", lambda shared, n_a, n_b: shared >= least, blocks[0] * blocks[1])
