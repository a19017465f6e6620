"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Bins are ordered by what room they have left: a list per residual, and one bitmap over residuals whose first set bit at or
above a document's size is the successor. A bin carries a bitmap of the duplicate clusters in it and one bitmap for each
further document of a source, up to the limit. The successor search goes on past bins that conflict, to the tightest one that
does not. Documents are dealt into shards by a hash, so that a source or cluster with a third of all rows is spread evenly.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import part_count, schema


class Bins:
    """Open and full bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some bin has r left
        self.room: list[int] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []  # plane j: sources with over j documents in the bin

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Place a document; ``source`` and ``cluster`` are bits (0: none). Returns the bin and the offset in it."""
        left = self.rooms >> size
        base = size
        while left:
            step = (left & -left).bit_length() - 1
            room = base + step
            for b in self.by_room[room]:
                if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                    return b, self._fill(b, room, size, source, cluster)
            left >>= step + 1
            base = room + 1
        self.room.append(self.capacity)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        b = len(self.room) - 1
        self.by_room.setdefault(self.capacity, []).append(b)
        self.rooms |= 1 << self.capacity
        return b, self._fill(b, self.capacity, size, source, cluster)

    def _fill(self, b: int, room: int, size: int, source: int, cluster: int) -> int:
        if size:
            at = self.by_room[room]
            at.remove(b)
            if not at:
                del self.by_room[room]
                self.rooms &= ~(1 << room)
            self.room[b] = room - size
            self.by_room.setdefault(room - size, []).append(b)
            self.rooms |= 1 << (room - size)
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for j, plane in enumerate(planes):
            if not plane & source:
                planes[j] = plane | source
                break
        return self.capacity - room


def pack(sizes: list[int], sources: Iterable, clusters: Iterable, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, placed from the largest down; equal sizes in the order given."""
    names: dict = {}
    bit = [1 << names.setdefault(s, len(names)) for s in sources]
    count: dict = {}
    clusters = list(clusters)
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    number: dict = {}
    cluster_bit = [1 << number.setdefault(c, len(number)) if c is not None and count[c] > 1 else 0 for c in clusters]
    bins, placed = Bins(capacity, per_source), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        placed[i] = bins.add(sizes[i], bit[i], cluster_bit[i])
    return placed


def word_count(text: str = "text") -> Column:
    trimmed = F.btrim(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def same_words(text: str = "text") -> Column:
    """A cluster for texts with the same words, whatever their case and spacing."""
    return F.xxhash64(F.regexp_replace(F.btrim(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", " "))


def best_fit(docs: DataFrame, capacity: int = 2048, per_source: int = 4, size: Column | None = None, cluster: Column | None = None, source: Column | None = None, id_col: str = "doc_id", shard_mb: int = 8, shards: int | None = None) -> DataFrame:
    """doc_id, piece, start, size, bin_id, bin_offset, source, cluster_id: where each piece of each document goes.

    ``size`` is in units of ``capacity`` (words by default; null: 0); a longer document is cut into full pieces and a rest. No
    bin holds two documents of one cluster, nor over ``per_source`` of one source; the pieces of one document go to different
    bins, its full pieces to bins of their own. A null cluster conflicts with nothing, a null source is a source. Empty
    documents take no room but keep the rules. By default texts with the same words are one cluster; ``near_duplicates`` gives
    wider ones. ``shards`` is how many sets of bins there are, by default one for ``shard_mb`` of ``docs``. Every row is placed once, repeated rows too; an empty table gives no rows.
    Only these columns are shuffled, never texts.
    """
    ship(docs.sparkSession)
    held = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.greatest(F.coalesce(word_count() if size is None else size.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("total"),
        (F.col("source").cast("string") if source is None else source.cast("string")).alias("source"),
        (same_words() if cluster is None else cluster.cast("long")).alias("cluster_id"),
    )
    shards = shards or part_count(docs, shard_mb)
    held = held.withColumn("shard", F.pmod(F.xxhash64("doc_id", "total", "cluster_id"), F.lit(shards)).cast("int"))
    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "size": pa.int64(), "bin_id": pa.int64(), "bin_offset": pa.int64(), "source": pa.string(), "cluster_id": pa.int64()}
    target = pa.schema(list(names.items()))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("total", "descending"), ("doc_id", "ascending"), ("cluster_id", "ascending"), ("source", "ascending")])
        shard = table.column("shard")[0].as_py()
        ids, totals, sources, clusters = (table.column(c).to_pylist() for c in ("doc_id", "total", "source", "cluster_id"))
        rests = [t % capacity if t and t % capacity else min(t, capacity) for t in totals]
        placed = pack(rests, sources, clusters, capacity, per_source)
        next_bin = max((b for b, _ in placed), default=-1) + 1
        rows = []
        for i, total in enumerate(totals):
            full = (total - rests[i]) // capacity
            for p in range(full):
                rows.append((ids[i], p, p * capacity, capacity, shard << 32 | next_bin, 0, sources[i], clusters[i]))
                next_bin += 1
            b, at = placed[i]
            rows.append((ids[i], full, full * capacity, rests[i], shard << 32 | b, at, sources[i], clusters[i]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return held.groupBy("shard").applyInArrow(run, schema(doc_id="long", piece="int", start="long", size="long", bin_id="long", bin_offset="long", source="string", cluster_id="long"))
