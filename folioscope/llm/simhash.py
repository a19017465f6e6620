"""SimHash near-duplicates: fingerprints joined through a Gray-order hierarchical index.

The join finds every pair of fingerprints at ``max_bits`` or fewer differing bits. A pair that close agrees on at least one
of ``max_bits + 1`` blocks of bits, so each distinct fingerprint goes to one bucket per block. A task sorts its buckets by
Gray rank (neighbours in that order share long bit patterns), builds a tree over the order in which each node keeps the bits
its members share and its parent does not, and walks all members down the tree together: differences add up from node to
node, and a whole group is left as soon as they exceed the limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, id_and_text, schema
from .graph import components

FANOUT = 8
FRONTIER = 1 << 19


def shingle_hashes(text: str, shingle_words: int = 4) -> np.ndarray:
    """XXH64 values (seed 42) of the word shingles, repeated ones too; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = len(words) - k + 1, xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)


def simhash_of(hashes: np.ndarray) -> int:
    """64-bit fingerprint: bit i is set if it is set in over half of the values; 0 if there are none."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        block = hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * ones > n)[0].tolist())


def simhash(text: str, shingle_words: int = 4) -> int:
    """64-bit fingerprint of the word shingles."""
    return simhash_of(shingle_hashes(text, shingle_words))


def _fingerprint_batches(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t.as_py(), shingle_words) for t in batch.column("text")], np.uint64)
            rest = [n for n in batch.schema.names if n not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64)), *map(batch.column, rest)], ["doc_id", "fp", *rest])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``(doc_id, fp)`` for every row, the 64 bits held in a signed long, and the columns ``carry`` (name: what of the row)."""
    held = id_and_text(docs, id_col, text_col, carry)
    rest = [f for f in held.schema.fields if f.name not in ("doc_id", "text")]
    return held.mapInArrow(_fingerprint_batches(shingle_words), T.StructType([*schema(doc_id="long", fp="long").fields, *rest]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order: the running exclusive-or from the top bit down."""
    ranks = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return ranks


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of a[i] and b[i]; a label is the smallest position of its class."""
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


class GrayTree:
    """The hierarchical index over codes that are already grouped by bucket and in Gray order within a bucket."""

    def __init__(self, codes: np.ndarray, bucket: np.ndarray):
        n = len(codes)
        self.codes = codes
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        number = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1
        within = np.arange(n) - first[number]
        self.levels = []  # from the leaves up: (start, end, pattern, mask, parent)
        span = FANOUT
        widest = int(within.max()) + 1
        while True:
            new = np.r_[True, (number[1:] != number[:-1]) | (within[1:] // span != within[:-1] // span)]
            start = np.flatnonzero(new)
            ones, any_ = np.bitwise_and.reduceat(codes, start), np.bitwise_or.reduceat(codes, start)
            self.levels.append([start, np.r_[start[1:], n], ones, ones | ~any_, np.cumsum(new) - 1])
            if span >= widest:
                break
            span *= FANOUT
        for low, high in zip(self.levels, self.levels[1:]):
            parent = high[4][low[0]]
            low[3] = (low[3], low[3] & ~high[3][parent])  # all shared bits; those that the parent does not share
            low.append(parent)
        top = self.levels[-1]
        top[3] = (top[3], top[3])
        self.child_start = [None] + [np.searchsorted(low[0], high[0]) for low, high in zip(self.levels, self.levels[1:])]
        self.child_end = [None] + [np.r_[s[1:], len(low[0])] for s, low in zip(self.child_start[1:], self.levels)]

    def classes(self, limit: int) -> np.ndarray:
        """The class of every position under links of at most ``limit`` bits within its bucket (smallest position names it)."""
        codes, n = self.codes, len(self.codes)
        labels = np.arange(n)
        root = self.levels[-1][4]
        near = np.flatnonzero((np.bitwise_count(codes[1:] ^ codes[:-1]) <= limit) & (root[1:] == root[:-1]))
        _join_labels(labels, near, near + 1)
        whole = self._whole(labels)
        top = len(self.levels) - 1
        stack = [(top, np.arange(n)[::-1].copy(), root[::-1].copy(), np.zeros(n, np.uint8))]
        while stack:
            level, q, node, seen = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], seen[:half]), (level, q[half:], node[half:], seen[half:])]
                continue
            start, end, pattern, (mask, own), _ = self.levels[level][:5]
            low, high = whole[level]
            keep = (end[node] > q + 1) & ~((low[node] == high[node]) & (low[node] == labels[q]))
            q, node, seen = q[keep], node[keep], seen[keep]
            seen = seen + np.bitwise_count((codes[q] ^ pattern[node]) & own[node])
            keep = seen <= limit
            q, node, seen = q[keep], node[keep], seen[keep]
            if not len(q):
                continue
            a, b = (start[node], end[node]) if level == 0 else (self.child_start[level][node], self.child_end[level][node])
            size = b - a
            at = np.repeat(np.arange(len(q)), size)
            to = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + a[at]
            if level:
                stack.append((level - 1, q[at], to, seen[at]))
                continue
            q, parent, seen = q[at], node[at], seen[at]
            linked = (to > q) & (seen + np.bitwise_count((codes[q] ^ codes[to]) & ~mask[parent]) <= limit)
            linked[linked] = labels[q[linked]] != labels[to[linked]]
            if linked.any():
                _join_labels(labels, q[linked], to[linked])
                whole = self._whole(labels)
        return labels

    def _whole(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Lowest and highest label in every node: a node of one class needs no second visit from that class."""
        low, high = np.minimum.reduceat(labels, self.levels[0][0]), np.maximum.reduceat(labels, self.levels[0][0])
        found = [(low, high)]
        for starts in self.child_start[1:]:
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            found.append((low, high))
        return found


def link_buckets(block: np.ndarray, value: np.ndarray, prints: np.ndarray, shift: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of positions in ``prints``, of the links inside each bucket (block, value).

    ``shift`` says by how many bits a fingerprint is rotated so that the bits of its block lead: members of a bucket then
    stand together in Gray order.
    """
    s = shift.astype(np.uint64)
    turned = (prints << s) | (prints >> ((np.uint64(64) - s) & np.uint64(63)))
    turned = np.where(s == 0, prints, turned)
    order = np.lexsort((gray_rank(turned), value, block))
    bucket = (block[order].astype(np.int64) << 32) | value[order]
    size = np.unique(bucket, return_counts=True)[1]
    several = np.repeat(size > 1, size)
    order, bucket = order[several], bucket[several]
    if not len(order):
        return order, order
    labels = GrayTree(turned[order], bucket).classes(limit)
    linked = labels != np.arange(len(labels))
    return order[linked], order[labels[linked]]


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(rotation, width) of each of max_bits + 1 blocks, widths as even as 64 bits allow."""
    n, at, found = max_bits + 1, 0, []
    for i in range(n):
        width = (64 + i) // n
        found.append((at, width))
        at += width
    return found


def link_fingerprints(distinct: DataFrame, max_bits: int = 4, bucket_rows: int = 200_000) -> DataFrame:
    """``(a, b)``: links among documents ``rep`` of distinct fingerprints ``fp``, which join the same ones as all pairs within
    ``max_bits`` would.

    A bucket with over ``bucket_rows`` members is cut into chunks by hash, and each pair of chunks meets in a task of its own,
    so that no task holds more than two chunks; nothing is dropped.
    """
    blocks = _blocks(max_bits)
    keyed = F.explode(
        F.array(
            *(
                F.struct(F.lit(i).alias("block"), F.lit(at).alias("shift"), F.shiftrightunsigned(F.shiftleft("fp", at), 64 - width).alias("value"))
                for i, (at, width) in enumerate(blocks)
            )
        )
    )
    rows = distinct.select("fp", "rep", keyed.alias("k")).select("fp", "rep", "k.block", "k.shift", "k.value")
    chunks = F.ceil(F.col("count") / bucket_rows)
    sizes = rows.groupBy("block", "value").count().agg(F.max("count"), F.sum(F.col("count") * chunks)).first()
    largest, replicas = sizes[0] or 0, sizes[1] or 0
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(replicas) // (2 * bucket_rows))
    if largest > bucket_rows:
        counts = rows.groupBy("block", "value").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("chunks"))
        rows = rows.join(counts, ["block", "value"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        rows = rows.select("*", other.alias("other")).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    else:
        rows = rows.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"))
    rows = rows.select("fp", "rep", "block", "shift", "value", "low", "high").repartition(tasks, "block", "value", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = lambda name: t.column(name).to_numpy()
        task = np.unique(np.stack([col("low"), col("high")]), axis=1, return_inverse=True)[1].ravel()
        value = col("value") + (task.astype(np.int64) << 16)
        a, b = link_buckets(col("block"), value, col("fp").astype(np.int64).view(np.uint64), col("shift"), max_bits)
        rep = col("rep")
        yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_bits: int = 4, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (64 bits in a signed long), component_id, and the columns ``carry`` of the row.

    component_id is the smallest document id that links of at most ``max_bits`` differing bits reach. Equal fingerprints are
    joined before any comparison, so copies cost one row. A null text is empty; texts without words have fingerprint 0 and are
    linked like any other. Rows with a null id take no part in links and have no component. Repeated rows are returned as often
    as given; an empty table gives no rows; other columns are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words, carry))
    distinct = cut(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(link_fingerprints(distinct, max_bits))  # by first document: a root is its component's smallest id
    classes = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    found = prints.join(classes, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *(carry or ()))
