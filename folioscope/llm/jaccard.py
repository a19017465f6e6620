"""Near-duplicates by the exact Jaccard similarity of word shingles.

A pair at 4/5 or more shares a shingle among the first ``n - ceil(4n/5) + 1`` of each document in any one order of all
shingles (prefix filter), so no such pair is missed. Shingles that are common in a sample of documents come last in that
order: this changes how many pairs meet, never which ones are found. Before the join, groups of equal shingle sets and links
between close SimHash fingerprints are collapsed; then every document meets only a few pivots of each shingle's documents, and
those similar to one go. So a large group of copies is not compared pair by pair: the full join is left with documents of which
few are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, id_and_text
from .graph import components
from .repeats import mix
from .simhash import link_fingerprints, shingle_hashes, simhash_of

#: The similarity, as numerator and denominator.
NUM, DEN = 4, 5
SAMPLE_DOCS = 20_000
COMMON = 5
#: A list of ids up to this length is sent to the tasks; a longer one is joined by a shuffle.
SENT_IDS = 2_000_000
PAIR_BLOCK = 1 << 20
#: Documents of a shingle that all others of it are compared with before the full join.
PIVOTS = 8


def _ordered(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles in the one order of all: common ones last, by value within."""
    late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), bool)
    return np.concatenate((shingles[~late], shingles[late]))


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each of n to 2n buckets (a power of two, 64 at least): whether it holds an odd number of the shingles."""
    width = max(64, 1 << (max(1, len(shingles)) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8).tobytes()


def _may_share(x: bytes, y: bytes, n: int) -> bool:
    """False only if sets with these parities and n members together can't reach the similarity.

    Buckets of different parity hold at least one member of only one set; a longer row of bits is folded to the shorter.
    """
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        short = min(len(a), len(b))
        a, b = (np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (a, b))
    apart = int(np.bitwise_count(a ^ b).sum())
    return (n - apart) * (NUM + DEN) >= 2 * NUM * n


class Parities:
    """The rows of bits of many documents (see ``parity``), for many pairs at once."""

    def __init__(self, bits: pa.BinaryArray, order: np.ndarray):
        ends = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        self.data = np.frombuffer(bits.buffers()[2], np.uint8)
        self.start, self.width = ends[:-1][order], np.diff(ends)[order]

    def _rows(self, at: np.ndarray, wide: int, to: int) -> np.ndarray:
        rows = self.data[self.start[at][:, None] + np.arange(wide)]
        return rows if wide == to else np.bitwise_xor.reduce(rows.reshape(len(at), wide // to, to), axis=1)

    def may_share(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """As ``_may_share``, for the pairs (i, j) with n members together."""
        ok = np.zeros(len(i), bool)
        widths = self.width[i] << 32 | self.width[j]
        for both in np.unique(widths).tolist():
            a, b = both >> 32, both & 0xFFFFFFFF
            mine, narrow = np.flatnonzero(widths == both), min(a, b)
            step = max(1, (1 << 23) // max(a, b))
            for k in range(0, len(mine), step):
                x = mine[k : k + step]
                apart = np.bitwise_count(self._rows(i[x], a, narrow) ^ self._rows(j[x], b, narrow)).sum(axis=1, dtype=np.int64)
                ok[x] = (n[x] - apart) * (NUM + DEN) >= 2 * NUM * n[x]
        return ok


def _prints(docs: DataFrame, shingle_words: int, common: np.ndarray) -> DataFrame:
    """``(doc_id, fp, key, n, prefix, bits)``: fingerprint, hash and size of the shingle set, its prefix and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, size, prefix, bits = [], [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_hashes(text.as_py(), shingle_words)
                own = np.unique(hashes)
                n = len(own)
                fp.append(simhash_of(hashes))
                key.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                size.append(n)
                bits.append(parity(own))
                prefix.append(_ordered(own, common)[: n - -(-NUM * n // DEN) + 1 if n else 0].view(np.int64))
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(fp), signed(key), pa.array(size, pa.int64()), lists, pa.array(bits, pa.binary())], ["doc_id", "fp", "key", "n", "prefix", "bits"])

    return docs.mapInArrow(run, "doc_id long, fp long, key long, n long, prefix array<long>, bits binary")


def _common(docs: DataFrame, shingle_words: int) -> np.ndarray:
    """Shingles of COMMON or more documents of a sample; only the order depends on them."""
    every = max(1, docs.count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text.as_py(), shingle_words)).view(np.int64))], ["s"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    found = sample.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= COMMON).select("s").collect()
    return np.sort(np.array([r.s for r in found], np.int64).view(np.uint64))


def _by_shingle(rows: DataFrame) -> DataFrame:
    """In the session's number of partitions: the planner's size estimate of a join says nothing."""
    return rows.repartition("s")


def _shared(rows: DataFrame) -> DataFrame:
    """``(doc_id, n, at, s)``: the shingles of prefixes that another document's prefix holds too, and where in the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        _, which, count = np.unique(t.column("s").to_numpy(), return_inverse=True, return_counts=True)
        yield from t.filter(pa.array(count[which] > 1)).to_batches()

    flat = rows.select("doc_id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "s"))
    return _by_shingle(flat).mapInArrow(run, "doc_id long, n int, at int, s long")


def _candidates(shared: DataFrame, pivots: int | None = None) -> DataFrame:
    """``(a, b)`` with a < b: documents that share a shingle of both prefixes and may, by size and position, be similar enough.

    With ``pivots``, only pairs with one of the first so many documents of the shingle, in one order of all documents by hash
    (so related shingles have the same ones). Where ``shared`` has the documents' parities (``bits``), pairs that these rule out
    are left where they meet.
    """
    parities = "bits" in shared.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        s, doc, n, at = (t.column(c).to_numpy().astype(np.int64) for c in ("s", "doc_id", "n", "at"))
        order = np.lexsort((mix(doc.astype(np.uint64)), s))
        s, doc, n, at = s[order], doc[order], n[order], at[order]
        bits = Parities(t.column("bits").combine_chunks(), order) if parities else None
        if not len(s):
            return
        last = np.searchsorted(s, s, side="right")
        later = last - np.arange(len(s)) - 1  # rows of the bucket after each one
        if pivots is not None:
            later[np.arange(len(s)) - np.searchsorted(s, s) >= pivots] = 0
        start = np.r_[0, np.cumsum(later)]
        for low in range(0, int(start[-1]), PAIR_BLOCK):
            x = np.arange(low, min(low + PAIR_BLOCK, int(start[-1])))
            i = np.searchsorted(start, x, side="right") - 1
            j = i + 1 + x - start[i]
            overlap = np.minimum(at[i], at[j]) + np.minimum(n[i] - at[i], n[j] - at[j])
            ok = np.flatnonzero((overlap * (NUM + DEN) >= NUM * (n[i] + n[j])) & (doc[i] != doc[j]))
            if bits is not None:
                ok = ok[bits.may_share(i[ok], j[ok], (n[i] + n[j])[ok])]
            pairs = np.stack([np.minimum(doc[i[ok]], doc[j[ok]]), np.maximum(doc[i[ok]], doc[j[ok]])])
            order = np.lexsort(pairs)
            pairs = pairs[:, order]
            pairs = pairs[:, np.r_[True, (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)]] if len(order) else pairs
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return _by_shingle(shared).mapInArrow(run, "a long, b long").distinct()


def with_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` joined (left_semi, left_anti) with the few or many ids ``doc_id``."""
    path = fresh_path(docs.sparkSession, "ids")
    ids.write.parquet(path)
    ids = docs.sparkSession.read.parquet(path)
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", how)


def _possible(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that their parities don't rule out."""
    of = lambda x: rows.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_pylist()
            ok = [_may_share(x, y, k) for x, y, k in zip(batch.column("bitsa").to_pylist(), batch.column("bitsb").to_pylist(), n)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "bitsa", "bitsb", (F.col("na") + F.col("nb")).alias("n"))
    return both.mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, pairs: DataFrame, shingle_words: int) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets have a Jaccard similarity of NUM / DEN or more, checked exactly."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = cut(with_ids(docs, wanted, "left_semi"))
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x, y = (np.unique(shingle_hashes(t.as_py(), shingle_words)) for t in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def surplus(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """``doc_id`` of the documents to drop. ``docs`` holds each id once and none is null; an empty table drops none.

    No two of the documents that stay have a similarity of 4/5 or more; each that goes is joined to a staying one with a
    smaller id by a chain of pairs that have. A null text is empty; texts without words equal one another; a text of fewer
    words than a shingle is one shingle.
    """
    docs = id_and_text(docs, "doc_id", "text")
    prints = cut(_prints(docs, shingle_words, _common(docs, shingle_words)))
    left = cut(prints.groupBy("key", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    rows = lambda table, *columns: with_ids(table.select("doc_id", *columns), left, "left_semi")

    def without_similar(pairs: DataFrame) -> DataFrame:
        found = components(similar(docs, _possible(prints, pairs), shingle_words)).where("node <> root").select(F.col("node").alias("doc_id"))
        return cut(left.join(found, "doc_id", "left_anti"))

    left = without_similar(_close(rows(prints, "fp")))
    shared = cut(_shared(rows(prints, "n", "prefix")))
    left = without_similar(_candidates(rows(shared, "n", "at", "s"), PIVOTS))
    with_bits = rows(shared, "n", "at", "s").join(rows(prints, "bits"), "doc_id")
    left = without_similar(_candidates(with_bits))
    return prints.select("doc_id").join(left, "doc_id", "left_anti")


def _close(rows: DataFrame) -> DataFrame:
    """``(a, b)``: links between documents whose fingerprints are equal or differ in few bits."""
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    equal = rows.join(distinct, "fp").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    return equal.unionByName(link_fingerprints(distinct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
