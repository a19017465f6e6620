"""N-gram Jaccard join by a partitioned universe and the pigeonhole principle.

Two shingle sets with a similarity of NUM / DEN or more differ in few shingles: at most a quarter of the smaller one. Sets are
put into bands by size. For each band the universe of shingles is hashed into a few more segments than there can be differences,
so two similar sets hold the same shingles in one segment at least. The set of a segment is a key; a set has the keys of its own
band, and of the band below as the larger side of a pair. A segment may count

* once: sets meet if their shingles in it are equal;
* twice: they also meet if one shingle more makes the difference (each set adds the keys with one of its shingles deleted);
* not at all.

A set is sure to meet what is similar to it if its segments that hold something count over the band's largest difference. What a
segment counts is allocated by cost: a sample says which segments bring many unlike sets together (those of a licence line, say);
they are left out and cheap ones count twice instead. The few sets that fall short are hashed anew, up to twice, and beyond that
meet by empty segments too, so no pair is missed whatever the sample said.

Keys travel packed by bucket; a bucket with too many is cut into slices, and each pair of slices is a task. What meets is then
compared by parities of the shingle counts, which rule out most unlike pairs without the sets, and the rest exactly. Equal sets
are one node from the start. First every set meets a few pivots of each key, so a large group of copies is joined by stars; then
sets that are still apart meet all others of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, id_and_text, in_share, schema
from .graph import components
from .jaccard import DEN, NUM, PAIR_BLOCK, PIVOTS, Parities, parity, similar, with_ids
from .repeats import mix
from .simhash import shingle_hashes

#: Sets of the sample that costs are taken from, and at most how many costly segments are told to the tasks.
SAMPLE_SETS, TOLD = 20_000, 20_000
#: Keys of a bucket or slice, about.
BUCKET_KEYS = 1 << 19
#: Shingles whose keys are computed together.
FLUSH = 1 << 19
#: Members of a key that meet in one task; of more, each pair of chunks is a task.
CHUNK = 4096
#: How often a set is hashed before it meets by empty segments too.
TRIES = 3
DELETED, PROBE = 1 << 30, 1 << 31


def bands(largest: int) -> np.ndarray:
    """The largest size of each band: a set and the smallest that is similar to it are in the same or in neighbouring bands."""
    found = [0, 1]
    while found[-1] < largest:
        found.append(max(found[-1] + 1, found[-1] * DEN // NUM))
    return np.array(found, np.int64)


def segments(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each band: the most shingles by which a set of it and a similar one, not smaller, can differ; and how many segments
    there are, a few more than that, since some are empty."""
    most = high * (DEN - NUM) // NUM
    return most, np.where(most > 0, most + 1 + -(-3 * (most + 1) // 20), 1)


@dataclass
class Allocation:
    """What segments count, as band << 32 | segment: those left out and those that count twice; all others count once."""

    none: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    twice: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def _salt(band: np.ndarray, segment: np.ndarray, attempt: int) -> np.ndarray:
    return mix((band.astype(np.uint64) << np.uint64(40)) ^ segment.astype(np.uint64) ^ np.uint64((attempt + 1) << 56))


def keys_of(shingles: np.ndarray, owner: np.ndarray, band: np.ndarray, attempt: int, allocation: Allocation) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, key, deleted, short)`` of sets in ``band`` (one an owner): their keys, which are of one-deletion neighbours, and
    for each owner whether its segments don't count enough."""
    most, count = segments(bands(1 << 40)[: int(band.max(initial=0)) + 1])
    segment = (mix(shingles + np.uint64(0x9E3779B97F4A7C15 * (attempt + 1) & (1 << 64) - 1)) % count[band[owner]].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((segment, owner))
    owner, segment, value = owner[order], segment[order], mix(shingles[order])
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])]) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(owner)])
    who, where = owner[first], segment[first]
    total = (np.add.reduceat(value, first) if len(first) else value) + _salt(band[who], where, attempt)
    code = band[who] << 32 | where
    counts = np.ones(len(first), np.int64)
    if attempt == 0:
        counts[np.isin(code, allocation.none)] = 0
        counts[np.isin(code, allocation.twice)] = 2
    score = np.bincount(who, np.minimum(counts, np.maximum(1, size)), len(band))
    used = counts > 0
    each = np.repeat(np.arange(len(first)), size)
    gone = (counts[each] == 2) & (size[each] > 1)
    owners, keys = [who[used], who[each[gone]]], [total[used], total[each[gone]] - value[gone]]
    if attempt == TRIES:  # empty segments too
        every = np.repeat(np.arange(len(band)), count[band])
        at = np.arange(len(every)) - np.repeat(np.cumsum(count[band]) - count[band], count[band])
        empty = ~np.isin(every << 32 | at, who << 32 | where)
        owners.insert(1, every[empty])
        keys.insert(1, _salt(band[every[empty]], at[empty], attempt))
    deleted = np.r_[np.zeros(sum(map(len, keys[:-1])), bool), np.ones(len(keys[-1]), bool)]
    return np.concatenate(owners), np.concatenate(keys), deleted, score <= most[band]


def all_keys(sets: list[np.ndarray], allocation: Allocation) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(position, key, flags)`` of all keys of the sets, none of them empty: of their own band and, as the larger side (PROBE), of
    the band below where that can hold a similar set."""
    n = np.array([len(s) for s in sets], np.int64)
    high = bands(int(n.max()))
    own = np.searchsorted(high, n)
    below = high[own - 1] >= -(-n * NUM // DEN)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for band, wanted, flag in ((own, np.arange(len(n)), 0), (own - 1, np.flatnonzero(below), PROBE)):
        for attempt in range(TRIES + 1):
            if not len(wanted):
                break
            owner = np.repeat(np.arange(len(wanted)), n[wanted])
            who, key, deleted, short = keys_of(np.concatenate([sets[i] for i in wanted.tolist()]), owner, band[wanted], attempt, allocation)
            out.append((wanted[who], key, flag | np.where(deleted, DELETED, 0)))
            wanted = wanted[short]
    return tuple(np.concatenate(x) for x in zip(*out))


def _sets_in_turn(batches: Iterator[pa.RecordBatch], shingle_words: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets of about FLUSH shingles at a time; empty sets are left out."""
    ids, sets, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            own = np.unique(shingle_hashes(text.as_py(), shingle_words))
            if len(own):
                ids.append(i)
                sets.append(own)
                size += len(own)
            if size >= FLUSH:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _prints(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``(doc_id, n, key, bits)`` of each row: size, 128-bit hash and parities of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle_words)) for t in batch.column("text")]
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "key", "bits"])

    return docs.mapInArrow(run, schema(doc_id="long", n="long", key="binary", bits="binary"))


def allocate(docs: DataFrame, n_sets: int, shingle_words: int, sample: int = SAMPLE_SETS) -> Allocation:
    """Costs of segments in a sample of sets, carried on to all: where the pairs that a segment is expected to bring together
    outnumber the keys that another one needs to count twice, it is left out and the cheapest of its band counts twice."""
    share = min(1.0, sample / max(1, n_sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_in_turn(batches, shingle_words):
            n = np.array([len(s) for s in sets])
            band = np.searchsorted(bands(int(n.max())), n)
            count = segments(bands(int(n.max())))[1]
            owner = np.repeat(np.arange(len(n)), n)
            flat = np.concatenate(sets)
            segment = (mix(flat + np.uint64(0x9E3779B97F4A7C15)) % count[band[owner]].astype(np.uint64)).astype(np.int64)
            code = np.unique(np.stack([owner, segment]), axis=1)
            where = band[code[0]] << 32 | code[1]
            who, key, _, _ = keys_of(flat, owner, band, 0, Allocation())
            order = np.argsort(who, kind="stable")  # keys of an owner come by segment, as the codes do
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(key[order].view(np.int64))], ["code", "key"])

    held = docs.where(in_share(share, "doc_id")).mapInArrow(run, "code long, key long")
    met = held.groupBy("code", "key").count().where("count > 1").groupBy("code").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs"))
    costly = met.orderBy(F.desc("pairs"), "code").limit(TOLD).collect()
    allocation: dict[int, tuple[list[int], list[int]]] = {}
    known = {r["code"]: float(r["pairs"]) for r in costly}
    high = bands(1 << 40)
    most, count = segments(high)
    for code, pairs in known.items():
        band = code >> 32
        if band < len(high) and pairs / share**2 > 8 * n_sets and count[band] > 1:
            none, twice = allocation.setdefault(band, ([], []))
            free = (band << 32 | s for s in range(int(count[band])))
            taken = set(twice)
            other = next((c for c in free if c not in known and c not in taken), None)
            if other is not None:
                none.append(code)
                twice.append(other)
    pick = lambda i: np.array(sorted(c for pair in allocation.values() for c in pair[i]), np.int64)
    return Allocation(pick(0), pick(1))


def _narrow(values: np.ndarray) -> bytes:
    """Long integers as the least of them, a byte that says how wide the differences to it are, and these."""
    least = int(values.min())
    rest = (values - least).astype(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(rest.max()) < 1 << 8 * w)
    return least.to_bytes(8, "little", signed=True) + bytes([width]) + rest.astype(f"<u{width}").tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[8]}", offset=9).astype(np.int64) + int.from_bytes(packed[:8], "little", signed=True)


def _packed_keys(docs: DataFrame, buckets: int, shingle_words: int, allocation: Allocation) -> DataFrame:
    """``(bucket, turn, rows, keys, flags, ids, sizes)``: keys with the ids and sizes of their sets, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 24
        for ids, sets in _sets_in_turn(batches, shingle_words):
            at, key, flags = all_keys(sets, allocation)
            bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, bucket))
            bucket, at = bucket[order], at[order]
            low = (key[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
            who = np.array(ids, np.int64)[at]
            size, flag = np.array([len(s) for s in sets], np.int64)[at], (flags[order] >> 30).astype("u1")
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            last = np.r_[first[1:], len(bucket)]
            cuts = lambda x: [x[a:b] for a, b in zip(first.tolist(), last.tolist())]  # noqa: B023, E731
            packed = [pa.array([x.tobytes() for x in cuts(v)], pa.binary()) for v in (low, flag)] + [pa.array([_narrow(x) for x in cuts(v)], pa.binary()) for v in (who, size)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([turn] * len(first), pa.int64()), pa.array(last - first), *packed], ["bucket", "turn", "rows", "keys", "flags", "ids", "sizes"])
            turn += 1

    return docs.mapInArrow(run, schema(bucket="long", turn="long", rows="long", keys="binary", flags="binary", ids="binary", sizes="binary"))


def _met(packed: DataFrame) -> DataFrame:
    """``(k, doc_id, size)`` of the keys that several documents have. A bucket of over twice BUCKET_KEYS is cut into slices."""
    totals = packed.groupBy("bucket").agg(F.sum("rows").alias("total")).where(F.col("total") > 2 * BUCKET_KEYS)
    totals = cut(totals.select("bucket", F.ceil(F.col("total") / BUCKET_KEYS).cast("int").alias("slices")))
    sliced = totals.first() is not None
    rows = packed.join(totals, "bucket", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("turn"), F.col("slices")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = rows.select("bucket", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "keys", "flags", "ids", "sizes")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        whole = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        wide = lambda name: np.concatenate([_wide(x) for x in table.column(name).to_pylist()])
        low, who, size = whole("keys", "<u4"), wide("ids"), wide("sizes") | whole("flags", "u1").astype(np.int64) << 30
        order = np.argsort(low, kind="stable")
        low, who, size = low[order], who[order], size[order]
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        differ = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        together = np.bitwise_and.reduceat(size, first) & PROBE == 0  # not only sets that probe
        keep = np.repeat(differ & together, np.diff(np.r_[first, len(low)]))
        k = (key[0].as_py() << 32) | low[keep].astype(np.int64)
        return pa.table({"k": pa.array(k), "doc_id": pa.array(who[keep]), "size": pa.array(size[keep])})

    found = rows.groupBy("bucket", "low", "high").applyInArrow(meet, "k long, doc_id long, size long")
    return found.distinct() if sliced else found


def _in_chunks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``low`` and ``high``: what meets in one task of a key, which has at most two chunks of about CHUNK members."""
    counts = cut(rows.groupBy("k").count().where(F.col("count") > CHUNK).select("k", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    if counts.first() is None:
        return rows.select("*", F.lit(0).alias("low"), F.lit(0).alias("high"))
    rows = rows.join(counts, "k", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("*", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of (k, low, high), from batches sorted by these: one batch and one group are held at most."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.stack([batch.column(c).to_numpy() for c in ("k", "low", "high")])
        last = int(np.argmax((code == code[:, -1:]).all(axis=0)))
        if rest and (last or (rest[0].column("k")[0], rest[0].column("low")[0], rest[0].column("high")[0]) != (batch.column("k")[0], batch.column("low")[0], batch.column("high")[0])):
            yield pa.Table.from_batches([*rest, batch.slice(0, last)])
            rest = [batch.slice(last)]
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
            rest = [batch.slice(last)]
        else:
            rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest)


def _pairs(rows: DataFrame, pivots: int | None) -> DataFrame:
    """``(a, b)``: documents of different classes (``root``) that share a key and that size and parities don't rule out. With
    ``pivots``, one of the two is among the first so many of the key, in one order of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            col = lambda name: table.column(name).to_numpy()  # noqa: E731, B023
            k, doc, size, root, low, high = (col(c) for c in ("k", "doc_id", "size", "root", "low", "high"))
            group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]) - 1
            order = np.lexsort((mix(doc.astype(np.uint64)), group))
            group, doc, size, root = group[order], doc[order], size[order], root[order]
            bits = Parities(table.column("bits").combine_chunks(), order)
            n, flags = size & (DELETED - 1), size & (DELETED | PROBE)
            later = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
            if pivots is not None:
                later[np.arange(len(group)) - np.searchsorted(group, group) >= pivots] = 0
            start = np.r_[0, np.cumsum(later)]
            for begin in range(0, int(start[-1]), PAIR_BLOCK):
                x = np.arange(begin, min(begin + PAIR_BLOCK, int(start[-1])))
                i = np.searchsorted(start, x, side="right") - 1
                j = i + 1 + x - start[i]
                ok = (root[i] != root[j]) & (flags[i] & flags[j] == 0) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
                pairs = np.unique(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), np.arange(len(i))])[:, ok], axis=1) if ok.any() else np.zeros((3, 0), np.int64)
                fresh = np.r_[True, (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)] if pairs.shape[1] else np.zeros(0, bool)
                pairs = pairs[:, fresh]
                i, j = i[pairs[2]], j[pairs[2]]
                pairs = pairs[:2, bits.may_share(i, j, n[i] + n[j])]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    rows = rows.repartition("k", "low", "high").sortWithinPartitions("k", "low", "high")
    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicate_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles (the size of its set of distinct shingles) and component_id, the
    smallest document id that links reach: two documents link if their sets have a Jaccard similarity of 4/5 or more.

    Letters A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than a shingle is one shingle; a null or
    blank text has an empty set and links with nothing. Rows that share an id are one document: links of any of them count.
    Rows without an id have no component and take no part. Repeated rows are returned as given; an empty table gives no rows;
    other columns are not read. Shingles are compared by 64-bit hashes, sets by 128 bits.
    """
    docs = id_and_text(docs, id_col, text_col)
    prints = cut(_prints(docs, shingle_words))
    full = prints.where("n > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits")))
    total = classes.agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")).first()
    several = full.groupBy("doc_id").agg(F.count_distinct("key", "n").alias("texts")).where("texts > 1").select("doc_id")
    same = full.join(several, "doc_id").join(classes, ["key", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = cut(same.where("a <> b").distinct())

    named = with_ids(docs.where("doc_id IS NOT NULL"), classes.select(F.col("rep").alias("doc_id")).distinct(), "left_semi")
    buckets = max(1, int(total["shingles"] or 0) * 6 // 10 // BUCKET_KEYS)
    path = fresh_path(docs.sparkSession, "keys")
    _packed_keys(named, buckets, shingle_words, allocate(named, total["sets"], shingle_words)).write.parquet(path)
    met = cut(_met(docs.sparkSession.read.parquet(path)))
    bits = classes.select(F.col("rep").alias("doc_id"), "n", "bits")
    rows = met.withColumn("n", F.col("size").bitwiseAND(DELETED - 1)).join(bits.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_semi")
    for pivots in (PIVOTS, None):
        roots = cut(components(links)) if links.first() is not None else None
        own = F.col("doc_id")
        labelled = rows.withColumn("root", own) if roots is None else rows.join(roots, own == roots["node"], "left").select(*rows.columns, F.coalesce("root", own).alias("root"))
        if pivots is None:  # keys whose members are all of one class are done
            open_keys = labelled.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("k")
            labelled = labelled.join(open_keys, "k", "left_semi")
        met_again = _in_chunks(cut(labelled)).join(bits, ["doc_id", "n"]).select("k", "low", "high", "doc_id", "size", "root", "bits")
        found = similar(named, _pairs(met_again, pivots), shingle_words)
        links = cut(links.unionByName(found).distinct())
    roots = components(links)
    named_classes = classes.join(roots, classes["rep"] == roots["node"], "left").select("key", "n", F.coalesce("root", "rep").alias("component_id"))
    left = prints.join(named_classes, ["key", "n"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return left.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
