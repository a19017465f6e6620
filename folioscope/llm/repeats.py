"""Repeated stretches across a corpus: the distributed frame of suffix-array and seed-and-extend deduplication.

A *unit* is a byte or a word; a *window* is ``length`` consecutive units of one document. A window is repeated if the same
window starts earlier in reading order (documents by id, then by start). Each window contains its *anchor*: of its k-unit
grams, the one with the lowest hash, the leftmost of equals. Equal windows have equal anchors, so:

1. every part of the corpus (documents dealt out by a hash of id and text) names its distinct anchors, packed into one row
   per bucket of the hash, so no key is heavier than another;
2. a bucket answers each part with those of its anchors that occur elsewhere or twice;
3. a part cuts out the stretch around each such anchor (the run of windows that share it), and the kind's ``resolve`` (suffix
   sorting, or seed and extend) finds the windows that an earlier stretch of the part holds: these are repeated. What is left
   of each stretch, the windows that are new in the part, travels on, so a passage leaves a part once however often it is there;
4. stretches meet by anchor, and ``resolve`` finds the repeated windows among them. An anchor with over ``hot`` occurrences is
   split: a few neighbouring windows travel together under a hash of what all of them hold, and with over 64 times as many each
   window under its own hash, so that one passage's many contexts do not meet in one task;
5. repeated windows, merged to spans, go back to the parts.

The documents are shuffled once; steps 1, 3 and 5 read the same exchange. Parts, buckets and the slots in which stretches meet
are groups of a size that does not depend on the corpus: there are more of them the larger it is, Spark sorts them in its
partitions and hands them to Python one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import NULL_ID, id_key, part_count, schema

#: Units whose window minima are taken together: positions must fit POS_BITS.
BLOCK_UNITS = 1 << 20
POS_BITS = np.uint64(24)
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass
class Text:
    """Units of one document: ``codes`` for hashing, and where unit i lies in ``data``."""

    data: bytes
    codes: np.ndarray
    start: np.ndarray | None = None  # None: unit i is byte i
    end: np.ndarray | None = None

    def cut(self, a: int, b: int) -> bytes:
        return self.data[a:b] if self.start is None else self.data[self.start[a] : self.end[b - 1]]


@dataclass(frozen=True)
class Kind:
    """What a window is made of, and how stretches that share an anchor are compared."""

    length: int
    gram: int
    read: Callable[[str], Text]
    again: Callable[[bytes], Text]  # what Text.cut gave, as a text
    grams: Callable[[np.ndarray, int], np.ndarray]  # codes, gram -> a hash for each gram
    resolve: Callable  # see resolve() in the modules that define kinds


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * C2
    return x ^ (x >> np.uint64(32))


def window_runs(codes: np.ndarray, lengths: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor position, anchor hash) of each run of windows that share an anchor; documents stand
    end to end in ``codes``, and no window crosses from one into the next."""
    none = np.zeros(0, np.int64)
    wide = kind.length - kind.gram + 1
    starts = np.cumsum(lengths) - lengths
    valid = np.maximum(lengths - kind.length + 1, 0)
    if not valid.any():
        return none, none, none, none.astype(np.uint64)
    hashes = kind.grams(codes, kind.gram)
    low = (hashes >> POS_BITS << POS_BITS) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    windows = np.repeat(starts - (np.cumsum(valid) - valid), valid) + np.arange(valid.sum())
    anchor = (low[windows] & ((np.uint64(1) << POS_BITS) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return windows[first], np.diff(np.r_[first, len(anchor)]), anchor[first], hashes[anchor[first]]


def _blocks(texts: list[Text]) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about BLOCK_UNITS units; a longer document is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t.codes) > BLOCK_UNITS:
            yield a, i
            a, size = i, 0
        size += len(t.codes)
    if a < len(texts):
        yield a, len(texts)


#: Longest stretch of one document whose windows are taken at once; longer documents are read in overlapping pieces.
LONGEST = 1 << 23


def _runs(texts: list[Text], kind: Kind) -> Iterator[tuple[int, int, int, int, int]]:
    """Arrays (document, first window, windows, anchor, hash) by block; a very long document comes in pieces that overlap by a
    window less one unit, so each window is in one piece."""
    for a, b in _blocks(texts):
        if b - a == 1 and len(texts[a].codes) > LONGEST:
            codes = texts[a].codes
            for at in range(0, len(codes) - kind.length + 1, LONGEST):
                piece = codes[at : at + LONGEST + kind.length - 1]
                first, n, anchor, h = window_runs(piece, np.array([len(piece)]), kind)
                yield np.full(len(first), a), first + at, n, anchor + at, h
            continue
        lengths = np.array([len(t.codes) for t in texts[a:b]], np.int64)
        first, n, anchor, h = window_runs(np.concatenate([t.codes for t in texts[a:b]]), lengths, kind)
        starts = np.cumsum(lengths) - lengths
        doc = np.searchsorted(starts + lengths, first, side="right")
        yield doc + a, first - starts[doc], n, anchor - starts[doc], h


def _documents(table: pa.Table) -> tuple[list[int], list[int], list[str]]:
    """Ids, hashes and texts of the distinct documents of a part in reading order."""
    rows = sorted(set(zip(table.column("__id").to_pylist(), table.column("__h").to_pylist(), table.column("__text").to_pylist())))
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


ANCHORS = schema(bucket="int", part="int", hashes="binary", counts="binary")
STRETCHES = schema(key="long", id="long", h="long", start="long", end="long", offset="int", bytes="binary")
SPANS = schema(part="int", id="long", h="long", start="long", end="long")


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema])


def _name_anchors(kind: Kind, buckets: int):
    form = _arrow(ANCHORS)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("__part")[0].as_py()
        texts = [kind.read(t) for t in _documents(table)[2]]
        found = [h for _, _, _, _, h in _runs(texts, kind)]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket = (hashes >> np.uint64(8)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        hashes, counts = hashes[order], np.minimum(counts[order], 65535).astype(np.uint16)
        b, at = np.unique(bucket[order], return_index=True)
        rows = [(int(x), part, hashes[i:j].tobytes(), counts[i:j].tobytes()) for x, i, j in zip(b, at, [*at[1:], len(hashes)])]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form) if rows else form.empty_table()

    return run


def _answer(hot: int):
    """For each part: its anchors of this bucket that occur twice or more, and (in counts) how frequent they are: 0, 1 or 2."""
    form = _arrow(ANCHORS)

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts).astype(np.float64))[inverse]
        out, at = [], 0
        for bucket, part, hashes in zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), parts):
            n = total[at : at + len(hashes)]
            at += len(hashes)
            again = n > 1
            if again.any():
                out.append((bucket, part, hashes[again].tobytes(), ((n[again] > hot).astype(np.uint8) + (n[again] > 64 * hot)).tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), form)], schema=form) if out else form.empty_table()

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that overlap or touch, joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Units of stretches that are resolved together; a larger group of one anchor is taken in pieces.
RESOLVE_UNITS = 1 << 20


def _runs_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past the last) of each run of consecutive numbers in an ascending array."""
    first = np.flatnonzero(np.r_[True, windows[1:] != windows[:-1] + 1]) if len(windows) else np.zeros(0, np.int64)
    return windows[first], windows[np.r_[first[1:], len(windows)] - 1] + 1 if len(windows) else first


def split_windows(kind: Kind, windows: np.ndarray, offset: np.ndarray, key: np.ndarray, cut: Callable[[int, int, int], bytes]) -> tuple[tuple, tuple]:
    """((stretch, first window, past the last) of each run of windows that no earlier stretch of the same anchor holds, the
    same of the runs that one does). Stretch i has windows[i] windows, ``offset[i]`` units before its anchor ``key[i]``, and
    stands before i + 1; ``cut(i, a, b)`` gives the units of its windows a to b.
    """
    n = len(windows)
    order = np.argsort(key, kind="stable")
    ends = np.flatnonzero(np.r_[key[order][1:] != key[order][:-1], True]) + 1 if n else np.zeros(0, np.int64)
    units = np.cumsum((windows + kind.length - 1)[order])
    at = np.concatenate([[0], np.cumsum(windows)])  # every window of every stretch has a number
    later = np.zeros(int(at[-1]), bool)

    def resolve(members: np.ndarray, kept: list[tuple[int, int, int]]) -> None:
        """Mark the windows of ``members`` that are also in ``kept`` or in an earlier member."""
        given = [cut(i, a, b) for i, a, b in kept] + [cut(i, 0, int(windows[i])) for i in members.tolist()]
        shift = np.array([offset[i] - a for i, a, _ in kept] + offset[members].tolist(), np.int64)
        keys = np.r_[np.array([key[i] for i, _, _ in kept], key.dtype), key[members]]
        which, window = kind.resolve(given, shift, keys, kind)
        mine = which >= len(kept)
        later[at[members[which[mine] - len(kept)]] + window[mine]] = True

    a = 0
    while a < n:
        room = (units[a - 1] if a else 0) + RESOLVE_UNITS
        fits = ends[(ends > a) & (units[ends - 1] <= room)]
        if len(fits):  # whole groups
            resolve(order[a : fits[-1]], [])
            a = int(fits[-1])
            continue
        end = int(ends[np.searchsorted(ends, a, side="right")])
        kept: list[tuple[int, int, int]] = []
        while a < end:  # a large group: what was new so far meets the next piece
            b = min(end, max(a + 1, int(np.searchsorted(units, (units[a - 1] if a else 0) + RESOLVE_UNITS, side="right"))))
            piece = order[a:b]
            resolve(piece, kept)
            for i in piece.tolist():
                kept += [(i, int(x), int(y)) for x, y in zip(*_runs_of(np.flatnonzero(~later[at[i] : at[i + 1]])))]
            a = b
    owner = np.repeat(np.arange(n), windows)
    within = np.arange(len(owner)) - np.repeat(at[:-1], windows)
    out = []
    for chosen in (~later, later):
        w, o = within[chosen], owner[chosen]
        first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1] + 1) | (o[1:] != o[:-1])]) if len(w) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(w)] - 1 if len(w) else first
        out.append((o[first], w[first], w[last] + 1 if len(w) else first))
    return out[0], out[1]


def _cut_stretches(kind: Kind):
    form = _arrow(STRETCHES)
    digest = xxhash.xxh64_intdigest
    tail = kind.length - 1

    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows or not answer.num_rows:
            return form.empty_table()
        ids, hs, raw = _documents(table)
        texts = [kind.read(t) for t in raw]
        again = np.concatenate([np.frombuffer(x, np.uint64) for x in answer.column("hashes").to_pylist()])
        frequent = np.concatenate([np.frombuffer(x, np.uint8) for x in answer.column("counts").to_pylist()])
        order = np.argsort(again)
        again, frequent = again[order], frequent[order]
        found = []
        for doc, first, n, anchor, h in _runs(texts, kind):
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            take = again[at] == h
            found.append((doc[take], first[take], n[take], anchor[take] - first[take], h[take], frequent[at[take]]))
        if not found or not sum(len(x[0]) for x in found):
            return form.empty_table()
        doc, first, windows, offset, key, many = (np.concatenate(x) for x in zip(*found))
        cut = lambda i, a, b: texts[doc[i]].cut(int(first[i]) + a, int(first[i]) + b + tail)
        new, old = split_windows(kind, windows, offset, key, cut)
        rows: list[tuple] = []
        key = key.view(np.int64)
        for i, a, b in zip(*(x.tolist() for x in new)):
            d, s = int(doc[i]), int(first[i])
            if not many[i]:
                rows.append((int(key[i]), ids[d], hs[d], s + a, s + b + tail, int(offset[i]) - a, cut(i, a, b)))
                continue
            step = max(1, kind.length // 6) if many[i] == 1 else 1
            w = a
            while w < b:  # windows by place relative to the anchor, in steps: all of a step hold the units from its last window's start to its first one's end
                low = int(offset[i]) - (int(offset[i]) - w) // step * step - step + 1  # the first window of the step
                end = min(b, low + step)
                core = texts[d].cut(s + low + step - 1, s + low + kind.length)
                rows.append(((digest(core, (int(offset[i]) - w) // step) + 2**63) % 2**64 - 2**63, ids[d], hs[d], s + w, s + end + tail, int(offset[i]) - w, cut(i, w, end)))
                w = end
        local: dict[int, list[tuple[int, int]]] = {}
        for i, a, b in zip(*(x.tolist() for x in old)):
            local.setdefault(int(doc[i]), []).append((int(first[i]) + a, int(first[i]) + b + tail))
        for d, spans in local.items():
            rows += [((hs[d] + a + 2**63) % 2**64 - 2**63, ids[d], hs[d], a, b, -1, None) for a, b in merge_spans(spans)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)

    return run


def _resolve_slot(kind: Kind, parts: int):
    form = _arrow(SPANS)

    def run(t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_null(t.column("bytes")))
        t = t.filter(pc.is_valid(t.column("bytes"))).sort_by([(c, "ascending") for c in ("key", "id", "h", "start")])
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, h, a, b in zip(*(known.column(c).to_pylist() for c in ("id", "h", "start", "end"))):
            by.setdefault((i, h), []).append((a, b))
        key, start, end, offset = (t.column(c).to_numpy() for c in ("key", "start", "end", "offset"))
        lone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True] if len(key) else np.zeros(0, bool)
        met = np.flatnonzero(~lone)
        if len(met):
            stretch, ids, hs = t.column("bytes"), t.column("id").to_pylist(), t.column("h").to_pylist()
            start, offset = start[met], offset[met]
            given = [kind.again(x) for x in stretch.take(pa.array(met)).to_pylist()]
            _, old = split_windows(kind, end[met] - start - kind.length + 1, offset.astype(np.int64), key[met], lambda i, a, b: given[i].cut(a, b + kind.length - 1))
            for i, a, b in zip(*(x.tolist() for x in old)):
                j = int(met[i])
                by.setdefault((ids[j], hs[j]), []).append((int(start[i]) + a, int(start[i]) + b + kind.length - 1))
        rows = [(h % parts, i, h, a, b) for (i, h), spans in by.items() for a, b in merge_spans(spans)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form) if rows else form.empty_table()

    return run


def remove_repeats(
    docs: DataFrame, kind: Kind, finish: Callable[[str, list[tuple[int, int]]], tuple], added: T.StructType, id_col: str = "doc_id", text_col: str = "text", hot: int = 1000
) -> DataFrame:
    """The columns of ``docs`` and those of ``added``, which ``finish(text, merged spans of repeated windows)`` gives.

    A null text is empty and a null id comes before all others. Rows with equal id and equal text are one document, and get
    equal results; rows with equal id and different texts are ordered by a hash of the text. A column of ``docs`` with a name of
    ``added`` is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*(f.name for f in added if f.name not in (id_col, text_col)))
    if {f.name for f in added} & {id_col, text_col}:
        raise ValueError("id and text need other names than the results")
    names = docs.columns
    parts = part_count(docs, 2)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = docs.select(
        F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != text_col)).alias("__row") if len(names) > 1 else F.lit(None).cast("struct<c:int>").alias("__row"),
        F.col(id_col).cast("long").alias("__id0"),
        F.col(text_col).isNull().alias("__null"),
        text.alias("__text"),
    )
    held = held.select("__row", "__null", "__text", id_key("__id0").alias("__id"), F.xxhash64("__id0", "__text").alias("__h"))
    held = held.withColumn("__part", F.pmod("__h", F.lit(parts)).cast("int"))
    buckets = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 8)
    anchors = held.groupBy("__part").applyInArrow(_name_anchors(kind, buckets), ANCHORS)
    answer = anchors.groupBy("bucket").applyInArrow(_answer(hot), ANCHORS)
    stretches = held.groupBy("__part").cogroup(answer.groupBy("part")).applyInArrow(_cut_stretches(kind), STRETCHES)
    slots = stretches.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    spans = slots.groupBy("slot").applyInArrow(_resolve_slot(kind, parts), SPANS)

    out = T.StructType([*held.schema.fields[:3], *(T.StructField(f"__{f.name}", f.dataType) for f in added)])
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(out)

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return target.empty_table()
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, h, a, b in zip(*(found.column(c).to_pylist() for c in ("id", "h", "start", "end"))):
            by.setdefault((i, h), []).append((a, b))
        merged = {k: merge_spans(v) for k, v in by.items()}
        keys = zip(table.column("__id").to_pylist(), table.column("__h").to_pylist())
        done = [finish(t, merged.get(k, [])) for k, t in zip(keys, table.column("__text").to_pylist())]
        cols = [table.column(f).combine_chunks() for f in ("__row", "__null", "__text")] + [pa.array(c, target.field(i + 3).type) for i, c in enumerate(zip(*done))]
        return pa.Table.from_arrays([c.cast(f.type) if not pa.types.is_struct(f.type) else c for c, f in zip(cols, target)], schema=target)

    done = held.groupBy("__part").cogroup(spans.groupBy("part")).applyInArrow(run, out)
    back = {c: F.col(f"__row.c{i}") for i, c in enumerate(names) if c != text_col}
    back[text_col] = F.when(~F.col("__null"), F.col("__text"))
    return done.select(*(back[c].alias(c) for c in names), *(F.col(f"__{f.name}").alias(f.name) for f in added))


__all__ = ["Kind", "NULL_ID", "Text", "merge_spans", "mix", "remove_repeats"]
