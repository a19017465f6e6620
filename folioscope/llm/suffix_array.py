"""Suffix-array deduplication of exact byte repeats.

The suffixes of the gathered stretches are sorted in two stages: those smaller than their successor are sorted directly, by
eight bytes at a time; each of the others follows from its successor's place, in one scan over the buckets of first bytes.
Adjacent common prefixes then show which windows of ``length`` bytes are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import SPAN_LIST, schema
from .repeats import C1, C3, Kind, Text, mix, remove_repeats


def _read(text: str) -> Text:
    data = text.encode("utf-8", "surrogatepass")
    return Text(data, np.frombuffer(data, np.uint8))


def _packed(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, first byte highest."""
    v = codes.astype(np.uint64)
    for step in (1, 2, 4):
        v = (v[:-step] << np.uint64(8 * step)) | v[step:]
    return v


def byte_grams(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a multiple of 8) from each position."""
    v = _packed(codes)
    n = len(codes) - gram + 1
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        h = (h ^ mix(v[at : at + n] * C1)) * C3
    return mix(h)


def sort_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """``wanted`` (ascending positions) in the order of the first ``depth`` bytes of their suffixes, by two-stage sorting."""
    n = len(text)
    padded = np.r_[text, np.zeros(depth + 16, np.uint8)]
    step = np.sign(padded[1 : n + 1].astype(np.int16) - padded[:n].astype(np.int16))
    turn = np.flatnonzero(step)
    after = np.cumsum(step != 0) - (step != 0)  # turns before each position
    smaller = np.zeros(n, bool)  # than its successor
    known = after < len(turn)
    smaller[known] = step[turn[after[known]]] > 0
    # each suffix that is larger than its successor needs that successor's place, down to one that is sorted directly
    member = np.zeros(n + 1, bool)
    member[wanted] = True
    todo = wanted[~smaller[wanted]]
    while len(todo):
        todo = todo[todo + 1 < n] + 1
        todo = todo[~member[todo]]
        member[todo] = True
        todo = todo[~smaller[todo]]
    position = np.flatnonzero(member[:n])
    direct = smaller[position]
    first = text[position]

    words = _packed(padded)
    order = np.flatnonzero(direct)
    group = np.zeros(len(order), np.int64)
    active = np.arange(len(order))  # slots of ``order`` in groups that are not yet told apart
    for at in range(0, depth + 8, 8):
        if not len(active):
            break
        value, g = words[np.minimum(position[order[active]] + at, len(words) - 1)], group[active]
        split = np.zeros(len(order), bool)  # groups whose members differ here; the others stay as they are
        split[g[1:][(g[1:] == g[:-1]) & (value[1:] != value[:-1])]] = True
        here = np.flatnonzero(split[g])
        slots, value, g = active[here], value[here], g[here]
        by = np.lexsort((value, g))
        value = value[by]
        order[slots] = order[slots][by]
        new = np.r_[True, (g[1:] != g[:-1]) | (value[1:] != value[:-1])] if len(g) else np.zeros(0, bool)
        group[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        alone = new & np.r_[new[1:], True] if len(g) else new
        keep = np.ones(len(active), bool)
        keep[here[alone]] = False
        active = active[keep]

    before = np.full(len(position), -1)  # member that precedes this one and follows from it
    follows = np.flatnonzero((position[1:] == position[:-1] + 1) & ~direct[:-1])
    before[follows + 1] = follows
    starts = np.searchsorted(first[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    if len(position) and position[-1] == n - 1 and not direct[-1]:  # the last byte alone: nothing in its bucket is smaller
        waiting[first[-1]].append(np.array([len(position) - 1]))

    def scan(found: np.ndarray) -> None:
        out.append(found)
        p = before[found]
        p = p[p >= 0]
        if len(p):
            c = first[p]
            by = np.argsort(c, kind="stable")
            p, c = p[by], c[by]
            cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)]):
                waiting[c[i]].append(p[i:j])

    for byte in range(256):
        while waiting[byte]:
            found, waiting[byte] = np.concatenate(waiting[byte]), []
            scan(found)
        if starts[byte] < starts[byte + 1]:
            scan(order[starts[byte] : starts[byte + 1]])
    ranked = position[np.concatenate(out)] if out else position[:0]
    keep = np.zeros(n + 1, bool)
    keep[wanted] = True
    return ranked[keep[ranked]]


def common_prefixes(text: np.ndarray, ranked: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix shares its first ``depth`` bytes with the one ranked before it (the first: no)."""
    words = _packed(np.r_[text, np.zeros(depth + 16, np.uint8)])
    same = np.zeros(len(ranked), bool)
    left = np.arange(1, len(ranked))
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        left = left[words[ranked[left] + at] == words[ranked[left - 1] + at]]
    same[left] = True
    return same


def resolve(stretches: list[bytes], offset: np.ndarray, key: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of every window that is also in an earlier stretch of the list."""
    text = np.frombuffer(b"".join(stretches), np.uint8)
    sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
    windows = sizes - kind.length + 1
    starts = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(sizes)), windows)
    within = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted = starts[which] + within
    ranked = sort_suffixes(text, wanted, kind.length)
    same = common_prefixes(text, ranked, kind.length)
    group = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    earliest = np.minimum.reduceat(ranked, heads) if len(heads) else ranked
    later = ranked[ranked != earliest[group]] if len(ranked) else ranked
    row = np.searchsorted(starts, later, side="right") - 1
    return row, later - starts[row]


ADDED = schema(kept="binary", spans=SPAN_LIST)


def _finish(text: str, spans: list[tuple[int, int]]) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    at, kept = 0, []
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), [{"start": a, "end": b} for a, b in spans]


def deduplicate_bytes(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = 1000) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) and ``spans`` (maximal removed byte ranges, end exclusive).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Null texts are empty, null ids come first, rows with equal id and text are one document, ties of
    id are ordered by a hash of the text. An empty table gives no rows. ``length`` must be at least 40.
    """
    if length < 40:
        raise ValueError("length must be at least 40 bytes")
    return remove_repeats(docs, Kind(length, 32, _read, lambda cut: Text(cut, np.zeros(0)), byte_grams, resolve), _finish, ADDED, id_col, text_col, hot)
