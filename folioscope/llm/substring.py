"""Substring deduplication by words: seed and extend.

Documents are joined on winnowed anchors of eight words (the seeds, see ``repeats``). Stretches that share a seed are
extended a word at a time, to the left and to the right, all at once: after j steps two stretches are in one class if they
agree on j more words. A left class and a right class that together span ``length`` words are a repeat; overlapping repeats
merge into maximal ones.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from .common import SPAN_LIST, schema
from .repeats import C1, C3, Kind, Text, mix, remove_repeats


def _read(text: str) -> Text:
    words = text.encode("utf-8", "surrogatepass").split()
    digest = xxhash.xxh3_64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return Text(b" ".join(words), np.fromiter(map(digest, words), np.uint64, len(words)), ends - sizes, ends)


def _again(cut: bytes) -> Text:
    ends = np.flatnonzero(np.r_[np.frombuffer(cut, np.uint8) == 32, True])
    return Text(cut, ends, np.r_[0, ends[:-1] + 1], ends)


def word_grams(codes: np.ndarray, gram: int) -> np.ndarray:
    n = len(codes) - gram + 1
    h = np.zeros(max(n, 0), np.uint64)
    for at in range(gram):
        h = (h ^ mix(codes[at : at + n] * C1)) * C3
    return mix(h)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair (a[i], b[i]); -1 on either side stays -1."""
    bad = (a < 0) | (b < 0)
    both = np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)
    both[bad] = -1
    return both


def resolve(stretches: list[bytes], offset: np.ndarray, key: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, window) of every window that is also in an earlier stretch with the same anchor."""
    number: dict[bytes, int] = {}
    words = [[number.setdefault(w, len(number)) for w in s.split(b" ")] for s in stretches]
    n, reach = len(stretches), kind.length - kind.gram
    sizes = np.fromiter(map(len, words), np.int64, n)
    flat = np.fromiter((w for ws in words for w in ws), np.int64, int(sizes.sum()))
    seed = np.cumsum(sizes) - sizes + offset
    ends = np.cumsum(sizes)
    together = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for j in range(kind.gram):
        together = _pair(together, flat[seed + j])
    left, right = [together], [together]
    for j in range(reach):
        there = seed - 1 - j >= seed - offset
        left.append(_pair(left[-1], np.where(there, flat[np.maximum(seed - 1 - j, 0)], -1)))
        at = seed + kind.gram + j
        right.append(_pair(right[-1], np.where(at < ends, flat[np.minimum(at, len(flat) - 1)], -1)))
    rows, windows = [], []
    for j in range(reach + 1):
        both = _pair(left[j], right[reach - j])
        there = np.flatnonzero(both >= 0)
        _, first, inverse = np.unique(both[there], return_index=True, return_inverse=True)
        again = there[first[inverse] != np.arange(len(there))]
        rows.append(again)
        windows.append(offset[again] - j)
    return np.concatenate(rows), np.concatenate(windows).astype(np.int64)


ADDED = schema(n_words="long", kept="string", spans=SPAN_LIST)


def _finish(text: str, spans: list[tuple[int, int]]) -> tuple:
    words = text.encode("utf-8", "surrogatepass").split()
    at, kept = 0, []
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), b" ".join(kept).decode("utf-8", "replace"), [{"start": a, "end": b} for a, b in spans]


def deduplicate_words(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = 1000) -> DataFrame:
    """``docs`` with n_words, ``kept`` (words that stay, joined by a space) and ``spans`` (maximal repeats, in words, end exclusive).

    A word goes if ``length`` consecutive words that cover it also start earlier: in a document with a smaller id, or earlier
    in the same one. Null texts have no words, null ids come first, rows with equal id and text are one document, ties of id
    are ordered by a hash of the text. An empty table gives no rows. ``length`` must be at least 9.
    """
    if length < 9:
        raise ValueError("length must be at least 9 words")
    return remove_repeats(docs, Kind(length, 8, _read, _again, word_grams, resolve), _finish, ADDED, id_col, text_col, hot)
