"""Byte-level BPE, encoding and decoding, by a rank queue on a hierarchical bitmap.

The pending merges lie in one bucket per merge rank; a bucket holds positions of the linked list of parts.
Three levels of 64-bit words say which buckets hold anything, so the next rank is found by three find-first-set steps, however
long the pre-token is. A merge only changes its neighbours' pairs; entries that no longer describe the pair at their position
are skipped when they come up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .pieces import PieceCache


class RankQueue:
    """Buckets of positions by rank; the lowest rank that has any comes first."""

    __slots__ = ("buckets", "leaf", "middle", "top")

    def __init__(self, ranks: int):
        self.leaf = [0] * (ranks // 64 + 1)
        self.middle = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        self.leaf[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]]:
        """Take the bucket of the lowest rank: a find-first-set on each level, and the bits of what is now empty cleared."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.leaf[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.leaf[b] = word = word & (word - 1)
        if not word:
            self.middle[a] = word = self.middle[a] & (self.middle[a] - 1)
            if not word:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


#: Patterns under which a single space between two words starts a pre-token, so that texts may be cut there.
CUT_AT_SPACES = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)
#: Bytes of pre-tokens that share one queue.
QUEUE_BYTES = 1 << 19
#: Positions of one rank from which they are merged as arrays.
MANY = 24


class BytePairs(PieceCache):
    """A vocabulary of byte strings by rank, and the pattern that splits a text into pre-tokens.

    The pre-tokens of a batch stand end to end in one linked list and share one queue: merges in different pre-tokens do not
    touch, so taking all positions of the lowest rank together changes nothing but the number of steps.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.names: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for name, i in ranks.items():
            self.names[i] = name
        self.pattern = regex.compile(pattern)
        self.by_piece = pattern in CUT_AT_SPACES
        self.queue = RankQueue(len(self.names))
        one = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.single = np.array(one, np.int64)
        two = np.full(1 << 16, -1, np.int64)
        for name, i in ranks.items():
            if len(name) == 2:
                two[name[0] << 8 | name[1]] = i
        self.double = two

    @cached_property
    def both(self) -> dict[int, int]:
        """Every pair of ids whose bytes together are in the vocabulary, and the id of both."""
        found = {}
        for name, i in self.ranks.items():
            for at in range(1, len(name)):
                a, b = self.ranks.get(name[:at]), self.ranks.get(name[at:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        return found

    @cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The same as arrays, for many pairs at once."""
        keys = np.array(sorted(self.both), np.int64)
        return keys, np.array([self.both[k] for k in keys.tolist()], np.int64)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of each two ids together, or -1."""
        keys, values = self.sorted_pairs
        want = left << 32 | right
        if not len(keys):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian i4) of each pre-token; one that is in the vocabulary as a whole is its own id."""
        text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        n = len(text)
        if not n:
            return [b""] * len(pieces)
        # a part starts at i and the next one at after[i]; pair[i] is the id of both together, -1: none, -2: no part starts here
        pairs_ = np.full(n + 1, -1, np.int64)
        pairs_[: n - 1] = self.double[text[:-1] << 8 | text[1:]]
        pairs_[ends[ends > 0] - 1] = -1
        tokens_, afters, befores = np.r_[self.single[text], 0], np.arange(1, n + 2), np.arange(-1, n)
        first_, last_ = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        first_[0] = True
        first_[ends] = True
        last_[ends[ends > 0] - 1] = True
        token, after, before, pair, first, last = (memoryview(x) for x in (tokens_, afters, befores, pairs_, first_, last_))
        queue, merged = self.queue, self.both.get
        buckets, open_, pop = queue.buckets, queue.open, queue.pop

        def push(where: np.ndarray, ranks: np.ndarray) -> None:
            keep = ranks >= 0
            where, ranks = where[keep], ranks[keep]
            by = np.argsort(ranks, kind="stable")
            where, ranks = where[by], ranks[by]
            cuts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]]).tolist() if len(ranks) else []
            places, names = where.tolist(), ranks.tolist()
            for a, b in zip(cuts, [*cuts[1:], len(places)]):
                if names[a] in buckets:
                    buckets[names[a]] += places[a:b]
                else:
                    open_(names[a], places[a:b])

        push(np.arange(n), pairs_[:n])
        while queue.top:
            low, positions = pop()
            if len(positions) >= MANY:
                at = np.array(positions, np.int64)
                at.sort()
                at = at[np.r_[True, at[1:] != at[:-1]] & (pairs_[at] == low)]
                gone = afters[at]
                if not (gone[:-1] == at[1:]).any():  # none overlaps the next: all merge at once
                    end = afters[gone]
                    afters[at], tokens_[at], pairs_[gone] = end, low, -2
                    ends_here = last_[gone]
                    last_[at] = ends_here
                    befores[end[~ends_here]] = at[~ends_here]
                    inner, begins = at[~ends_here], first_[at]
                    left = befores[at[~begins]]
                    right_rank = self._pairs(tokens_[inner], tokens_[end[~ends_here]])
                    pairs_[at] = -1
                    pairs_[inner] = right_rank
                    left_rank = self._pairs(tokens_[left], tokens_[at[~begins]])
                    pairs_[left] = left_rank
                    push(np.r_[inner, left], np.r_[right_rank, left_rank])
                    continue
                positions = at.tolist()
            else:
                positions.sort()
            for i in positions:
                if pair[i] != low:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                token[i] = low
                pair[gone] = -2
                if last[gone]:
                    last[i] = True
                    pair[i] = -1
                else:
                    before[end] = i
                    key = low << 32 | token[end]
                    new = merged(key, -1)
                    pair[i] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            open_(new, [i])
                if not first[i]:
                    left = before[i]
                    key = token[left] << 32 | low
                    new = merged(key, -1)
                    if new != pair[left]:
                        pair[left] = new
                        if new >= 0:
                            if new in buckets:
                                buckets[new].append(left)
                            else:
                                open_(new, [left])
        alive = pairs_[:n] > -2
        if len(pieces) and (tokens_[:n][alive] < 0).any():
            raise KeyError("the vocabulary lacks a byte that the text holds")
        count = np.r_[0, np.cumsum(alive)]
        raw = tokens_[:n][alive].astype("<i4").tobytes()
        at = (4 * count[np.r_[0, ends]]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        out: list = [None] * len(pieces)
        todo, size = [], 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(todo, self.merge([pieces[i] for i in todo])):
                out[i] = ids
            todo.clear()
            size = 0

        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
                continue
            todo.append(i)
            size += len(p)
            if size >= QUEUE_BYTES:
                flush()
        if todo:
            flush()
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        cut = [[p.encode("utf-8", "surrogatepass") for p in self.pattern.findall(t)] for t in texts]
        done = iter(self._encode([p for c in cut for p in c]))
        return [b"".join(next(done) for _ in c) for c in cut]

    def solid(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        letters = [i for i, t in enumerate(texts) if t.lstrip(" ").isalpha()]
        for i, ids in zip(letters, self._encode([texts[i].encode("utf-8", "surrogatepass") for i in letters])):
            out[i] = ids
        done = set(letters)
        rest = [i for i in range(len(texts)) if i not in done]
        for i, ids in zip(rest, self.whole([texts[i] for i in rest])):
            out[i] = ids
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        return super().encode_batch(texts) if self.by_piece else self.whole(texts)

    def encode_column(self, texts: pa.StringArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """As in PieceCache; under any other pattern than CUT_AT_SPACES every text is split as a whole."""
        if self.by_piece:
            return super().encode_column(texts, dtype)
        found = [np.frombuffer(x, dtype) for x in self.whole(texts.to_pylist())]
        return np.concatenate([np.zeros(0, dtype), *found]), np.cumsum([0, *map(len, found)])

    def decode(self, ids: list[int]) -> bytes:
        if ids and min(ids) < 0:
            raise IndexError(f"id {min(ids)} is not in the vocabulary")
        return b"".join(map(self.names.__getitem__, ids))


_loaded: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs.load(path, pattern)
    return _loaded[path, pattern]


def _with(docs: DataFrame, added: T.StructField, run) -> DataFrame:
    """``docs`` with one more column that ``run`` makes from the batch; other columns pass through under their own names."""
    ship(docs.sparkSession)
    if added.name in docs.columns:
        docs = docs.drop(added.name)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, added]))


#: Rows that are encoded before a batch is passed on.
ROWS = 1000


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with ``to``: the ids of the whole text by the ranks in ``path``; each match of ``pattern`` is encoded by itself.

    A null text is empty and has no ids. Rows, repeated ones too, and other columns stay; a column named ``to`` is replaced.
    """
    held = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = held.columns.index(text_col) if to != text_col else None
    if at is None:
        raise ValueError("the ids need a column of their own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = byte_pairs(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids, ends = made.encode_column(part.column(part.schema.get_field_index(text_col)).fill_null(""), np.dtype("<i4"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], [*part.schema.names, to])

    return _with(held, T.StructField(to, T.ArrayType(T.IntegerType())), run)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with ``to``: the bytes that the ids stand for (null ids: no bytes). An id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = byte_pairs(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                column = part.column(part.schema.get_field_index(ids_col))
                blobs = [made.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blobs, pa.binary())], [*part.schema.names, to])

    return _with(encoded, T.StructField(to, T.BinaryType()), run)
