"""Byte-level tokenizing by parts that repeat.

Under the byte-level splitting pattern, each single space between two texts without more white space around it starts a new
pre-token, so a text cut at its spaces gives parts whose ids do not depend on each other. Parts repeat, so their ids are kept
in a bounded cache, and all parts of a batch that are new are encoded together.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts with these are encoded whole: rarer white space, on which regular-expression libraries differ.
RARE_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
#: Every boundary of these is a boundary of the byte-level pre-tokenizer too.
PIECES = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A space with more white space after it: such texts are cut by PIECES instead.
SPACE_RUNS = ("  ", " \n", " \t", " \r", " \x0b", " \x0c")
#: Entries of a cache's younger generation; when it is full it becomes the older one, whose entries live on if asked for again.
CACHED = 200_000


class _Known(dict):
    """A dict of two generations that notes which keys were asked for in vain."""

    __slots__ = ("missed", "old")

    def __init__(self) -> None:
        self.missed: list[str] = []
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is None:
            self.missed.append(key)
        else:
            self[key] = found
        return found

    def age(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


class PieceCache:
    """Ids of texts, as the bytes of little-endian integers, from ids of parts.

    A subclass gives ``whole`` (any texts) and ``solid`` (texts whose only white space is at most one leading space).
    """

    special: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.parts = _Known()  # what follows a space -> ids of the space and that
        self.pieces = _Known()  # a text as it is -> its ids

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def solid(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _learn_pieces(self, new: list[str]) -> None:
        blank = [p for p in new if not p or p.isspace()]
        self.pieces.update(zip(blank, self.whole(blank)))
        rest = [p for p in new if p and not p.isspace()]
        self.pieces.update(zip(rest, self.solid(rest)))

    def _learn(self) -> None:
        """Give every part and piece that was missed its ids."""
        parts, pieces = self.parts, self.pieces
        simple: dict[str, None] = {}
        stopped, mixed = [], []
        for p in dict.fromkeys(parts.missed):
            if p.isalpha():
                simple[p] = None
            elif p[-1:] in (",", ".") and p[:-1].isalpha():  # letters and a stop are two pre-tokens
                stopped.append(p)
                if p[:-1] not in parts and p[:-1] not in parts.old:
                    simple[p[:-1]] = None
            else:
                cut = PIECES.findall(f" {p}")
                if len(cut) == 1 and p:
                    simple[p] = None
                else:
                    mixed.append((parts, p, cut))
        parts.missed = []
        parts.update(zip(simple, self.solid([f" {p}" for p in simple])))
        alone: dict[str, None] = {}
        for p in dict.fromkeys(pieces.missed):
            cut = PIECES.findall(p)
            if len(cut) > 1:
                mixed.append((pieces, p, cut))
            else:
                alone[p] = None
        pieces.missed = []
        for _, _, cut in mixed:
            alone.update(dict.fromkeys(cut))
        if stopped:
            alone.update({",": None, ".": None})
        self._learn_pieces([p for p in alone if p not in pieces and p not in pieces.old])
        stop = {s: pieces[s] for s in ",."} if stopped else {}
        for p in stopped:
            parts[p] = parts[p[:-1]] + stop[p[-1]]
        for known, p, cut in mixed:
            known[p] = b"".join(map(pieces.__getitem__, cut))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        self.parts.age()
        self.pieces.age()
        part, piece = self.parts.__getitem__, self.pieces.__getitem__
        out: list = [None] * len(texts)
        cut: list[tuple[int, bool, str, list[str], list[bytes | None]]] = []
        for i, text in enumerate(texts):
            if RARE_SPACE.search(text) or self.special and any(s in text for s in self.special):
                out[i] = self.whole([text])[0]
            elif any(s in text for s in SPACE_RUNS):
                rest = PIECES.findall(text)
                cut.append((i, True, "", rest, list(map(piece, rest))))
            else:
                first, *rest = text.split(" ")
                piece(first)
                cut.append((i, False, first, rest, list(map(part, rest))))
        if self.parts.missed or self.pieces.missed:
            self._learn()
        for i, spaced, first, rest, found in cut:
            self._fill(found, rest, piece if spaced else part)
            out[i] = b"".join(found) if spaced else piece(first) + b"".join(found)
        return out

    @staticmethod
    def _fill(found: list, keys: list[str], again) -> None:
        """Replace what was missing by what is known now."""
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = again(keys[at])
        except ValueError:
            return

    def _odd(self, texts: pa.StringArray) -> pa.BooleanArray:
        odd = pc.match_substring_regex(texts, RARE_SPACE.pattern)
        for run in (*SPACE_RUNS, *self.special):
            odd = pc.or_(odd, pc.match_substring(texts, run))
        return odd

    def encode_column(self, texts: pa.StringArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin (one more entry for the end).

        Texts are cut at their spaces and equal parts numbered by Arrow, so only distinct parts are looked up one by one.
        """
        odd = self._odd(texts)
        slow = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = texts if not len(slow) else texts.filter(pc.invert(odd))
        ids, offsets = self._encode_plain(plain, dtype) if len(plain) else (np.zeros(0, dtype), np.zeros(1, np.int64))
        if not len(slow):
            return ids, offsets
        found = dict(zip(slow.tolist(), self.encode_batch(texts.take(pa.array(slow)).to_pylist())))
        parts, at = [], 0
        for i in range(len(texts)):
            if i in found:
                parts.append(np.frombuffer(found[i], dtype))
            else:
                parts.append(ids[offsets[at] : offsets[at + 1]])
                at += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _looked_up(self, texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Ids of the distinct parts of the texts, which of them each part is, and where each text's parts begin (and the last ends)."""
        self.parts.age()
        self.pieces.age()
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = cut.flatten().dictionary_encode()
        keys, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        heads = [keys[i] for i in which[bounds[:-1]].tolist()]  # nothing stands before these
        inner = np.ones(len(which), bool)
        inner[bounds[:-1]] = False
        used = np.zeros(len(keys), bool)
        used[which[inner]] = True
        for i in np.flatnonzero(~used).tolist():
            keys[i] = ""  # only ever first: not to be read as following a space
        part, piece = self.parts.__getitem__, self.pieces.__getitem__
        values, first = list(map(part, keys)), list(map(piece, heads))
        if self.parts.missed or self.pieces.missed:
            self._learn()
            self._fill(values, keys, part)
            self._fill(first, heads, piece)
        which[bounds[:-1]] = len(values) + np.arange(len(first))
        values += first
        return values, which, bounds

    def _encode_plain(self, texts: pa.StringArray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        values, which, bounds = self._looked_up(texts)
        data = np.frombuffer(b"".join(values), dtype)
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // dtype.itemsize
        starts = np.cumsum(sizes) - sizes
        n = sizes[which]
        ends = np.cumsum(n)
        order = np.repeat(starts[which] - (ends - n), n)
        order += np.arange(len(order))
        return data[order], np.r_[0, ends][bounds]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]
