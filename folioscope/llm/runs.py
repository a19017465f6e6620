"""Periodic runs of words in each document, by Lyndon roots.

Under one of two opposite orders of the words, the root of a run (its smallest period) is a longest Lyndon word where it starts
(the "runs" theorem). So each text is scanned from right to left with a stack of Lyndon words, once for each order: the word
that starts at i ends where the next smaller suffix starts. Suffixes are compared, and runs extended both ways, by their
longest common extension (LCE), found by binary search over rolling hashes and confirmed word by word: a hash may only cost
time, never a result. No suffix array is built. Documents are independent: there is no shuffle, and a task holds one Arrow
batch of texts and the arrays of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, schema

PRIME = (1 << 31) - 1
BASE = 911_382_323
#: Words that are compared one by one before hashes are asked.
DIRECT = 4

RUN_LIST = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Powers:
    """Powers of BASE modulo PRIME, as many as the longest text so far needed."""

    def __init__(self) -> None:
        self.array = np.ones(1, np.int64)
        self.list = [1]

    def upto(self, n: int) -> None:
        if n > len(self.array):
            while len(self.array) < n:
                step = pow(BASE, len(self.array), PRIME)
                self.array = np.concatenate((self.array, self.array * step % PRIME))
            self.list = self.array.tolist()


class Extensions:
    """Longest common extensions of the positions of one sequence."""

    def __init__(self, words: list[int], powers: Powers):
        n = self.n = len(words)
        powers.upto(n + 1)
        self.words, self.power = words, powers.list
        self.array = np.array(words, np.int32)
        self.bytes = self.array.tobytes()
        self.sums = np.r_[0, np.cumsum((self.array + np.int64(1)) * powers.array[:n] % PRIME)] % PRIME
        self.hash = self.sums.tolist()
        self.known: dict[int, tuple[int, int]] = {}  # by distance: the last stretch that was confirmed, and where it ends

    def _same(self, i: int, j: int, k: int) -> bool:
        """Whether the hashes of k words from i and from j > i agree."""
        h = self.hash
        return ((h[i + k] - h[i]) * self.power[j - i] - h[j + k] + h[j]) % PRIME == 0

    def _confirmed(self, i: int, j: int, k: int) -> int:
        """How many of the k words from i and from j are equal before the first that differ."""
        b = self.bytes
        if b[4 * i : 4 * (i + k)] == b[4 * j : 4 * (j + k)]:
            return k
        return int(np.argmax(self.array[i : i + k] != self.array[j : j + k]))

    def right(self, i: int, j: int) -> int:
        """Words from i that equal those from j > i."""
        w, n = self.words, self.n
        k, most = 0, n - j
        while k < most and w[i + k] == w[j + k]:
            k += 1
            if k == DIRECT:
                break
        else:
            return k
        lo, hi = self.known.get(j - i, (n, n))
        if lo <= i + k < hi:
            self.known[j - i] = (min(lo, i), hi)
            return hi - i
        step = k
        while k + step <= most and self._same(i + k, j + k, step):
            k += step
            step *= 2
        while step:  # k words are equal, k + step more are not
            if k + step <= most and self._same(i + k, j + k, step):
                k += step
            step >>= 1
        end = lo if i < lo < i + k <= hi else i + k  # what is known need not be confirmed again
        found = self._confirmed(i, j, end - i)
        if found < end - i:
            k = found
        elif end == lo:
            k = hi - i
        self.known[j - i] = (i, i + k)
        return k

    def left(self, i: int, j: int) -> int:
        """Words before i that equal those before j > i."""
        w, k = self.words, 0
        while k < i and w[i - k - 1] == w[j - k - 1]:
            k += 1
            if k == DIRECT:
                break
        else:
            return k
        step = k
        while k + step <= i and self._same(i - k - step, j - k - step, step):
            k += step
            step *= 2
        while step:
            if k + step <= i and self._same(i - k - step, j - k - step, step):
                k += step
            step >>= 1
        b = self.bytes
        if b[4 * (i - k) : 4 * i] != b[4 * (j - k) : 4 * j]:
            k = int(np.argmax((self.array[i - k : i] != self.array[j - k : j])[::-1]))
        return k


def next_smaller(words: list[int], extensions: Extensions) -> list[int]:
    """For each position, where the longest Lyndon word that starts there ends: at the next smaller suffix, or the end. The end
    is smaller than any word."""
    n = len(words)
    ends = [n] * n
    for i in range(n - 2, -1, -1):
        first, j = words[i], i + 1
        while j < n:
            other = words[j]
            if other < first:
                break
            if other == first:
                k = extensions.right(i, j)
                if j + k >= n or words[j + k] < words[i + k]:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs_of(words: list[int], powers: Powers, least: int = 24, periods: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` by start, then period, of every maximal run with at least ``least`` words and ``periods``
    times its smallest period."""
    n = len(words)
    if n < max(least, periods):
        return []
    ext, found, seen = Extensions(words, powers), set(), {}
    sums, power = ext.sums, powers.array
    for order in (words, [-x for x in words]):
        ends = np.array(next_smaller(order, ext), np.int64)
        i = np.flatnonzero(2 * ends - np.arange(n) <= n)  # a run of three periods has its first root three times, but for a part
        j = ends[i]
        keep = (j < n) & (ext.array[i] == ext.array[np.minimum(j, n - 1)])
        i, j = i[keep], j[keep]
        p = j - i
        keep = ((sums[j] - sums[i]) % PRIME * power[p] - sums[j + p] + sums[j]) % PRIME == 0
        for a, q in zip(i[keep].tolist(), p[keep].tolist()):
            b, last = a + q, seen.get(q)
            if last is not None and last[0] <= a and b < last[1]:
                continue
            start, end = a - ext.left(a, b), b + ext.right(a, b)
            if end - start >= 2 * q:
                seen[q] = (start, end)
                if end - start >= max(least, periods * q):
                    found.add((start, end - start, q))
        seen.clear()
    return sorted((s, length, q) for s, length, q in found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, periods: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, runs (start, length and period in words, by start, then period) and
    collapsed: the words that stay if every run keeps its first period only, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A run is maximal, has its smallest period, at least ``least`` words and at
    least ``periods`` (three or more) periods; runs may overlap, and a word goes if any run drops it. A null or blank text has no
    words, no runs and an empty collapsed text. Null ids and repeated rows are returned as given, an empty table gives no rows,
    other columns are not read. No limit on the length of a text or the number of runs.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            sizes, lists, texts = [], [], []
            for text in batch.column("text"):
                parts = text.as_py().encode("utf-8").split()
                numbers: dict[bytes, int] = {}
                runs = runs_of([numbers.setdefault(x, len(numbers)) for x in parts], powers, least, periods)
                sizes.append(len(parts))
                if runs:
                    parts = [parts[i] for i in np.flatnonzero(kept_words(len(parts), runs)).tolist()]
                lists.append([{"start": s, "length": length, "period": q} for s, length, q in runs])
                texts.append(b" ".join(parts).decode("utf-8"))
            runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(lists, runs_type), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema(doc_id="long", n_words="long", runs=RUN_LIST, collapsed="string"))


def strongest(runs: str = "runs"):
    """The run with the greatest exact length / period, ties to the smallest start, then period; null if there is none."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(F.col(runs), F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
