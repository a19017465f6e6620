"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line's potential comes from its own features and those of the lines around it, neighbouring
labels share a transition potential, and forward-backward gives each line's marginal. The document's quality is the mean
marginal, weighted by line length; a logistic curve turns it into the probability of label 1. Two states allow the messages
to be kept as log odds.

Only documents are labelled, not lines. Lines of good documents count as good. Which lines of a bad document are the bad ones
is found in turns with the field (``line_labels``): those it holds for bad, and at least half of the text. Chains that go over
from the lines of one document to those of another, with their labels, teach the transitions between good and bad.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import in_share, sample_rows, schema

SYMBOLS = "#*$%&|<>^~=_\\{}[]@"
UPPER, LOWER, DIGIT, SPACE, SYMBOL, SHOUT, PIPE = range(7)


def _table() -> np.ndarray:
    """Which of the classes each code point below 0x250 is in; the rest count as lower-case letters."""
    table = np.zeros((0x251, 7), np.uint8)
    for c in range(0x250):
        s, kind = chr(c), unicodedata.category(chr(c))
        table[c] = [kind == "Lu", kind[0] == "L" and kind != "Lu", kind == "Nd", s in " \t\n\x0b\x0c\r", s in SYMBOLS, s == "!", s == "|"]
    table[0x250, LOWER] = 1
    return table


CLASSES = _table()
OWN = 13


def line_features(lines: list[str]) -> np.ndarray:
    """One row of features in [0, 1] for each line of one document."""
    codes = np.minimum(np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), 0x250)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.cumsum(lengths + 1) - lengths - 1
    sums = np.zeros((len(lines), 7))
    for k in range(7):  # the line break after a line counts as its space
        sums[:, k] = np.add.reduceat(CLASSES[codes, k], np.minimum(starts, max(len(codes) - 1, 0)), dtype=np.int64) if len(codes) else 0
    sums[lengths == 0] = 0
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.float64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, len(lines))
    twins = np.fromiter((sum(map(str.__eq__, w, w[1:])) for w in words), np.float64, len(lines))
    seen: set[str] = set()
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        again[i] = line in seen
        seen.add(line)
    chars, some = np.maximum(lengths, 1), np.maximum(n_words, 1)
    letters = np.maximum(sums[:, UPPER] + sums[:, LOWER], 1)
    ends = np.fromiter((x[-1:] in ".!?…:;\"'”»)" and x != "" for x in lines), np.float64, len(lines))
    return np.stack(
        [
            np.minimum(np.log1p(lengths) / 8, 1),
            sums[:, UPPER] / letters,
            np.minimum(5 * sums[:, DIGIT] / chars, 1),
            np.minimum(5 * sums[:, SYMBOL] / chars, 1),
            np.minimum(sums[:, SHOUT] / some, 1),
            np.minimum(sums[:, PIPE] / some, 1),
            distinct / some,
            (distinct / some < 0.3) & (n_words >= 5),
            again,
            np.minimum(chars / some / 20, 1),
            ends,
            n_words < 3,
            twins / some,
        ],
        axis=1,
    ).astype(np.float64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after, two flags for the ends, and a constant."""
    none = np.zeros((1, own.shape[1]))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    edge = np.zeros((len(own), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([own, before, after, edge, np.ones((len(own), 1))])


WIDTH = 3 * OWN + 3


def read_lines(text: str) -> list[str]:
    """The lines that hold more than white space."""
    return [x for x in text.split("\n") if x.strip()]


@dataclass(frozen=True)
class LineModel:
    """weights: of a line's features for good against bad; stay: transition log potentials [bad-bad, bad-good, good-bad,
    good-good]; curve: slope and intercept from document quality to label; prior: share of label 1."""

    weights: np.ndarray
    stay: np.ndarray
    curve: tuple[float, float]
    prior: float

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """P(good) of every line of each chain of features."""
        return _forward_backward([x @ self.weights for x in chains], self.stay)[0]

    def quality(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean marginal of each text; of a text without lines, nan."""
        lines = [read_lines(t) for t in texts]
        full = [i for i, x in enumerate(lines) if x]
        out = np.full(len(texts), np.nan)
        for i, p in zip(full, self.marginals([with_neighbours(line_features(lines[i])) for i in full])):
            out[i] = np.average(p, weights=np.fromiter(map(len, lines[i]), np.float64, len(p)))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        q = self.quality(texts)
        return np.where(np.isnan(q), self.prior, 1 / (1 + np.exp(-(self.curve[0] * np.nan_to_num(q) + self.curve[1]))))


def _step(odds: np.ndarray, stay: np.ndarray, back: bool) -> np.ndarray:
    """Log odds that a neighbour's odds send over the transition; ``back``: against the direction of reading."""
    bb, bg, gb, gg = stay
    if back:
        bg, gb = gb, bg
    return np.logaddexp(odds + gg, bg) - np.logaddexp(odds + gb, bb)


def _forward_backward(emissions: list[np.ndarray], stay: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Marginals, and the summed expected count of each transition; all chains advance together, longest first."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order], np.int64)
    if not len(order):
        return [], np.zeros(4)
    top = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(top), side="left")  # chains longer than t
    at = np.r_[0, np.cumsum(alive)]
    e = np.empty(int(at[-1]))
    for j, i in enumerate(order):
        e[at[: lengths[j]] + j] = emissions[i]
    forward, back = e.copy(), np.zeros_like(e)
    for t in range(1, top):
        n = alive[t]
        forward[at[t] : at[t] + n] += _step(forward[at[t - 1] : at[t - 1] + n], stay, False)
    for t in range(top - 2, -1, -1):
        n = alive[t + 1]
        nxt = slice(at[t + 1], at[t + 1] + n)
        back[at[t] : at[t] + n] = _step(e[nxt] + back[nxt], stay, True)
    p = 1 / (1 + np.exp(-np.clip(forward + back, -500, 500)))
    pairs = np.zeros(4)
    for t in range(1, top):
        n = alive[t]
        f, b = forward[at[t - 1] : at[t - 1] + n], e[at[t] : at[t] + n] + back[at[t] : at[t] + n]
        logs = np.stack([np.full(n, stay[0]), stay[1] + b, stay[2] + f, stay[3] + f + b])
        logs = np.exp(logs - logs.max(axis=0))
        pairs += (logs / logs.sum(axis=0)).sum(axis=1)
    out: list = [None] * len(order)
    for j, i in enumerate(order):
        out[i] = p[at[: lengths[j]] + j]
    return out, pairs


#: Lines of one training document that are read in one chain.
TRAIN_LINES = 64
#: Turns of labelling the lines of bad documents and fitting the field to them.
TURNS = 3


def line_labels(good: np.ndarray, lengths: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Labels (1: good) for the lines of a bad document from its lines' P(good): under a half is bad, and the lowest ones are
    until ``least`` of the length is."""
    bad = good < 0.5
    order = np.argsort(good, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    bad[order[before < least * lengths.sum()]] = True
    return (~bad).astype(np.float64)


def _fit_field(chains: list[np.ndarray], marks: list[np.ndarray], weights: np.ndarray, stay: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by the likelihood of the labels ``marks`` of the lines in ``chains``."""
    flat, target = np.vstack(chains), np.concatenate(marks)
    cuts = np.cumsum([len(c) for c in chains])[:-1]
    seen = np.zeros(4)
    for y in marks:
        seen += np.bincount((2 * y[:-1] + y[1:]).astype(np.int64), minlength=4)
    moment = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    for r in range(1, rounds + 1):
        p, pairs = _forward_backward(np.split(flat @ weights, cuts), stay)
        slope = np.r_[flat.T @ (target - np.concatenate(p)), seen - pairs] / len(flat) - 1e-3 * np.r_[weights, stay]
        moment[0] = 0.9 * moment[0] + 0.1 * slope
        moment[1] = 0.99 * moment[1] + 0.01 * slope**2
        move = 0.2 * (moment[0] / (1 - 0.9**r)) / (np.sqrt(moment[1] / (1 - 0.99**r)) + 1e-8)
        weights, stay = weights + move[:WIDTH], stay + move[WIDTH:]
    return weights, stay


def _spliced(lines: list[list[str]], marks: dict[int, np.ndarray], bad: list[int], good: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Chains of the first lines of a good document and then those of a bad one, or the other way round."""
    chains, labels = [], []
    for n, i in enumerate(bad):
        j = good[n % len(good)]
        first, second = ((i, j), (j, i))[n % 2]
        x, y = (lines[k][: 1 + (n + k) % 8] for k in (first, second))
        chains.append(with_neighbours(line_features(x + y)))
        labels.append(np.r_[marks[first][: len(x)], marks[second][: len(y)]])
    return chains, labels


def _curve(q: np.ndarray, z: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve from document quality to label, lightly held, by Newton steps."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * q + b, -30, 30)))
        w = p * (1 - p)
        g = np.array([((z - p) * q).sum() - 0.1 * a, (z - p).sum() - 0.1 * b])
        h = np.array([[(w * q * q).sum() + 0.1, (w * q).sum()], [(w * q).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a + float(d[0]), b + float(d[1])
        if np.abs(d).max() < 1e-6:
            break
    return a, b


def train(texts: list[str], labels: list[int], rounds: int = 60) -> LineModel:
    """Fit the field in TURNS turns (see the module's note), then the curve on the documents.

    Without any labelled line, or with one label only, all scores are the share of label 1 (with none, 1/2).
    """
    lines = [read_lines(t) for t in texts]
    y = np.array(labels, np.float64)
    prior = float(y.mean()) if len(y) else 0.5
    weights, stay = np.zeros(WIDTH), np.zeros(4)
    full = [i for i, x in enumerate(lines) if x]
    good, bad = [i for i in full if y[i] == 1], [i for i in full if y[i] == 0]
    if not good or not bad:
        return LineModel(weights, stay, (0.0, float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))), prior)
    features = {i: with_neighbours(line_features(lines[i])) for i in full}
    lengths = {i: np.fromiter(map(len, lines[i]), np.float64, len(lines[i])) for i in full}
    marks = {i: np.full(len(lines[i]), y[i]) for i in full}
    own = np.r_[np.ones(OWN), np.zeros(2 * OWN + 2), 1.0]
    for turn in range(TURNS):
        if turn == 0:  # the lines by themselves: what lies around a line of a bad document says nothing yet
            chains, given = [x * own for i in full for x in np.split(features[i], len(features[i]))], [m for i in full for m in np.split(marks[i], len(marks[i]))]
        else:
            pieces = [(i, a) for i in full for a in range(0, len(features[i]), TRAIN_LINES)]
            chains, given = [features[i][a : a + TRAIN_LINES] for i, a in pieces], [marks[i][a : a + TRAIN_LINES] for i, a in pieces]
            more = _spliced(lines, marks, bad, good)
            chains, given = chains + more[0], given + more[1]
        weights, stay = _fit_field(chains, given, weights, stay, rounds)
        found, _ = _forward_backward([features[i] * own @ weights if turn == 0 else features[i] @ weights for i in bad], stay * (turn > 0))
        marks |= {i: line_labels(p, lengths[i]) for i, p in zip(bad, found)} if turn < TURNS - 1 else {}
    model = LineModel(weights, stay, (1.0, 0.0), prior)
    q = model.quality(texts)
    known = ~np.isnan(q)
    return LineModel(weights, stay, _curve(q[known], y[known]), prior)


def held_out(id_col: str = "doc_id"):
    """Whether a document's labels may never be learnt from: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", longest: int = 50_000) -> LineModel:
    """Train on about ``rows`` (at most twice as many) labelled documents of at most ``longest`` characters, chosen by a hash of
    their id; held-out, unlabelled and null-id rows never."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    known = known.where(~held_out("__id"))
    total = known.count()
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).where(F.length("__text") <= longest)
    share = min(1.0, rows / max(1, total))
    sample = texts.join(known.where(in_share(share, "__id")), "__id").limit(2 * rows).collect()
    if not sample and total:  # few labels, or none of the chosen in docs: all that can be learnt from
        sample = sample_rows(texts.join(known, "__id"), rows, ("__id", "__text"))
    sample = sorted(sample, key=lambda r: (r["__id"], r["__text"]))
    return train([r["__text"] for r in sample], [r["__label"] for r in sample])


def classify(docs: DataFrame, model: LineModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1) and quality_predicted (1 if the score is at least ``threshold``).

    A null or blank text scores the share of label 1 in training. Rows, columns and repeated rows stay as they are; columns of
    these two names are replaced; an empty table stays empty.
    """
    ship(docs.sparkSession)
    docs = docs.drop("quality_score", "quality_predicted")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                score = model.score([x.as_py() or "" for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*part.schema.names, "quality_score", "quality_predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *schema(quality_score="double", quality_predicted="int").fields]))
