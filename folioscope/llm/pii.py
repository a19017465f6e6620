"""Personal data: base patterns and a skip-chain conditional random field over the tokens around them.

The base spans come from four patterns and always stay. The field labels tokens with a kind, with "secret" (keys and passwords,
which have no base pattern) or with nothing. Its nodes are tokens that hold a digit or an at sign, and the tokens next to them;
elsewhere a token has no evidence and its label is fixed to nothing. Neighbouring tokens share a transition potential; a token
shares a skip potential with the last token before it that it repeats, and another with the last one that it is like (the same
last seven digits, the same local part or host of an address), however far away. Loopy message passing makes the labels of
repeated data agree: a bare ten-digit number is a phone number if the text gives it with its prefix elsewhere, and nothing
otherwise. Weights and potentials are learnt together by likelihood, from a bounded sample in which known data are repeated in
forms that no base pattern knows, beside decoys of the same shapes. A confident label outside base spans adds a span.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import sample_rows

#: Kinds that have a base pattern, and all kinds that the field knows.
KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
#: Label 0 is "nothing".
N_LABELS = len(LABELS) + 1

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EVIDENCE = re.compile(r"[0-9@]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign outwards, so that long runs without one are never rescanned."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and LOCAL_PART.match(text[a - 1]):
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind, by start and kind as listed."""
    if not EVIDENCE.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return [(KINDS[k], a, b) for k, a, b in sorted(found, key=lambda x: (x[1], x[0], x[2]))]


TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = ".,;:!?\"'()[]{}<>|#*$%&"
#: Words that say that the value after them is secret, and what a seed of that kind looks like: used to label training texts only.
CUES = "token secret password passwd pwd key apikey api_key api-key auth".split()
SEED = re.compile(r"(?i)\b(?:" + "|".join(CUES) + r")\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})")

#: Edges between neighbours, between distant equal tokens, and between distant tokens that are alike in part.
CHAIN, SAME, ALIKE = range(3)


@dataclass
class Field:
    """The nodes of one document: token spans, features, and edges of the three sorts (pairs of nodes)."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    edges: tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]


def _shape(token: str) -> list[float]:
    core = token.strip(EDGES)
    d = _digits(core)
    n = len(d)
    dots = core.count(".")
    letters = any(c.isalpha() for c in core)
    return [
        "@" in core,
        "@" in core and "." in core.partition("@")[2],
        n == 0,
        1 <= n <= 3,
        4 <= n <= 6,
        7 <= n <= 9,
        10 <= n <= 13,
        14 <= n <= 19,
        n > 19,
        core.isascii() and core.isdigit(),
        14 <= n <= 19 and luhn(d),
        14 <= n <= 19 and not luhn(d),
        dots == 3 and n >= 4 and len(core) == n + 3 and all(map(_small, core.split("."))),
        token.lstrip("\"'").startswith("+"),
        token.startswith("(") and n > 0,
        "-" in core and n > 4 and len(core) == n + core.count("-"),
        letters,
        letters and n > 0 and len(core) >= 16 and core.isascii() and core.isalnum(),
        letters and n > 0 and len(core) < 16,
        token[:1] in ("=", ":") or token[-1:] in ("=", ":"),
        token.strip(EDGES + "=").lower() in CUES,
    ]


N_SHAPE = 21
N_FEATURES = 4 * N_SHAPE + 1


def _keys(token: str) -> tuple[str, set[str]]:
    """What a token must share to be the same as another, and what it must share to be like it."""
    token = token.strip(EDGES).lower()
    d, alike = _digits(token), set()
    if "@" in token:
        local, _, domain = token.partition("@")
        alike |= {f"l{local}", f"@{domain}"}
    elif any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token):
        alike.add(f"l{token}")
    if len(d) >= 7:
        alike.add(f"e{d[-7:]}")
    if len(d) >= 12:
        alike.add(f"s{d[:10]}")
    return token, alike


def build_field(text: str) -> Field | None:
    """The field of a text; None if no token has evidence. A token is joined to the last one before it under each key."""
    if not EVIDENCE.search(text):
        return None
    tokens = [m.span() for m in TOKEN.finditer(text)]
    strong = [i for i, (a, b) in enumerate(tokens) if EVIDENCE.search(text, a, b)]
    nodes = sorted({j for i in strong for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
    wanted = {j for i in nodes for j in (i - 2, i - 1, i, i + 1) if 0 <= j < len(tokens)}
    shape = {i: _shape(text[slice(*tokens[i])]) for i in wanted}
    none = [0.0] * N_SHAPE
    features = np.array([shape[i] + shape.get(i - 1, none) + shape.get(i + 1, none) + shape.get(i - 2, none) + [1.0] for i in nodes], np.float64)
    place = {i: k for k, i in enumerate(nodes)}
    chain = [(place[i], place[i + 1]) for i in nodes if i + 1 in place]
    same, alike = set(), set()
    last: dict[str, int] = {}
    for i in strong:
        token, others = _keys(text[slice(*tokens[i])])
        if token and last.get(f"={token}", i) < i - 1:
            same.add((place[last[f"={token}"]], place[i]))
        for key in others:
            if last.get(key, i) < i - 1:
                alike.add((place[last[key]], place[i]))
        last |= dict.fromkeys([f"={token}", *others], i)
    return Field([tokens[i] for i in nodes], features, (chain, sorted(same), sorted(alike - same)))


def seeds(text: str) -> list[tuple[str, int, int]]:
    """What training takes for certain: the base spans, and secrets that a cue announces."""
    return base_spans(text) + [("secret", *m.span(1)) for m in SEED.finditer(text)]


def _labels(field: Field, spans: list[tuple[str, int, int]]) -> np.ndarray:
    y = np.zeros(len(field.spans), np.int64)
    for kind, a, b in spans:
        for k, (s, e) in enumerate(field.spans):
            if s < b and a < e:
                y[k] = LABELS.index(kind) + 1
    return y


class Graph:
    """The fields of many documents as one graph: node features, and each edge in both directions."""

    def __init__(self, fields: list[Field]):
        self.shift = np.cumsum([0, *(len(f.spans) for f in fields)])
        self.features = np.vstack([f.features for f in fields])
        ends, sorts = [], []
        for sort in (CHAIN, SAME, ALIKE):
            for f, at in zip(fields, self.shift):
                ends.append(np.array(f.edges[sort], np.int64).reshape(-1, 2) + at)
                sorts.append(np.full(len(f.edges[sort]), sort))
        ends, self.sort = np.vstack(ends), np.concatenate(sorts)
        n = self.n = len(ends)
        self.a, self.b = ends[:, 0], ends[:, 1]
        self.source, self.target = np.r_[self.a, self.b], np.r_[self.b, self.a]
        self.reverse = np.r_[np.arange(n, 2 * n), np.arange(n)]
        self.message = np.zeros((2 * n, N_LABELS))

    def belief(self, node: np.ndarray) -> np.ndarray:
        return node + np.stack([np.bincount(self.target, self.message[:, k], len(node)) for k in range(N_LABELS)], axis=1)

    def send(self, node: np.ndarray, tables: np.ndarray) -> float:
        """One round of damped messages; returns the largest change."""
        table = tables[self.sort]
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        cavity = self.belief(node)[self.source] - self.message[self.reverse]
        cavity -= cavity.max(axis=1, keepdims=True, initial=-np.inf)
        new = np.log(np.einsum("ij,ijk->ik", np.exp(cavity), np.exp(table)) + 1e-300)
        new -= new.max(axis=1, keepdims=True, initial=-np.inf)
        moved = float(np.abs(new - self.message).max(initial=0))
        self.message = 0.5 * self.message + 0.5 * new
        return moved

    def pairs(self, node: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Beliefs of the two labels of each edge."""
        cavity = self.belief(node)[self.source] - self.message[self.reverse]
        joint = cavity[: self.n, :, None] + cavity[self.n :, None, :] + tables[self.sort]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True, initial=-np.inf))
        return joint / joint.sum(axis=(1, 2), keepdims=True)


def _softmax(b: np.ndarray) -> np.ndarray:
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # features x labels
    tables: np.ndarray  # sorts of edges x labels x labels, log potentials

    def marginals(self, fields: list[Field], rounds: int = 30) -> list[np.ndarray]:
        """Label marginals of every node by loopy sum-product, all fields at once; messages are damped by a half."""
        if not fields:
            return []
        graph = Graph(fields)
        node = graph.features @ self.weights
        for _ in range(rounds):
            if graph.send(node, self.tables) < 1e-3:
                break
        return np.split(_softmax(graph.belief(node)), graph.shift[1:-1])


def _other_form(kind: str, value: str, rng: random.Random) -> str | None:
    """The same datum as no base pattern writes it: what only its earlier mention can explain."""
    d = _digits(value)
    if kind == "phone":
        return rng.choice([d[-10:], f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-7:-4]}-{d[-4:]}"])
    if kind == "card":
        return rng.choice([d[:12], d[:13]])
    if kind == "email":
        return value.partition("@")[0] if EVIDENCE.search(value.partition("@")[0]) else None
    return value if kind == "secret" else None


def _decoy(rng: random.Random) -> str:
    """A token of the same shapes that is no datum."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    return rng.choice(
        [digits(7), digits(10), digits(12), digits(13), f"{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"item.{digits(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), digits(4), f"{digits(1)}.{digits(1)}"]
    )


def _like(form: str, rng: random.Random) -> str:
    """A token of the same shape with other digits and letters."""
    hexadecimal = set(form) <= set("0123456789abcdef")
    other = {True: "0123456789abcdef", False: "abcdefghilmnoprstu"}[hexadecimal]
    return "".join(rng.choice("0123456789") if c.isdigit() and not hexadecimal else rng.choice(other) if c.isalnum() else c for c in form)


def examples(texts: list[str]) -> list[tuple[Field, np.ndarray]]:
    """Fields and labels to learn from: each text as it is, and with other forms of its data and decoys put in far away.

    A datum's other form is labelled as the datum; decoys, one of the same shape for each form and some of them twice, as
    nothing. Token by token the two look alike, so the potentials of skip edges have to tell them apart.
    """
    made = []
    for number, text in enumerate(texts):
        field = build_field(text)
        if field is None:
            continue
        found = seeds(text)
        made.append((field, _labels(field, found)))
        rng = random.Random(number)
        extra: list[tuple[str, str | None]] = []
        for kind, a, b in found[:8]:
            form = _other_form(kind, text[a:b], rng)
            if form:
                extra += [(form, kind), (_like(form, rng), None)]
        decoy = _decoy(rng)
        extra += [(decoy, None)] * rng.choice([1, 2, 2]) + [(_decoy(rng), None)]
        rng.shuffle(extra)
        at, spans, parts = len(text), list(found), [text]
        for token, kind in extra:
            gap = " " + " ".join(rng.choice(("of", "and", "the", "this", "in")) for _ in range(rng.randint(2, 5))) + " "
            parts += [gap, token]
            at += len(gap)
            if kind:
                spans.append((kind, at, at + len(token)))
            at += len(token)
        again = "".join(parts)
        field = build_field(again)
        y = _labels(field, spans)
        seen = {(a, b) for _, a, b in seeds(again)} - {(a, b) for _, a, b in spans}
        if not seen:  # a decoy that happens to fit a pattern would teach the wrong thing
            made.append((field, y))
    return made


def train(texts: list[str], rounds: int = 150) -> Model:
    """Learn weights and potentials by the likelihood of ``examples``, its gradient from the beliefs of loopy message passing.

    Without any field in the sample every label but "nothing" is ruled out, so nothing is added.
    """
    made = examples(texts)
    weights, tables = np.zeros((N_FEATURES, N_LABELS)), np.zeros((3, N_LABELS, N_LABELS))
    if not made:
        weights[-1, 0] = 20
        return Model(weights, tables)
    graph = Graph([f for f, _ in made])
    y = np.concatenate([v for _, v in made])
    target = np.eye(N_LABELS)[y]
    seen = np.zeros_like(tables)
    np.add.at(seen, (graph.sort, y[graph.a], y[graph.b]), 1)
    params = np.concatenate([weights.ravel(), tables.ravel()])
    m = v = np.zeros_like(params)
    size = np.maximum(1, np.bincount(graph.sort, minlength=3))[:, None, None]
    for r in range(1, rounds + 1):
        weights, tables = params[: weights.size].reshape(weights.shape), params[weights.size :].reshape(tables.shape)
        node = graph.features @ weights
        for _ in range(2):  # messages go on from where they were
            graph.send(node, tables)
        expected = np.zeros_like(tables)
        np.add.at(expected, graph.sort, graph.pairs(node, tables))
        g = np.concatenate([(graph.features.T @ (target - _softmax(graph.belief(node))) / len(y) - 1e-4 * weights).ravel(), ((seen - expected) / size - 1e-3 * tables).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(params[: weights.size].reshape(weights.shape), params[weights.size :].reshape(tables.shape))


#: How sure the field must be to add a span.
CONFIDENCE = 0.9


class Taken:
    """Spans that must not be overlapped."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def meets(self, a: int, b: int) -> bool:
        before = bisect_left(self.starts, b)  # spans that start before b
        return before > 0 and self.reach[before - 1] > a


def find_spans(texts: list[str], model: Model) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, whether a base pattern found it) of each text, by start and then kind as listed."""
    base = [base_spans(t) for t in texts]
    fields = [build_field(t) for t in texts]
    full = [i for i, f in enumerate(fields) if f is not None]
    out = [[(*s, True) for s in b] for b in base]
    for i, p in zip(full, model.marginals([fields[i] for i in full])):
        label, sure = p.argmax(axis=1), p.max(axis=1) >= CONFIDENCE
        taken, added, text = Taken([(a, b) for _, a, b in base[i]]), [], texts[i]
        for k in np.flatnonzero(sure & (label > 0)).tolist():
            a, b = fields[i].spans[k]
            kind = LABELS[label[k] - 1]
            while a < b and text[a] in EDGES and not (text[a] == "(" and kind == "phone"):
                a += 1
            while b > a and text[b - 1] in EDGES and not (text[b - 1] == ")" and kind == "phone"):
                b -= 1
            if a == b or not EVIDENCE.search(text, a, b) or taken.meets(a, b):
                continue
            if added and added[-1][0] == kind and kind in ("card", "phone") and text[added[-1][2] : a].strip(" -.") == "" and a - added[-1][2] <= 3:
                added[-1] = (kind, added[-1][1], b, False)
            else:
                added.append((kind, a, b, False))
        if added:
            out[i] = sorted(out[i] + added, key=lambda s: (s[1], LABELS.index(s[0]), s[2]))
    return out


def fit(docs: DataFrame, rows: int = 1000, id_col: str = "doc_id", text_col: str = "text", longest: int = 50_000) -> Model:
    """Train on about ``rows`` (at most twice as many) texts of at most ``longest`` characters with a digit or an at sign,
    chosen by a hash of id and text; longer texts are not learnt from, but searched like all others."""
    held = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= longest))
    return train([r["text"] for r in sample_rows(held, rows, ("text", "id"))])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with pii_spans: kind, start, end (code points, end exclusive) and whether a base pattern found it.

    A null text is empty and has none. Every row and other column stays as it is; a column of this name is replaced; an empty
    table stays empty. Texts are read whole; base patterns are linear in their length.
    """
    ship(docs.sparkSession)
    docs = docs.drop("pii_spans")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = find_spans([x.as_py() or "" for x in part.column(at)], model)
                spans = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in s] for s in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, ARROW_SPANS)], [*part.schema.names, "pii_spans"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pii_spans", SPANS)]))


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``found`` (from ``detect``) with each span of the text replaced by its kind in brackets; where spans overlap, the first stays."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["text"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("text"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["text"].alias("text"), F.greatest(acc["at"], F.least(acc["at"], s["end"])).alias("at")))
    done = F.aggregate("pii_spans", start, step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    return found.withColumn(text_col, F.when(F.size("pii_spans") == 0, text).otherwise(done))
