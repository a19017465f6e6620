"""What DuckDB must find for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS, SYMBOLS

#: [\x20\x09-\x0D] in DuckDB's regular expressions.
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"

_VECTORS = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


def _rules() -> str:
    passed = []
    for r in RULES:
        value = r.measure
        if "/" in r.measure:
            top, bottom = (x.strip() for x in r.measure.split("/"))
            value = f"(CAST({top} AS DOUBLE) / NULLIF({bottom}, 0))"
        if r.low is not None:
            passed.append(f"coalesce({value} >= {r.low}, true)")
        if r.high is not None:
            passed.append(f"coalesce({value} <= {r.high}, true)")
    return " AND ".join(passed)


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT r, sum(least(8, i - before)) AS n FROM (SELECT r, i, lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i) AS before FROM dup) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({stop}))) AS n_stop_words
  FROM d LEFT JOIN cover USING (r)
), f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept
FROM f
"""


def _suffixes() -> str:
    """Byte strings are compared as hexadecimal text; spans come from a gap-and-island sum."""
    return """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - 99, 0))) AS i FROM d),
w AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS k FROM p),
o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
a AS (SELECT doc_id, i, i - lag(i, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM o WHERE n > 1),
s AS (SELECT doc_id, i, sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM a),
e AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY doc_id, span),
l AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM e GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0) AS removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN starts IS NULL THEN x
              ELSE array_to_string(list_transform(range(0, len(starts) + 1),
                lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE CAST(2 * ends[CAST(j AS INT)] + 1 AS BIGINT) END,
                     CASE WHEN j = len(starts) THEN len(x) ELSE 2 * starts[CAST(j + 1 AS INT)] END
                     - CASE WHEN j = 0 THEN 0 ELSE 2 * ends[CAST(j AS INT)] END)), '') END AS kept
  FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(kept)) AS kept_sha256
FROM k
"""


def _substrings() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
g AS (SELECT doc_id, i, md5_number(list_aggregate(w[i:i + 19], 'string_agg', ' ')) AS k FROM p),
o AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM o),
gone AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


#: crc32 of the decimal doc_id: eight steps a byte, the polynomial reflected.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)), xor(c, b)), 4294967295))"""


def _runs() -> str:
    return rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w, {_CRC} AS h FROM documents),
s AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d),
t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(n), lambda i: w[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END AS BIGINT)]) END AS w FROM s),
o AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM t),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM o AS x JOIN o AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
k AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k AS x WHERE x.doc_id = k.doc_id AND x.q < k.q AND x.s <= k.s AND x.s + x.l >= k.s + k.l)),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
best AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS x WHERE x.doc_id = r.doc_id
         AND (x.l * r.q > r.l * x.q OR x.l * r.q = r.l * x.q AND (x.s < r.s OR x.s = r.s AND x.q < r.q)))),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM o ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _near() -> str:
    words = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * i >= 80 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id) USING (doc_id)
"""


ORACLES: dict[str, str] = {
    "op12_ngram_join": _near(),
    "op11_periodic_runs": _runs(),
    "op3_substring_dedup": _substrings(),
    "op4_vector_search": _VECTORS,
    "op5_quality_rules": _quality(),
    "op8_suffix_array": _suffixes(),
}
