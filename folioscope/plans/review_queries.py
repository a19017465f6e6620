"""Queries for the review, the reports of a session, the store of chunks, and small rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import cosine_decay, fixed, linear_decay
from ..operators import critique, review, store
from ..operators import entities as ent
from .registry import Tables, query

_REVIEW = """{MENTIONS}, {CLAIMS},
  c AS (SELECT o_orderkey AS paper_id, '[' || CASE WHEN o_custkey IS NULL THEN 'Unknown' ELSE 'Author' || o_custkey END || ' ' || year(o_orderdate) || ']' AS cite FROM orders),
  m AS (SELECT method, count(DISTINCT paper_id) AS n, min(paper_id) AS a, max(paper_id) AS b FROM mentions GROUP BY method ORDER BY n DESC, method LIMIT 10),
  r AS (SELECT claim_id, metric, value, cite FROM claims JOIN c USING (paper_id) WHERE metric IN ('purchase', 'signup') AND value IS NOT NULL AND value <> 0 ORDER BY claim_id LIMIT 8),
  l AS (SELECT doc_id, source, coalesce(n_chars, 0) AS n FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 6),
  w AS (SELECT l_orderkey AS paper, l_linenumber AS n, l_returnflag AS flag, l_partkey AS k FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_quantity > 45 ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 5),
  g AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 6)"""


def cites(t: Tables) -> DataFrame:
    names = F.when(F.col("o_custkey").isNotNull(), F.array(F.concat(F.lit("A. Author"), F.col("o_custkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    return t.orders.select(F.col("o_orderkey").alias("paper_id"), review.citation(names, F.year("o_orderdate")).alias("cite"))


@query(
    "review_sections",
    f"""WITH {_REVIEW}
    SELECT 'methods' AS section, string_agg('- **' || method || '** — used in ' || a || ' to ' || b, chr(10) ORDER BY n DESC, method) AS text FROM m
    UNION ALL SELECT 'results', string_agg('- ' || cite || ': ' || metric || ' (value: ' || CAST(value AS INTEGER) || ')', chr(10) ORDER BY claim_id) FROM r
    UNION ALL SELECT 'limitations', '**Stated limitations:**' || chr(10) || (SELECT string_agg('- ' || source || ': ' || n, chr(10) ORDER BY doc_id) FROM l) || chr(10) || chr(10) || '**Detected weaknesses:**' || chr(10)
      || (SELECT string_agg('- [' || CASE flag WHEN 'R' THEN 'HIGH' ELSE 'MEDIUM' END || '] ' || paper || ': part ' || k, chr(10) ORDER BY paper, n, k) FROM w)
    UNION ALL SELECT 'contradictions', 'No contradictions or complements found.'
    UNION ALL SELECT 'gaps', string_agg('- order ' || o_orderkey || ' (confidence=0.65, status=' || o_orderpriority || ')', chr(10) ORDER BY (SELECT o_totalprice FROM orders AS o WHERE o.o_orderkey = g.o_orderkey) DESC, o_orderkey) FROM g
    UNION ALL SELECT 'conclusion', 'This review covered ' || (SELECT count(*) FROM orders) || ' papers, identifying 0 cross-paper contradictions and ' || (SELECT count(*) FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'P')
      || ' unexplored research gaps. Future work should address the detected gaps to advance the field.'""",
)
def review_sections(t: Tables) -> DataFrame:
    """The sections of a review as they are without a model: a few lines each, chosen in order, or a fixed sentence."""
    c, cap = F.col, review.CAPS
    m = t.mentions.groupBy("method").agg(F.count_distinct("paper_id").alias("n"), F.min("paper_id").alias("a"), F.max("paper_id").alias("b"))
    methods = review.lines_of(m, F.format_string("- **%s** — used in %d to %d", "method", "a", "b"), [c("n").desc(), c("method")], cap["methods"])
    claims = t.claims.where("metric IN ('purchase', 'signup') AND value IS NOT NULL AND value <> 0").join(cites(t), "paper_id")
    results = review.lines_of(claims, F.format_string("- %s: %s (value: %d)", "cite", "metric", F.round("value").cast("int")), [c("claim_id")], cap["results"])
    limits = review.lines_of(t.documents.where("lang = 'en'"), F.concat(F.lit("- "), "source", F.lit(": "), F.coalesce("n_chars", F.lit(0)).cast("string")), [c("doc_id")], cap["limitations"])
    weak = t.lineitem.where("l_returnflag IN ('R', 'A') AND l_quantity > 45")
    weak = review.lines_of(weak, F.format_string("- [%s] %d: part %d", F.when(c("l_returnflag") == "R", "HIGH").otherwise("MEDIUM"), "l_orderkey", "l_partkey"), [c("l_orderkey"), c("l_linenumber"), c("l_partkey")], cap["weaknesses"])
    open_ = t.orders.where("o_orderpriority LIKE '1%' AND o_orderstatus = 'P'")
    gaps = review.lines_of(open_, F.format_string("- order %d (confidence=0.65, status=%s)", "o_orderkey", "o_orderpriority"), [c("o_totalprice").desc(), c("o_orderkey")], cap["gaps"])
    none = review.lines_of(t.orders.where("false"), F.lit(""), [c("o_orderkey")], cap["contradictions"])
    end = t.orders.agg(F.count(F.lit(1)).alias("n"), F.count_if((c("o_orderpriority").like("1%")) & (c("o_orderstatus") == "P")).alias("g")).select(F.lit("conclusion").alias("section"), F.format_string(review.CONCLUSION, "n", F.lit(0), "g").alias("text"))
    found = [review.section("methods", ("", methods)), review.section("results", ("", results)), review.section("limitations", ("**Stated limitations:**", limits), ("**Detected weaknesses:**", weak)), review.section("contradictions", ("**Contradictions:**", none)), review.section("gaps", ("", gaps)), end]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


@query(
    "reference_list",
    """WITH a AS (SELECT l_orderkey AS paper_id, list_sort(list(DISTINCT 'S. ' || l_suppkey)) AS names FROM lineitem GROUP BY 1)
    SELECT paper_id, '[' || paper_id || '] ' || array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END || ' (' || year(o_orderdate) || '). ' || o_orderpriority || '. ' || CASE o_orderstatus WHEN 'F' THEN '' ELSE o_orderstatus END || '.' AS line
    FROM a JOIN orders ON o_orderkey = paper_id""",
)
def reference_list(t: Tables) -> DataFrame:
    names = t.lineitem.groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("S. "), F.col("l_suppkey").cast("string")))).alias("names"))
    rows = names.join(t.orders, F.col("o_orderkey") == F.col("paper_id"))
    venue = F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))
    return rows.select("paper_id", review.reference(F.col("paper_id"), F.col("names"), F.year("o_orderdate"), F.col("o_orderpriority"), venue).alias("line"))


@query(
    "session_report",
    """SELECT 'reader' AS agent, count(*) AS n_items, 0::BIGINT AS n_high, count(DISTINCT doc_id) AS n_papers FROM documents
    UNION ALL SELECT 'comparator', count(*), count(*) FILTER (l_returnflag = 'R'), count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'critic', count(*), count(*) FILTER (quality = 0), count(DISTINCT doc_id) FROM labels
    UNION ALL SELECT 'gap_detector', count(*), count(*) FILTER (o_orderpriority LIKE '1%'), count(DISTINCT o_custkey) FROM orders""",
)
def session_report(t: Tables) -> DataFrame:
    high = lambda c, yes: F.when(c == yes, "HIGH").otherwise("LOW")
    return review.session_report(
        t.documents.select(F.col("doc_id").alias("paper_id")), t.lineitem.select(high(F.col("l_returnflag"), "R").alias("severity"), F.col("l_orderkey").alias("paper_a")),
        t.labels.select(high(F.col("quality"), 0).alias("severity"), F.col("doc_id").alias("paper_id")), t.orders.select(high(F.substring("o_orderpriority", 1, 1), "1").alias("priority"), F.col("o_custkey").alias("paper_a")),
    )


_STORE = """d AS (SELECT doc_id, lang, text, CASE doc_id % 5 WHEN 0 THEN 'section' WHEN 1 THEN 'claim' WHEN 2 THEN 'limitation' WHEN 3 THEN 'entity' ELSE 'other' END AS kind FROM documents),
  r AS (SELECT *, CASE kind WHEN 'section' THEN 'paper_sections' WHEN 'entity' THEN 'entities_global' ELSE 'claims_and_findings' END AS collection, substr(sha256(coalesce(text, '')), 1, 12) AS chunk_id FROM d WHERE kind <> 'other')"""


def chunk_store(t: Tables) -> DataFrame:
    """Chunks of documents put into an empty store and, with a longer text each second one, again."""
    kind = F.when(F.col("doc_id") % 5 == 0, "section").when(F.col("doc_id") % 5 == 1, "claim").when(F.col("doc_id") % 5 == 2, "limitation").when(F.col("doc_id") % 5 == 3, "entity").otherwise("other")
    chunks = t.documents.select(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12).alias("chunk_id"), F.col("lang").alias("paper_id"), F.array(F.lit(1.0)).alias("embedding"), kind.alias("chunk_type"), F.lit("first").alias("display_text"), "doc_id")
    empty = store.routed(chunks.where("false"))
    once = store.upsert_chunks(empty, chunks.drop("doc_id"))
    return store.upsert_chunks(once, chunks.where("doc_id % 2 = 0").withColumn("display_text", F.lit("second")).drop("doc_id"))


@query("chunk_store_upsert", f"WITH {_STORE} SELECT collection, chunk_id, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'second' ELSE 'first' END AS document FROM r GROUP BY 1, 2")
def chunk_store_upsert(t: Tables) -> DataFrame:
    return chunk_store(t).select("collection", "chunk_id", "document")


@query(
    "chunk_store_delete",
    f"""WITH {_STORE}, p AS (SELECT collection, chunk_id, CASE WHEN bool_or(doc_id % 2 = 0) THEN max(lang) FILTER (doc_id % 2 = 0) ELSE max(lang) END AS lang FROM r GROUP BY 1, 2)
    SELECT collection, count(*) FILTER (lang = 'en') AS n_deleted, count(*) FILTER (lang IS DISTINCT FROM 'en') AS n_left FROM p GROUP BY collection HAVING count(*) FILTER (lang = 'en') > 0""",
)
def chunk_store_delete(t: Tables) -> DataFrame:
    """What deleting one paper's chunks takes from each collection, and what stays."""
    left, gone = store.without_paper(chunk_store(t), "en")
    rest = store.counts_of_collections(left).withColumnRenamed("n", "n_left")
    return gone.withColumnRenamed("n", "n_deleted").join(rest, "collection", "left").select("collection", "n_deleted", F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query(
    "schedules",
    """SELECT o_orderkey, floor(CASE WHEN o_custkey >= 500 THEN 0.05 ELSE 0.3 + o_custkey / 500.0 * (0.05 - 0.3) END * 1000000 + 0.5) / 1000000 AS epsilon, floor((0.2 + 0.5 * (1 + cos(pi() * o_custkey / 1500)) * (1.2 - 0.2)) * 1000000 + 0.5) / 1000000 AS alpha,
    floor(ln(1 + o_custkey) * 1000000 + 0.5) / 1000000 AS squeezed, floor((exp(ln(1 + o_custkey)) - 1) + 0.5) AS back FROM orders""",
)
def schedules(t: Tables) -> DataFrame:
    """Rates that decay with the episode, and counts on a logarithmic scale and back."""
    ep = F.col("o_custkey")
    log = F.log1p(ep)
    return t.orders.select("o_orderkey", fixed(linear_decay(ep, 0.3, 0.05, 500), 6).alias("epsilon"), fixed(cosine_decay(ep, 1.2, 0.2, 1500), 6).alias("alpha"), fixed(log, 6).alias("squeezed"), F.floor(F.expm1(log) + 0.5).cast("double").alias("back"))


_LIM = "the and for are that this with have been from they which their will not can but our more also than such its may each when these use".split()


@query(
    "statement_tokens",
    f"""WITH w AS (SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS w FROM documents)
    SELECT doc_id, array_to_string(list_sort(list_filter(w, lambda x: regexp_full_match(x, '[a-z][a-z0-9]{{2,}}') AND x NOT IN ({", ".join(f"'{w}'" for w in _LIM)}))), ' ') AS tokens, len(list_filter(w, lambda x: length(x) >= 4))::INTEGER AS n_long FROM w""",
)
def statement_tokens(t: Tables) -> DataFrame:
    """Documents cut into words as limitations are, and how many long words they have."""
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.array_join(F.array_sort(tx.limitation_tokens(text)), " ").alias("tokens"), F.size(tx.long_words(text)).alias("n_long"))


@query("claims_texts", "WITH {CLAIMS} SELECT paper_id, sha256(lower(string_agg(metric || ' Of ' || coalesce(dataset, 0), ' ' ORDER BY claim_id))) AS hash FROM claims GROUP BY paper_id")
def claims_texts(t: Tables) -> DataFrame:
    """All claims of a paper as one text, by its hash."""
    rows = t.claims.select("paper_id", "claim_id", F.concat_ws(" Of ", "metric", F.coalesce("dataset", F.lit(0)).cast("string")).alias("text"))
    return critique.claims_text(rows, "paper_id", "text", ["claim_id"]).select("paper_id", F.sha2("claims_text", 256).alias("hash"))


@query(
    "first_mentions",
    """WITH {MENTIONS}, f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, method ORDER BY pos, part_id, task, price) AS n, max(confidence) OVER (PARTITION BY paper_id, method) AS c FROM mentions), s AS (SELECT paper_id, method, list_sort(list(DISTINCT task)) AS tasks FROM mentions GROUP BY 1, 2)
    SELECT paper_id, method, task, c AS confidence, array_to_string(list_filter(tasks, lambda x: x <> task), ',') AS also FROM f JOIN s USING (paper_id, method) WHERE n = 1""",
)
def first_mentions(t: Tables) -> DataFrame:
    found = ent.first_mentions(t.mentions, ["paper_id", "method"], "task", "confidence", ["pos", "part_id", "task", "price"])
    return found.select("paper_id", "method", "task", "confidence", F.array_join("also_in_sections", ",").alias("also"))


@query(
    "entity_index",
    """WITH {MENTIONS}, e AS (SELECT paper_id, unnest(['method', 'dataset']) AS kind, unnest([method, dataset]) AS entity, pos, part_id, price FROM mentions), l AS (SELECT paper_id, kind, lower(entity) AS k, string_agg(part_id, '+' ORDER BY pos, part_id, price) AS m FROM e GROUP BY 1, 2, 3)
    SELECT paper_id, string_agg(k || ':' || m, ';' ORDER BY k) FILTER (kind = 'method') AS methods, string_agg(k || ':' || m, ';' ORDER BY k) FILTER (kind = 'dataset') AS datasets FROM l GROUP BY paper_id""",
)
def entity_index(t: Tables) -> DataFrame:
    """Each paper's entities with all their mentions, nested; shown as text."""
    kinds = F.inline(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(k).alias("text")) for k in ("method", "dataset"))))
    rows = t.mentions.repartition("paper_id").select("paper_id", "pos", "part_id", "price", kinds)  # sent once, before a mention becomes two rows
    nested = ent.entity_index(rows, ["method", "dataset"], ["part_id"], ["pos", "part_id", "price"])
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(F.transform(e["value"], lambda x: x["part_id"].cast("string")), "+"))), ";")
    return nested.select("paper_id", shown("method").alias("methods"), shown("dataset").alias("datasets"))
