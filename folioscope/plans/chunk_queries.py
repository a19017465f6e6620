"""Queries over chunks, collections and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunks as op
from .registry import Tables, query

_CHUNKS = """chunks AS (
  SELECT 'section' AS chunk_type, doc_id AS paper_id, text, lang AS section, 0 AS pos FROM documents
  UNION ALL SELECT 'figure', page_id, url, NULL, 0 FROM pages
  UNION ALL SELECT 'claim', item_id, text, 'Results', 0 FROM benchmark
  UNION ALL SELECT 'limitation', conv_id, text, role, turn FROM conversations)"""
_ROUTE = "CASE chunk_type WHEN 'claim' THEN 'claims_and_findings' WHEN 'limitation' THEN 'claims_and_findings' WHEN 'entity' THEN 'entities_global' ELSE 'paper_sections' END"


def chunks(t: Tables) -> DataFrame:
    make = lambda df, kind, paper, text, section, pos: df.select(F.lit(kind).alias("chunk_type"), F.col(paper).alias("paper_id"), F.col(text).alias("text"), section.alias("section"), pos.cast("long").alias("pos"))
    zero = F.lit(0)
    return op.union_chunks(
        make(t.documents, "section", "doc_id", "text", F.col("lang"), zero),
        make(t.pages, "figure", "page_id", "url", F.lit(None).cast("string"), zero),
        make(t.benchmark, "claim", "item_id", "text", F.lit("Results"), zero),
        make(t.conversations, "limitation", "conv_id", "text", F.col("role"), F.col("turn")),
    )


@query("chunk_ids", "SELECT conv_id, turn, substr(sha256(conv_id || '::' || coalesce(text, '') || '::' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)), 1, 12) AS chunk_id FROM conversations")
def chunk_ids(t: Tables) -> DataFrame:
    """Ids of the turns of conversations; the place of a turn in its conversation tells equal ones apart."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return t.conversations.select("conv_id", "turn", op.chunk_id(F.col("conv_id"), F.coalesce("text", F.lit("")), place).alias("chunk_id"))


@query("peek_collections", "WITH " + _CHUNKS + f", r AS (SELECT {_ROUTE} AS collection, chunk_type, paper_id, pos FROM chunks) SELECT collection, chunk_type, paper_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY chunk_type, paper_id, pos) AS n FROM r) WHERE n <= 3")
def peek_collections(t: Tables) -> DataFrame:
    """The first three chunks of each collection."""
    rows = chunks(t).select(op.route(F.col("chunk_type")).alias("collection"), "chunk_type", "paper_id", "pos")
    first = F.row_number().over(Window.partitionBy("collection").orderBy("chunk_type", "paper_id", "pos"))
    return rows.withColumn("n", first).where("n <= 3").drop("n")


@query(
    "chunk_union_routing",
    "WITH " + _CHUNKS + f""" SELECT substr(sha256(paper_id || '::' || text || '::' || pos), 1, 12) AS chunk_id, chunk_type, {_ROUTE} AS collection, paper_id, coalesce(section, '') AS section,
      CASE chunk_type WHEN 'limitation' THEN 'limitation' WHEN 'future_work' THEN 'future work' ELSE 'claim' END || ' in ' || coalesce(section, '') || ':' || chr(10) || text AS embed_text FROM chunks""",
)
def chunk_union_routing(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    text = op.claim_text(F.col("chunk_type"), F.lit(None).cast("string"), F.col("section"), F.lit(None).cast("string"), F.col("text"), none)
    return chunks(t).select(op.chunk_id(F.col("paper_id"), F.col("text"), F.col("pos")).alias("chunk_id"), "chunk_type", op.route(F.col("chunk_type")).alias("collection"), "paper_id", F.coalesce("section", F.lit("")).alias("section"), text.alias("embed_text"))


@query("collection_counts", "WITH " + _CHUNKS + f", n AS (SELECT {_ROUTE} AS collection FROM chunks) SELECT c.collection, count(n.collection) AS n FROM (VALUES ('claims_and_findings'), ('entities_global'), ('paper_sections')) AS c(collection) LEFT JOIN n USING (collection) GROUP BY 1")
def collection_counts(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(n,) for n in sorted(set(op.ROUTES.values()))], "collection string")
    counts = chunks(t).groupBy(op.route(F.col("chunk_type")).alias("collection")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))


@query("store_status", "WITH " + _CHUNKS + f" SELECT coalesce({_ROUTE.replace('CASE', 'CASE')}, 'total') AS collection, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM chunks GROUP BY ROLLUP ({_ROUTE})")
def store_status(t: Tables) -> DataFrame:
    rows = chunks(t).select(op.route(F.col("chunk_type")).alias("collection"), F.length("text").alias("c"))
    return rows.rollup("collection").agg(F.count(F.lit(1)).alias("n"), F.sum("c").cast("long").alias("n_chars")).select(F.coalesce("collection", F.lit("total")).alias("collection"), "n", "n_chars")


@query("filter_language", "WITH " + _CHUNKS + " SELECT paper_id, chunk_type, pos FROM chunks WHERE chunk_type = 'limitation' AND section <> 'system' AND pos >= 1 AND (paper_id < 20 OR paper_id IN (30, 31))")
def filter_language(t: Tables) -> DataFrame:
    where = {"$and": [{"chunk_type": {"$eq": "limitation"}}, {"section": {"$ne": "system"}}, {"pos": {"$gte": 1}}, {"$or": [{"paper_id": {"$lt": 20}}, {"paper_id": {"$in": [30, 31]}}]}]}
    return chunks(t).where(op.compile_filter(where)).select("paper_id", "chunk_type", "pos")


_HALVES = "old AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT user_id, event_type, max(value) AS v FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0 GROUP BY 1, 2)"


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events
    top = lambda df: df.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return top(e.where("event_id % 2 = 0")), top(e.where("event_id % 2 = 1 AND user_id % 3 = 0"))


@query("upsert_keep_first", f"WITH {_HALVES} SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (user_id, event_type)")
def upsert_keep_first(t: Tables) -> DataFrame:
    return op.upsert(*halves(t), ["user_id", "event_type"], last=False)


@query("upsert_keep_last", f"WITH {_HALVES} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (user_id, event_type)")
def upsert_keep_last(t: Tables) -> DataFrame:
    return op.upsert(*halves(t), ["user_id", "event_type"], last=True)


@query("delete_refresh", f"WITH {_HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new)")
def delete_refresh(t: Tables) -> DataFrame:
    return op.refresh(*halves(t), "user_id")


@query(
    "array_merge_update",
    """WITH {MENTIONS} SELECT lower(method) AS entity_id, array_to_string(list_sort(list(DISTINCT paper_id)), ',') AS papers FROM mentions GROUP BY 1""",
)
def array_merge_update(t: Tables) -> DataFrame:
    m = t.mentions.select(F.lower("method").alias("entity_id"), F.col("paper_id").alias("p"), (F.col("paper_id") % 2).alias("part"))
    side = lambda i: m.where(F.col("part") == i).groupBy("entity_id").agg(F.collect_set("p").alias("papers"))
    return op.merge_arrays(side(0), side(1), ["entity_id"], "papers").withColumn("papers", F.array_join("papers", ","))


@query("append_log", "SELECT count(*) AS n, count(DISTINCT user_id) AS n_sessions, max(event_id) AS last FROM (SELECT * FROM events WHERE event_id % 2 = 0 UNION ALL SELECT * FROM events WHERE event_id % 2 = 1)")
def append_log(t: Tables) -> DataFrame:
    log = t.events.where("event_id % 2 = 0").unionByName(t.events.where("event_id % 2 = 1"))
    return log.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_sessions"), F.max("event_id").alias("last"))


@query("registry_upsert", "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def registry_upsert(t: Tables) -> DataFrame:
    return op.insert_keep_first(t.documents.select(F.sha2("text", 256).alias("hash"), "doc_id"), ["hash"], ["doc_id"])


@query("schema_evolve", "SELECT doc_id, lang, 'unknown' AS venue, 0.0::DOUBLE AS coverage_gain FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, source, 0.5::DOUBLE FROM documents WHERE doc_id % 2 = 1")
def schema_evolve(t: Tables) -> DataFrame:
    """Rows of an older schema get the new columns' defaults."""
    from ..sources.catalog import evolve

    old = t.documents.where("doc_id % 2 = 0").select("doc_id", "lang")
    new = t.documents.where("doc_id % 2 = 1").select("doc_id", "lang", F.col("source").alias("venue"), F.lit(0.5).alias("coverage_gain"))
    return op.union_chunks(evolve(old, {"venue": F.lit("unknown"), "coverage_gain": F.lit(0.0)}), new)


@query(
    "hash_dedup_status",
    """WITH d AS (SELECT doc_id, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents), r AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE doc_id < 100)
    SELECT doc_id, CASE WHEN r.hash IS NOT NULL THEN 'registered' WHEN n > 1 THEN 'batch_duplicate' ELSE 'new' END AS status FROM d LEFT JOIN r USING (hash) WHERE doc_id >= 100""",
)
def hash_dedup_status(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))
    firsts = d.groupBy("hash").agg(F.min("doc_id").alias("first"))  # pre-aggregated, so a text with many copies is no hot window
    known = d.where("doc_id < 100").select("hash").distinct().withColumn("known", F.lit(True))
    joined = d.where("doc_id >= 100").join(firsts, "hash").join(known, "hash", "left")
    status = F.when(F.col("known"), "registered").when(F.col("doc_id") != F.col("first"), "batch_duplicate").otherwise("new")
    return joined.select("doc_id", status.alias("status"))


@query("already_processed", "SELECT count(*) AS n_pending, min(o_orderkey) AS first FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def already_processed(t: Tables) -> DataFrame:
    done = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(done, "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("n_pending"), F.min("o_orderkey").alias("first"))


@query(
    "checkpoint_pending",
    """WITH s AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 60) SELECT u.user_id, string_agg(k.kind, ',' ORDER BY k.kind) AS pending FROM (SELECT DISTINCT user_id FROM events) AS u
    CROSS JOIN (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS k(kind) ANTI JOIN s ON s.user_id = u.user_id AND s.event_type = k.kind GROUP BY 1""",
)
def checkpoint_pending(t: Tables) -> DataFrame:
    """Stages of each item whose output is missing."""
    steps = F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view")))
    done = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))).alias("done"))
    left = F.array_sort(F.array_except(steps, "done"))
    return done.where(F.size(left) > 0).select("user_id", F.array_join(left, ",").alias("pending"))


@query(
    "corpus_scan_prefer",
    """SELECT paper, doc_id, coalesce(title, 'untitled') AS title FROM (SELECT doc_id // 3 AS paper, doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS title,
      row_number() OVER (PARTITION BY doc_id // 3 ORDER BY CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n = 1""",
)
def corpus_scan_prefer(t: Tables) -> DataFrame:
    """One row for each paper: the preferred kind of file, then the first; missing fields get their default."""
    rows = t.documents.select(F.expr("doc_id div 3").alias("paper"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("title"), F.when(F.col("source").isin("src0", "src1"), 0).otherwise(1).alias("kind"))
    return op.insert_keep_first(rows, ["paper"], ["kind", "doc_id"]).select("paper", "doc_id", F.coalesce("title", F.lit("untitled")).alias("title"))


@query(
    "pseudo_sections",
    """SELECT 'section' AS kind, doc_id AS id, length(text)::INTEGER AS n FROM documents WHERE trim(text) <> '' UNION ALL
    SELECT 'table', page_id, length(url || ' | ' || regexp_extract(html, '(?s)<title>(.*?)</title>', 1))::INTEGER FROM pages UNION ALL SELECT 'figure', item_id, length(text)::INTEGER FROM benchmark WHERE length(text) > 20""",
)
def pseudo_sections(t: Tables) -> DataFrame:
    """Sections, tables (caption and cells joined) and figures as rows of one kind."""
    row = lambda df, kind, key, text: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.length(text).alias("n"))
    table = F.array_join(F.array("url", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)), " | ")
    return op.union_chunks(
        row(t.documents.where(F.trim("text") != ""), "section", "doc_id", F.col("text")),
        row(t.pages, "table", "page_id", table),
        row(t.benchmark.where(F.length("text") > 20), "figure", "item_id", F.col("text")),
    )


@query(
    "positional_override",
    """WITH a AS (SELECT lang || '/' || source AS owner, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents),
    b AS (SELECT owner, text, row_number() OVER (PARTITION BY owner ORDER BY item_id) AS n FROM (SELECT DISTINCT owner FROM a) CROSS JOIN benchmark WHERE item_id % 7 = length(owner) % 7)
    SELECT coalesce(a.owner, b.owner) AS owner, CAST(coalesce(a.n, b.n) AS INTEGER) AS n, sha256(coalesce(b.text, a.text)) AS hash, b.text IS NOT NULL AS replaced FROM a FULL JOIN b ON a.owner = b.owner AND a.n = b.n""",
)
def positional_override(t: Tables) -> DataFrame:
    """The i-th better version of an owner replaces its i-th row; further ones are appended. Rows are numbered within an owner."""
    nth = lambda df, key, name: df.select("owner", F.col("text").alias(name), F.row_number().over(Window.partitionBy("owner").orderBy(key)).alias("n"))
    docs = t.documents.withColumn("owner", F.concat_ws("/", "lang", "source")).where("lang IS NOT NULL AND source IS NOT NULL")
    owners = docs.select("owner", (F.length("owner") % 7).alias("k")).distinct()
    better = t.benchmark.withColumn("k", (F.col("item_id") % 7).cast("int")).join(owners, "k")
    both = nth(docs, "doc_id", "a").join(nth(better, "item_id", "b"), ["owner", "n"], "full")
    return both.select("owner", "n", F.sha2(F.coalesce("b", "a"), 256).alias("hash"), F.col("b").isNotNull().alias("replaced"))


@query(
    "longest_text_per_cluster",
    "SELECT source, doc_id, length(text)::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1",
)
def longest_text_per_cluster(t: Tables) -> DataFrame:
    best = t.documents.groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.select("source", (-F.col("m.d")).alias("doc_id"), F.col("m.n").alias("n"))


@query("year_range", "SELECT o_orderpriority AS topic, year(min(o_orderdate)) AS first_year, year(max(o_orderdate)) AS last_year FROM orders GROUP BY 1")
def year_range(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("topic")).agg(F.year(F.min("o_orderdate")).cast("long").alias("first_year"), F.year(F.max("o_orderdate")).cast("long").alias("last_year"))


@query(
    "table_counts_state_vector",
    """WITH n AS (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'citations', 0)
    SELECT name, n, floor(ln(1 + n) * 1000000 + 0.5) / 1000000 AS feature, least(n / 20.0, 1.0)::DOUBLE AS clipped FROM n""",
)
def table_counts_state_vector(t: Tables) -> DataFrame:
    """A log count for each table, 0 for one that does not exist."""
    from ..functions.scores import fixed

    count = lambda name, df: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    rows = op.union_chunks(count("documents", t.documents), count("events", t.events), count("conversations", t.conversations), t.spark.createDataFrame([("citations", 0)], "name string, n long"))
    return rows.select("name", "n", fixed(F.log1p("n"), 6).alias("feature"), F.least(F.col("n") / 20.0, F.lit(1.0)).alias("clipped"))


@query("cache_stats", "WITH d AS (SELECT lower(p_name) AS k, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) > 1 AS hit FROM part) SELECT count(*) FILTER (hit) AS resolved, count(*) FILTER (NOT hit) AS unresolved, coalesce(avg(hit::INT), 0) AS hit_rate FROM d")
def cache_stats(t: Tables) -> DataFrame:
    names = t.part.groupBy(F.lower("p_name").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = names.agg(F.sum(F.col("n") - 1).alias("resolved"), F.count(F.lit(1)).alias("unresolved"))
    return total.withColumn("hit_rate", F.coalesce(F.col("resolved") / (F.col("resolved") + F.col("unresolved")), F.lit(0.0)))
