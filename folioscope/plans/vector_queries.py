"""Queries over vectors, bandits and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import fixed, sigmoid, softmax, weighted
from ..operators import ranking, vectors as op
from .registry import Tables, query

_DOT = "floor(list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) * 1000000 + 0.5) / 1000000"
_Q = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"


def probe(t: Tables) -> list[float]:
    """The query vector: one row, a bounded read."""
    return t.embeddings.where("vec_id = 0").select("embedding").first()[0]


@query("knn_topk", f"WITH {_Q} SELECT vec_id, label, {_DOT.format('embedding', 'q')} AS similarity FROM embeddings, q WHERE label <> 3 ORDER BY similarity DESC, vec_id LIMIT 20")
def knn_topk(t: Tables) -> DataFrame:
    return op.nearest(t.embeddings, probe(t), 20, F.col("label") != 3).select("vec_id", "label", "similarity")


@query("knn_per_collection_union", f"WITH {_Q}, s AS (SELECT vec_id, label, {_DOT.format('embedding', 'q')} AS similarity FROM embeddings, q) SELECT vec_id, label, similarity, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS n FROM s) WHERE n <= 5")
def knn_per_collection_union(t: Tables) -> DataFrame:
    return op.nearest_per_group(t.embeddings, probe(t), 5, "label").select("vec_id", "label", "similarity", "rank")


@query(
    "rerank_sigmoid",
    f"""WITH {_Q}, s AS (SELECT vec_id, {_DOT.format('embedding', 'q')} AS similarity, (vec_id % 5) / 4.0 AS confidence FROM embeddings, q), c AS (SELECT * FROM s ORDER BY similarity DESC, vec_id LIMIT 50),
    r AS (SELECT vec_id, floor(1 / (1 + exp(-similarity * 4)) * CASE WHEN confidence = 0 THEN 1 ELSE confidence END * 10000 + 0.5) / 10000 AS score FROM c)
    SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM r ORDER BY score DESC, vec_id LIMIT 5""",
)
def rerank_sigmoid(t: Tables) -> DataFrame:
    """Two stages: nearest neighbours, then a score weighted by confidence (0 counts as 1)."""
    from pyspark.sql import Window

    found = op.nearest(t.embeddings, probe(t), 50)
    score = fixed(weighted(sigmoid(F.col("similarity") * 4), (F.col("vec_id") % 5) / 4.0))
    top = found.select("vec_id", score.alias("score")).orderBy(F.col("score").desc(), "vec_id").limit(5)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "vec_id")))


@query("knn_join_resolution", f"WITH p AS (SELECT a.label, a.vec_id AS left_id, b.vec_id AS right_id, {_DOT.format('a.embedding', 'b.embedding')} AS similarity FROM embeddings AS a JOIN embeddings AS b USING (label) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY similarity DESC, right_id) AS n FROM p WHERE similarity >= 0.1) SELECT label, left_id, right_id, similarity, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 3")
def knn_join_resolution(t: Tables) -> DataFrame:
    v = t.embeddings
    return op.knn_join(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "label", 3, 0.1)


_PAIRS = f"pairs AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, {_DOT.format('a.embedding', 'b.embedding')} AS similarity FROM embeddings AS a JOIN embeddings AS b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query("similarity_pairs_threshold", f"WITH {_PAIRS} SELECT * FROM pairs WHERE similarity >= 0.25")
def similarity_pairs_threshold(t: Tables) -> DataFrame:
    return op.similar_within(t.embeddings, "label", 0.25)


@query("greedy_clusters")
def greedy_clusters(t: Tables) -> DataFrame:
    return ranking.leader_clusters(op.similar_within(t.embeddings, "label", 0.2), t.embeddings, "label", "vec_id")


#: The cosine distance up to which two limitations belong together, and how many nearest ones a leader sees.
_TOGETHER, _SEEN = 0.35, 10


@query("limitation_clusters")
def limitation_clusters(t: Tables) -> DataFrame:
    """Clusters of limitations by meaning, across all papers: in order, one that is not taken leads and takes what is not taken
    among its ten nearest (itself included) within the cosine distance. Vectors have unit length."""
    from pyspark.sql import Window

    from ..operators.greedy import leaders
    from ..operators.metric import close_pairs

    pairs = close_pairs(t.embeddings, "vec_id", "embedding", (2 * _TOGETHER) ** 0.5)
    nearest = Window.partitionBy("a").orderBy("distance", "b")
    turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance")
    both = pairs.select(F.inline(F.array(F.struct("a", "b", "distance"), turned)))  # pairs are made once
    takes = both.withColumn("place", F.row_number().over(nearest)).where(F.col("place") < _SEEN)
    return leaders(t.embeddings, "vec_id", takes)


@query(
    "embedding_pairs_in_range",
    f"SELECT a.vec_id AS a, b.vec_id AS b, {_DOT.format('a.embedding', 'b.embedding')} AS similarity FROM embeddings AS a JOIN embeddings AS b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4",
)
def embedding_pairs_in_range(t: Tables) -> DataFrame:
    """All pairs at a similarity of 0.4 or more, of whatever label: found within 0.001 more by distance, then tested exactly."""
    from ..operators.metric import close_pairs

    near = close_pairs(t.embeddings, "vec_id", "embedding", (2 * (1 - 0.399)) ** 0.5, dots=True)
    return near.where("a < b AND dot >= 0.4").select("a", "b", fixed(F.col("dot"), 6).alias("similarity"))


@query(
    "softmax_masked",
    f"""WITH {_Q}, s AS (SELECT label, max({_DOT.format('embedding', 'q')}) FILTER (vec_id <> 0) AS s FROM embeddings, q GROUP BY label)
    SELECT label, floor(exp(s - max(s) OVER ()) / sum(exp(s - (SELECT max(s) FROM s WHERE label NOT IN (2, 5)))) OVER () * exp(0) * 1000000 + 0.5) / 1000000 AS p FROM s WHERE label NOT IN (2, 5)""",
)
def softmax_masked(t: Tables) -> DataFrame:
    q = F.array(*(F.lit(x) for x in probe(t)))
    best = t.embeddings.groupBy("label").agg(F.max(F.when(F.col("vec_id") != 0, fixed(op.dot(F.col("embedding"), q), 6))).alias("s"))
    arms = best.agg(F.array_sort(F.collect_list(F.struct("label", F.when(~F.col("label").isin(2, 5), F.col("s")).alias("s")))).alias("arms"))
    p = softmax(F.transform("arms", lambda a: a["s"]))
    rows = arms.select(F.explode(F.arrays_zip(F.transform("arms", lambda a: a["label"]).alias("label"), p.alias("p"))).alias("x"))
    return rows.select("x.label", fixed(F.col("x.p"), 6).alias("p")).where("p IS NOT NULL")


@query(
    "linucb_sufficient_stats",
    """WITH x AS (SELECT label, (vec_id % 7) / 7.0 AS r, unnest(range(1, 65)) AS i, embedding FROM embeddings), y AS (SELECT label, r, i, unnest(range(1, 65)) AS j, embedding FROM x)
    SELECT label, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, floor(sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE) * 1000000 + 0.5) / 1000000 AS a,
      floor(sum(CASE WHEN i = j THEN embedding[i]::DOUBLE * r END) * 1000000 + 0.5) / 1000000 AS b FROM y WHERE i <= j GROUP BY 1, 2, 3""",
)
def linucb_sufficient_stats(t: Tables) -> DataFrame:
    rows = t.embeddings.select("label", F.col("embedding").alias("x"), ((F.col("vec_id") % 7) / 7.0).alias("r"))
    return ranking.linucb_statistics(rows, "label", "x", "r").select("label", "i", "j", fixed(F.col("a"), 6).alias("a"), fixed(F.col("b"), 6).alias("b"))


@query("linucb_rank")
def linucb_rank(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").alias("x"), ((F.col("vec_id") % 7) / 7.0).alias("r"))
    models = ranking.linucb_models(rows, "label", "x", "r")
    return ranking.linucb_scores(rows.select("vec_id", "x"), models, "x", 0.5).select("vec_id", "label", fixed(F.col("score"), 6).alias("score"))


@query("mmr_select")
def mmr_select(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "label", "embedding", ((F.col("vec_id") % 11) / 11.0).alias("score"))
    return ranking.select_diverse(rows, "label", "vec_id", "score", "embedding", 15)


@query(
    "bandit_eval",
    """WITH e AS (SELECT event_type AS arm, value / 100.0 AS reward, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
    SELECT arm, floor(avg(reward) FILTER (2 * step <= n) * 10000 + 0.5) / 10000 AS early, floor(avg(reward) FILTER (2 * step > n) * 10000 + 0.5) / 10000 AS late, count(*) AS n FROM e GROUP BY arm""",
)
def bandit_eval(t: Tables) -> DataFrame:
    """Mean reward of each arm in the first and in the second half of each user's events."""
    from pyspark.sql import Window

    mine = Window.partitionBy("user_id")
    rows = t.events.where("value IS NOT NULL").select(F.col("event_type").alias("arm"), (F.col("value") / 100.0).alias("reward"), F.row_number().over(mine.orderBy("event_id")).alias("step"), F.count(F.lit(1)).over(mine).alias("n"))
    half = lambda early: fixed(F.avg(F.when((2 * F.col("step") <= F.col("n")) == early, F.col("reward"))))
    return rows.groupBy("arm").agg(half(True).alias("early"), half(False).alias("late"), F.count(F.lit(1)).alias("n"))


@query(
    "post_session_update",
    """WITH e AS (SELECT o_orderkey AS episode, least(o_totalprice / 500000.0, 1.0) AS reward, o_orderpriority AS arm, [o_custkey % 3, o_custkey % 5, 1] AS x FROM orders), y AS (SELECT arm, reward, x, unnest(range(1, 4)) AS i FROM e), z AS (SELECT *, unnest(range(1, 4)) AS j FROM y)
    SELECT arm, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, floor(sum(x[i]::DOUBLE * x[j]::DOUBLE) * 10000 + 0.5) / 10000 AS a, floor(sum(x[i] * reward) FILTER (i = j) * 10000 + 0.5) / 10000 AS b FROM z WHERE i <= j GROUP BY 1, 2, 3""",
)
def post_session_update(t: Tables) -> DataFrame:
    """Every decision of an episode is credited with the episode's reward: the statistics of each arm, off its diagonal too."""
    x = F.array((F.col("o_custkey") % 3).cast("double"), (F.col("o_custkey") % 5).cast("double"), F.lit(1.0))
    rows = t.orders.select(F.col("o_orderpriority").alias("arm"), x.alias("x"), F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0)).alias("r"))
    sums = ranking.linucb_statistics(rows, "arm", "x", "r")
    return sums.select("arm", "i", "j", fixed(F.col("a")).alias("a"), fixed(F.col("b")).alias("b"))


@query("hash_embedding")
def hash_embedding(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.transform(op.hash_embedding(F.col("text"), 16), lambda x: fixed(x, 6)).alias("embedding"))


@query("distinct_names")
def distinct_names(t: Tables) -> DataFrame:
    """Names of entities without near-duplicates, in the order of their first part: of two with a similarity of their stemmed words
    of 0.6 or more the longer one goes, the later one if they are as long, each compared in turn with what is still there."""
    from ..functions.text import plain_name, stem
    from ..operators.greedy import survivors
    from ..operators.setjoin import similar_sets

    name = F.concat_ws(" ", "p_name", F.lower("p_type"))
    first = t.part.groupBy(name.alias("name")).agg(F.min("p_partkey").alias("place")).withColumn("length", F.char_length("name"))
    words = F.explode(F.array_distinct(F.transform(F.split(plain_name(F.col("name")), " "), stem)))
    alike = similar_sets(first.select("place", words.alias("word")).where("word <> ''"), "place", "word", 0.6)
    return survivors(first, "place", "length", alike).join(first.select("place", "name"), "place").select("place", "name")


@query(
    "near_dup_names",
    """WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part), w AS (SELECT name, list_distinct(list_transform(string_split(name, ' '), lambda x: CASE WHEN length(x) > 3 THEN regexp_replace(x, '[es]+$', '') ELSE x END)) AS w FROM n)
    SELECT a.name AS a, b.name AS b, len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS similarity, CASE WHEN length(b.name) < length(a.name) THEN b.name ELSE a.name END AS kept
    FROM w AS a JOIN w AS b ON a.name < b.name WHERE len(list_intersect(a.w, b.w)) * 1.0 / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.5""",
)
def near_dup_names(t: Tables) -> DataFrame:
    from ..functions.text import stem

    names = t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name")).distinct()
    words = F.array_distinct(F.transform(F.split("name", " "), stem))
    return ranking.shorter_names(names.withColumn("words", words), "name", "words", 0.5)
