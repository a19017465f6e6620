"""Queries for critique, research gaps and the review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import fixed, rank_of
from ..functions.text import STOP_TOKENS, holds_any, setup_values, tokens
from ..operators import critique, layout
from ..operators.setjoin import overlapping_arrays
from .entity_queries import GAPS, gap_cells
from .registry import Tables, query
from .text_queries import _SETUP_VIEW, setups

#: The rules written out, for DuckDB: signals over the text of a document, counts over the entities and claims of its paper.
_FEATURES = r"""x AS (SELECT doc_id, lower(coalesce(text, '')) AS t, string_split(lower(coalesce(text, '')), chr(10)) AS lines FROM documents),
  m AS (SELECT paper_id, count(DISTINCT dataset) AS n_datasets, count(DISTINCT task) AS n_tasks FROM mentions GROUP BY paper_id),
  c AS (SELECT paper_id, count(DISTINCT metric) AS n_metrics, count(*) AS n_claims FROM claims WHERE value IS NOT NULL AND metric IN ('purchase', 'signup') GROUP BY paper_id),
  f AS (SELECT doc_id AS paper_id, coalesce(n_datasets, 0) AS n_datasets, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_metrics, 0) AS n_metrics, coalesce(n_claims, 0) AS n_claims,
    regexp_matches(t, 'ablation|ablate|sensitivity analysis|component analysis|remove|without|w/o|effect of|contribution of|variant|different versions|we test|we compare|configuration|setting|hyperparameter|heads|layers')
      OR len(string_split(t, 'model')) > 3 AND regexp_matches(t, 'compare|different|vary') AS has_ablation,
    regexp_matches(t, 'p<|p <|p-value|t-test|wilcoxon|statistical significance|confidence interval|error bar|std dev|standard deviation|±') AS has_significance,
    regexp_matches(t, 'github|code|implementation|available at|open source|open-source|released|https?://') AS has_reproducibility,
    regexp_matches(t, 'words/sec|words per second|tokens/sec|throughput|training time|faster|speed|latency|step/sec') AS has_speed_metrics,
    len(list_filter(lines, lambda l: regexp_matches(l, 'future (research|work|direction)'))) AS n_future_work,
    len(list_filter(lines, lambda l: NOT regexp_matches(l, 'd_k|beam size|dropout|label smoothing') AND regexp_matches(l, 'scalability|generalization|long-range|sequential|parallelization|efficiency|modalities|tasks beyond|not tested|restricted to|only evaluated|computational cost|training cost|cannot handle|lack of|absence of|limited to|does not|unable to|fixed-length|quadratic|out-of-domain|domain|interpretability|explainab|low-resource|multimodal|multi-modal|structured|variable-length|memory|context length|generalise|generaliz|require|constraint|limitation|beyond translation|non-english|other languages'))) AS n_limitations
    FROM x LEFT JOIN m ON m.paper_id = doc_id LEFT JOIN c ON c.paper_id = doc_id)"""


def features(t: Tables) -> DataFrame:
    """A feature row for each document: what its text reports, and the entities and claims of the paper with its id."""
    from ..functions.text import REAL, meaningful_limitation, signals

    whole = F.lower(F.coalesce("text", F.lit("")))
    lines = F.split(F.lower(F.coalesce("text", F.lit(""))), "\n")
    of_text = {
        **signals(F.coalesce("text", F.lit(""))),
        "n_future_work": F.size(F.filter(lines, lambda x: x.rlike("future (research|work|direction)"))),
        "n_limitations": F.when(holds_any(whole, REAL), F.size(F.filter(lines, meaningful_limitation))).otherwise(0),  # a look at each line only where one can tell
    }
    docs = t.documents.select(F.col("doc_id").alias("paper_id"), *(c.alias(n) for n, c in of_text.items()))
    m = t.mentions.groupBy("paper_id").agg(F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("task").alias("n_tasks"))
    c = t.claims.where("value IS NOT NULL AND metric IN ('purchase', 'signup')").groupBy("paper_id").agg(F.count_distinct("metric").alias("n_metrics"), F.count(F.lit(1)).alias("n_claims"))
    return docs.join(m, "paper_id", "left").join(c, "paper_id", "left").na.fill(0, ["n_datasets", "n_tasks", "n_metrics", "n_claims"])


_FIRED = """SELECT paper_id, 'no_dataset_reported' AS weakness, 'HIGH' AS severity, 'Report the data used.' AS suggestion FROM f WHERE n_datasets = 0
    UNION ALL SELECT paper_id, 'single_dataset_evaluation', 'HIGH', 'Evaluate on further data.' FROM f WHERE n_datasets = 1
    UNION ALL SELECT paper_id, 'missing_ablation_study', 'MEDIUM', 'Remove parts one at a time.' FROM f WHERE NOT has_ablation
    UNION ALL SELECT paper_id, 'missing_statistical_significance', 'MEDIUM', 'Report variance over runs.' FROM f WHERE n_claims > 0 AND NOT has_significance
    UNION ALL SELECT paper_id, 'missing_reproducibility', 'LOW', 'Publish the code.' FROM f WHERE NOT has_reproducibility
    UNION ALL SELECT paper_id, 'missing_limitations_future_work', 'MEDIUM', 'Discuss limitations.' FROM f WHERE n_future_work = 0 AND n_limitations <= 1
    UNION ALL SELECT paper_id, 'limited_evaluation_metrics', 'LOW', 'Use further metrics.' FROM f WHERE n_metrics <= 1 AND n_tasks >= 2"""


@query("critic_rules", "WITH {MENTIONS}, {CLAIMS}, " + _FEATURES + " " + _FIRED)
def critic_rules(t: Tables) -> DataFrame:
    return critique.find_weaknesses(features(t), "paper_id")


@query("ground_truth", "WITH {MENTIONS}, {CLAIMS}, " + _FEATURES + " SELECT paper_id, n_datasets, n_tasks, n_metrics, n_claims, has_ablation, has_significance, has_reproducibility, has_speed_metrics, CAST(n_future_work AS INTEGER) AS n_future_work, CAST(n_limitations AS INTEGER) AS n_limitations FROM f")
def ground_truth(t: Tables) -> DataFrame:
    """What is there in each paper, against which claims of absence are held."""
    return features(t)


@query("critic_quality", "WITH {MENTIONS}, {CLAIMS}, " + _FEATURES + f", w AS ({_FIRED})" + """, n AS (SELECT paper_id, count(*) FILTER (severity = 'LOW') AS n_low, count(*) FILTER (severity = 'MEDIUM') AS n_medium, count(*) FILTER (severity = 'HIGH') AS n_high FROM w GROUP BY 1)
    SELECT *, CASE WHEN n_high >= 2 THEN 'HIGH_CONCERN' WHEN n_high >= 1 OR n_medium >= 3 THEN 'MODERATE' ELSE 'ACCEPTABLE' END AS overall_quality FROM n""")
def critic_quality(t: Tables) -> DataFrame:
    return critique.quality_of(critique.find_weaknesses(features(t), "paper_id"), "paper_id")


@query(
    "severity_validation",
    """WITH o AS (SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 1 WHEN '3' THEN 1 ELSE 0 END AS r, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS p,
      year(o_orderdate) + 22 AS year, length(o_orderpriority) > 10 AS explained FROM orders),
    s AS (SELECT id, year, CASE WHEN p <= r THEN p WHEN explained THEN least(p, r + 1) ELSE r END AS s FROM o)
    SELECT id, ['LOW', 'MEDIUM', 'HIGH'][CASE WHEN year < 2020 THEN least(s, 1) ELSE s END + 1] AS final FROM s""",
)
def severity_validation(t: Tables) -> DataFrame:
    """Severities that a rule gave and a model proposes: an order's priority and status, its priority's text as the reason."""
    digit, status = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    rule = F.when(digit == "1", "HIGH").when(digit.isin("2", "3"), "MEDIUM").otherwise("LOW")
    proposed = F.when(status == "F", "HIGH").when(status == "O", "MEDIUM").otherwise("LOW")
    return t.orders.select(F.col("o_orderkey").alias("id"), critique.validated_severity(rule, proposed, F.year("o_orderdate") + 22, F.col("o_orderpriority")).alias("final"))


#: Baselines and years as the oracle knows them, and spellings that have to lead to them or, the last ones, must not.
_SINCE = "lstm 1997 biglstm 2016 lstmp 2014 rnn 1990 gru 2014 transformer 2017 attentionisall 2017 bert 2018 roberta 2019 gpt 2018 gpt2 2019 gpt3 2020 t5 2020 xlnet 2019 albert 2020 distilbert 2019 electra 2020 alexnet 2012 vgg 2014 resnet 2016 inception 2015 densenet 2017 seq2seq 2014 bahdanau 2015 attention 2015 word2vec 2013 glove 2014 fasttext 2017 elmo 2018 dqn 2015 a3c 2016 ppo 2017 sac 2018".split()
_NAMES = (
    "LSTM", "BigLSTM", "lstmp", "RNN", "GRU", "Transformer", "Attention Is All", "BERT", "RoBERTa", "gpt", "GPT2", "gpt 2", "GPT-3", "T5", "XLNet", "ALBERT", "Distil-BERT", "ELECTRA", "AlexNet", "VGG", "Res Net", "Inception", "DenseNet",
    "seq2seq", "Bahdanau", "attention", "Word2Vec", "GloVe", "fastText", "ELMo", "DQN", "A3C", "PPO", "SAC", "f-lstm", "BERT-large", "unheard",
)
_USES = (
    "{MENTIONS}, u AS (SELECT DISTINCT paper_id, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][part_id % {len(_NAMES)} + 1]" + " AS name FROM mentions), y AS (SELECT u.*, year(o_orderdate) + 20 AS year FROM u JOIN orders ON o_orderkey = paper_id), "
    "k(key, since) AS (VALUES " + ", ".join(f"('{n}', {y})" for n, y in zip(_SINCE[::2], _SINCE[1::2])) + "), a AS (SELECT y.*, year - since AS age FROM y JOIN k ON key = regexp_replace(lower(name), '[^a-z0-9]', '', 'g') WHERE year - since > 4)"
)


def baseline_uses(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col("part_id") % len(_NAMES) + 1).cast("int"))
    return t.mentions.select("paper_id", name.alias("name")).distinct().join(t.orders.select(F.col("o_orderkey").alias("paper_id"), (F.year("o_orderdate") + 20).alias("year")), "paper_id")


@query("baseline_staleness", "WITH " + _USES + " SELECT paper_id, name, CAST(age AS BIGINT) AS age, CASE WHEN age > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a")
def baseline_staleness(t: Tables) -> DataFrame:
    return critique.stale_baselines(baseline_uses(t), "name", "year").select("paper_id", "name", F.col("age").cast("long").alias("age"), "severity")


@query("outdated_baselines", "WITH " + _USES + " SELECT paper_id, count(DISTINCT lower(name)) AS n_stale, CAST(max(age) AS BIGINT) AS oldest, CASE WHEN max(age) > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM a GROUP BY paper_id")
def outdated_baselines(t: Tables) -> DataFrame:
    return critique.outdated_papers(baseline_uses(t), "paper_id", "name", "year").withColumn("oldest", F.col("oldest").cast("long"))


@query(
    "narrow_coverage_gaps",
    """WITH {MENTIONS}, e AS (SELECT DISTINCT paper_id, part_id || '/' || pos AS task, dataset FROM mentions), n AS (SELECT count(DISTINCT dataset) AS n FROM e),
    tested AS (SELECT a.task, count(DISTINCT b.dataset) AS k FROM (SELECT DISTINCT paper_id, task FROM e) AS a JOIN e AS b USING (paper_id) GROUP BY 1 HAVING count(DISTINCT b.dataset) <= 1),
    own AS (SELECT paper_id, min(dataset) AS dataset FROM e GROUP BY 1 HAVING count(DISTINCT dataset) <= 1)
    SELECT task, dataset, min(paper_id) AS paper_id, min(k) AS n_tested, n - min(k) AS n_untested FROM (SELECT DISTINCT paper_id, task FROM e) JOIN tested USING (task) JOIN own USING (paper_id), n WHERE n > k GROUP BY task, dataset, n""",
)
def narrow_coverage_gaps(t: Tables) -> DataFrame:
    """Tasks that were tested on one dataset at most, of papers with one dataset at most: one gap a task and dataset, of the first
    paper. A task is a part in its place."""
    mentions = t.mentions.select("paper_id", F.concat_ws("/", "part_id", "pos").alias("task"), "dataset")
    gaps = one_dataset_gaps(mentions)
    everything = mentions.agg(F.count_distinct("dataset").alias("n_all"))
    return gaps.join(F.broadcast(everything)).where("n_all > n_tested").select("task", "dataset", "paper_id", "n_tested", (F.col("n_all") - F.col("n_tested")).alias("n_untested"))


def one_dataset_gaps(mentions: DataFrame) -> DataFrame:
    """``(task, dataset, paper_id, n_tested)`` of tasks whose papers have one dataset at most together. A paper brings its first and
    last dataset, and a task those of its papers: tasks never meet datasets, and no set is gathered."""
    of_paper = mentions.where("paper_id IS NOT NULL").groupBy("paper_id").agg(F.min("dataset").alias("dataset"), F.max("dataset").alias("last"))
    met = mentions.select("paper_id", "task").join(of_paper, "paper_id")
    # where a task has one dataset, each of its papers has that one or none
    tasks = met.groupBy("task").agg(F.min("dataset").alias("dataset"), F.max("last").alias("last"), F.min(F.when(F.col("dataset").isNotNull(), F.col("paper_id"))).alias("with"), F.min(F.when(F.col("dataset").isNull(), F.col("paper_id"))).alias("without"))
    one = tasks.where("dataset IS NULL OR dataset = last").withColumn("n_tested", F.when(F.col("dataset").isNull(), 0).otherwise(1).cast("long"))
    rows = one.select("task", "n_tested", F.inline(F.array(F.struct("dataset", F.col("with").alias("paper_id")), F.struct(F.lit(None).cast("string").alias("dataset"), F.col("without").alias("paper_id")))))
    return rows.where("paper_id IS NOT NULL").select("task", "dataset", "paper_id", "n_tested")


_COMBINED = """{MENTIONS}, o AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders), p AS (SELECT a AS paper_a, b AS paper_b FROM o WHERE a IS NOT NULL UNION ALL SELECT b, a FROM o WHERE a IS NOT NULL),
    e AS (SELECT DISTINCT paper_id, CASE WHEN part_id % 5 = 0 THEN raw_text || ' lstm ' || part_id WHEN part_id % 5 < 3 THEN raw_text || ' ' || part_id ELSE method || part_id END AS method, task, dataset FROM mentions),
    s AS (SELECT paper_a, paper_b, count(DISTINCT a.task) AS n_shared FROM p JOIN e AS a ON a.paper_id = paper_a JOIN e AS b ON b.paper_id = paper_b AND b.task = a.task GROUP BY ALL),
    seen AS (SELECT DISTINCT a.method, b.dataset FROM e AS a JOIN e AS b USING (paper_id)),
    g AS (SELECT DISTINCT a.method, paper_a, paper_b, n_shared, b.dataset FROM s JOIN e AS a ON a.paper_id = paper_a JOIN e AS b ON b.paper_id = paper_b WHERE regexp_matches(a.method, 'lstm') OR contains(a.method, ' ')),
    missing AS (SELECT method, paper_a, paper_b, n_shared, count(*) AS n_missing FROM g ANTI JOIN seen USING (method, dataset) GROUP BY ALL),
    combined AS (SELECT method, paper_a, paper_b, n_shared, n_missing, CASE WHEN n_shared > 2 AND n_missing > 3 THEN 'HIGH' WHEN n_missing > 1 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
      floor((least(0.9, 0.4 + 0.15 * n_shared)::DOUBLE - CASE WHEN regexp_matches(method, 'lstm') THEN 0 ELSE 0.2 END) * 10000 + 0.5) / 10000 AS confidence FROM missing)"""


@query("combinatorial_gaps", f"WITH {_COMBINED} SELECT * FROM combined")
def combinatorial_gaps(t: Tables) -> DataFrame:
    return combinatorial_gaps_of(t)


def combinatorial_gaps_of(t: Tables) -> DataFrame:
    """Methods of one paper of a pair that no paper has tried on datasets of the other, where both share a task: one gap a method and
    ordered pair. Names that are no methods are left out, weak ones are less sure. Pairs are given, so all are equi-joins."""
    from ..functions.text import method_class
    from .paper_queries import neighbours

    part, kind = F.col("part_id").cast("string"), F.col("part_id") % 5
    name = F.when(kind == 0, F.concat("raw_text", F.lit(" lstm "), part)).when(kind < 3, F.concat_ws(" ", "raw_text", part)).otherwise(F.concat("method", part))
    return cross_paper_methods(neighbours(t), t.mentions.select("paper_id", name.alias("method"), "task", "dataset"), method_class)


def cross_paper_methods(pairs: DataFrame, entities: DataFrame, method_class) -> DataFrame:
    """``(method, paper_a, paper_b, n_shared, n_missing, priority, confidence)`` for both orders of each pair.

    Papers bring their sets to a pair, one row each, and a method the datasets that some paper tried it on (as many as there are at
    most): what is missing is counted in the row, so no method meets the datasets of a pair row by row.
    """
    both = pairs.select("paper_a", "paper_b").unionByName(pairs.select(F.col("paper_b").alias("paper_a"), F.col("paper_a").alias("paper_b"))).distinct()
    sets = entities.groupBy("paper_id").agg(*(F.collect_set(c).alias(f"{c}s") for c in ("method", "task", "dataset")))
    a = sets.select(F.col("paper_id").alias("paper_a"), F.filter("methods", lambda m: method_class(m) != "NOT_METHOD").alias("methods"), F.col("tasks").alias("tasks_a"))
    b = sets.select(F.col("paper_id").alias("paper_b"), F.col("tasks").alias("tasks_b"), "datasets")
    met = both.join(a, "paper_a").join(b, "paper_b").withColumn("n_shared", F.size(F.array_intersect("tasks_a", "tasks_b")).cast("long")).where("n_shared > 0")
    reach = met.select("paper_a", "paper_b", "n_shared", "datasets", F.explode("methods").alias("method"))
    seen = sets.select(F.explode("methods").alias("method"), "datasets").select("method", F.explode("datasets").alias("d")).groupBy("method").agg(F.collect_set("d").alias("seen"))
    missing = F.size(F.array_except("datasets", F.coalesce("seen", F.array().cast("array<string>")))).cast("long")
    gaps = reach.join(seen, "method", "left").withColumns({"n_missing": missing, "class": method_class(F.col("method"))}).where("n_missing > 0")
    priority = F.when((F.col("n_shared") > 2) & (F.col("n_missing") > 3), "HIGH").when(F.col("n_missing") > 1, "MEDIUM").otherwise("LOW")
    sure = F.least(F.lit(0.9), 0.4 + 0.15 * F.col("n_shared")) - F.when(F.col("class") == "WEAK_METHOD", 0.2).otherwise(0.0)
    return gaps.select("method", "paper_a", "paper_b", "n_shared", "n_missing", priority.alias("priority"), fixed(sure).alias("confidence"))


@query(
    "gaps_once",
    """WITH g AS (SELECT l_orderkey AS paper, l_returnflag AS task, l_linenumber AS place, array_to_string(list_sort(list_distinct([l_suppkey % 5, l_partkey % 5])), '+') AS datasets FROM lineitem)
    SELECT task, datasets, min(paper) AS paper, count(*) AS n FROM g GROUP BY 1, 2""",
)
def gaps_once(t: Tables) -> DataFrame:
    """Gaps with the same task and the same set of datasets, in whatever order, are one: that of the first paper."""
    names = F.array_join(F.array_sort(F.array_distinct(F.array(F.col("l_suppkey") % 5, F.col("l_partkey") % 5))).cast("array<string>"), "+")
    g = t.lineitem.select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("task"), names.alias("datasets"))
    return g.groupBy("task", "datasets").agg(F.min("paper").alias("paper"), F.count(F.lit(1)).alias("n"))


@query(
    "boost_priority",
    f"WITH {_COMBINED}, " + _USES.replace("{MENTIONS}, u AS", "uses AS").replace("SELECT u.*, year", "SELECT uses.*, year").replace("FROM u JOIN", "FROM uses JOIN").replace(", a AS (", ", aged AS (") + """, own AS (SELECT paper_id, 0.1 AS plus FROM mentions GROUP BY paper_id HAVING count(DISTINCT dataset) = 1), old AS (SELECT paper_id, 0.05 AS plus FROM aged GROUP BY paper_id HAVING max(age) > 7),
    w AS (SELECT paper_id, sum(plus) AS plus FROM (SELECT * FROM own UNION ALL SELECT * FROM old) GROUP BY paper_id)
    SELECT method, paper_a, paper_b, CASE WHEN x.plus IS NOT NULL OR y.plus IS NOT NULL THEN 'HIGH' ELSE priority END AS priority, floor(least(confidence + coalesce(x.plus, 0) + coalesce(y.plus, 0), 1.0)::DOUBLE * 10000 + 0.5) / 10000 AS confidence
    FROM combined LEFT JOIN w AS x ON x.paper_id = paper_a LEFT JOIN w AS y ON y.paper_id = paper_b""",
)
def boost_priority(t: Tables) -> DataFrame:
    """Combinatorial gaps are raised by HIGH weaknesses of their papers: results on one dataset, or baselines that are long outdated."""
    one = t.mentions.groupBy("paper_id").agg(F.count_distinct("dataset").alias("n_datasets"))
    single = critique.find_weaknesses(one, "paper_id", tuple(c for c in critique.CHECKS if c.name == "single_dataset_evaluation")).select("paper_id", "weakness", "severity")
    old = critique.outdated_papers(baseline_uses(t), "paper_id", "name", "year").select("paper_id", F.lit("outdated_baselines").alias("weakness"), "severity")
    gaps = combinatorial_gaps_of(t).withColumns({"gap_id": F.struct("method", "paper_a", "paper_b"), "gap_type": F.lit("combinatorial"), "papers": F.array("paper_a", "paper_b")})
    found = critique.boosted_gaps(gaps.select("gap_id", "gap_type", "papers", "priority", "confidence"), single.unionByName(old))
    return found.select("gap_id.*", "priority", fixed(F.col("confidence")).alias("confidence"))


@query(
    "addressed_later",
    """WITH w AS (SELECT item_id, item_id % 10 AS year, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 5 AND regexp_matches(x, '^[a-z]'))) AS t FROM benchmark),
    d AS (SELECT doc_id, doc_id % 10 AS year, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: length(x) >= 5 AND regexp_matches(x, '^[a-z]'))) AS t FROM documents)
    SELECT doc_id, count(DISTINCT item_id) > 0 AS addressed, count(DISTINCT item_id) AS n_later FROM d LEFT JOIN w ON w.year > d.year AND len(list_intersect(d.t, w.t)) >= 3 GROUP BY 1""",
)
def addressed_later(t: Tables) -> DataFrame:
    """Documents whose limitations a later claim takes up: three or more shared words, by a join on words that later claims have."""
    words = lambda c: F.explode(F.filter(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+")), lambda x: (F.length(x) >= 5) & x.rlike("^[a-z]")))
    said = t.documents.select("doc_id", (F.col("doc_id") % 10).alias("year"), words("text").alias("w"))
    later = t.benchmark.select("item_id", (F.col("item_id") % 10).alias("later"), words("text").alias("w"))
    hits = said.join(later, "w").where("later > year").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_later"))
    n = F.coalesce("n_later", F.lit(0))
    return t.documents.select("doc_id").distinct().join(hits, "doc_id", "left").select("doc_id", (n > 0).alias("addressed"), n.alias("n_later"))


#: Words of a limitation that what saves computation answers.
_SCARCE = ("memory", "edge", "mobile", "resource", "parameter", "compute", "lightweight")


@query("complement_signals")
def complement_signals(t: Tables) -> DataFrame:
    """Limitations of one text that claims of another speak to, in both directions between documents and passages: three or more
    shared words of three letters or more, stop words left out. 0.9 where the limitation is about scarce means and the claim's text
    names what saves them, else 0.65. A row is a text; what is known of it goes along with its words, which are never parted."""
    savings = setup_values(F.col("text"))
    saves = savings["uses_quantization"] | savings["uses_pruning"] | savings["uses_distillation"]
    words = F.array_except(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[a-z][a-z0-9\-]{2,}\b"), F.lit(0)), F.array(*map(F.lit, STOP_TOKENS)))
    most = F.floor((F.length("text") + 1) / 4)  # words of three letters or more, each with what parts it from the next
    owner = lambda key: F.struct(key, holds_any(F.lower("text"), _SCARCE).alias("scarce"), saves.alias("saves")).alias(key)
    sets = lambda df, key: df.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(owner(key), words.alias("items"), most.alias("n"))
    met = overlapping_arrays(sets(t.documents, "doc_id"), sets(t.benchmark, "item_id"), "doc_id", "item_id", 3)
    found = met.select("a.doc_id", "b.item_id", "n_shared", *(F.col(f"{x}.{c}").alias(f"{c}_{key}") for x, key in (("a", "doc_id"), ("b", "item_id")) for c in ("scarce", "saves")))
    sure = lambda limitation, claim: F.when(F.col(f"scarce_{limitation}") & F.col(f"saves_{claim}"), 0.9).otherwise(0.65)
    both = F.array(*(F.struct(F.lit(f"{a} to {b}").alias("direction"), sure(x, y).alias("confidence")) for a, b, x, y in (("document", "passage", "doc_id", "item_id"), ("passage", "document", "item_id", "doc_id"))))
    return found.select("doc_id", "item_id", "n_shared", F.inline(both))


@query("citation_link", "WITH c AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem), p AS (SELECT a.s_suppkey AS paper_a, b.s_suppkey AS paper_b FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey) SELECT paper_a, paper_b, EXISTS (SELECT 1 FROM c WHERE c.a = paper_a AND c.b = paper_b OR c.a = paper_b AND c.b = paper_a) AS linked FROM p")
def citation_link(t: Tables) -> DataFrame:
    """Whether one paper of a pair cites the other, in either direction."""
    s = t.supplier.select("s_suppkey", "s_nationkey")
    pairs = s.select(F.col("s_suppkey").alias("paper_a"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("paper_b"), "s_nationkey"), "s_nationkey").where("paper_a < paper_b")
    a, b = F.col("l_suppkey"), F.col("l_partkey") % 100
    cites = t.lineitem.select(F.least(a, b).alias("paper_a"), F.greatest(a, b).alias("paper_b")).distinct().withColumn("linked", F.lit(True))
    return pairs.join(cites, ["paper_a", "paper_b"], "left").select("paper_a", "paper_b", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("ner_hint_join", "WITH h AS (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS hints FROM nation GROUP BY 1) SELECT conv_id, turn, role || ': ' || coalesce(hints, '') AS prompt FROM conversations LEFT JOIN h ON n_regionkey = conv_id % 7")
def ner_hint_join(t: Tables) -> DataFrame:
    hints = t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("hints"))
    c = t.conversations
    return c.join(hints, hints["n_regionkey"] == c["conv_id"] % 7, "left").select("conv_id", "turn", F.concat("role", F.lit(": "), F.coalesce("hints", F.lit(""))).alias("prompt"))


@query("llm_validation_merge", """WITH {CLAIMS}, d AS (SELECT claim_id, CASE WHEN metric <> 'error' THEN (dataset - 50) / 100.0 END AS delta FROM claims), c AS (SELECT claim_id, least(greatest(0.5 + coalesce(delta, 0), 0), 1)::DOUBLE AS confidence, delta IS NOT NULL AS validated FROM d)
    SELECT claim_id, floor(confidence * 100 + 0.5) / 100 AS confidence, validated, confidence < 0.6 AS needs_review FROM c WHERE confidence >= 0.4""")
def llm_validation_merge(t: Tables) -> DataFrame:
    """Answers of a validator, read leniently from the text around them, adjust confidences; low ones go, middling ones are marked.
    What an event holds beside its value is its answer; errors have none."""
    from ..functions.text import repair_json

    answer = F.when(F.col("event_type") != "error", F.concat(F.lit("Here it is: ```json\n"), "props", F.lit("\n``` Done {."))).otherwise(F.lit("no answer"))
    delta = (F.get_json_object(repair_json(answer), "$.k").try_cast("double") - 50) / 100.0
    c = t.events.select(F.col("event_id").alias("claim_id"), F.least(F.greatest(F.lit(0.5) + F.coalesce(delta, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), delta.isNotNull().alias("validated"))
    return c.where("confidence >= 0.4").select("claim_id", fixed(F.col("confidence"), 2).alias("confidence"), "validated", (F.col("confidence") < 0.6).alias("needs_review"))


@query("priority_sort_topk", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 25")
def priority_sort_topk(t: Tables) -> DataFrame:
    rank = F.coalesce(rank_of(F.substring("o_orderpriority", 1, 1), ("1", "2")), F.lit(2))
    return t.orders.orderBy(rank, F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_orderpriority", "o_totalprice")


_TEXTS = {
    "description": "Method '%s' has never been evaluated on dataset '%s' (gap score: %d). Method used in: %d papers; dataset used in: %d papers.",
    "evidence": "gap matrix: method='%s', dataset='%s', gap_score=%d.",
    "suggestion": "Evaluate '%s' on '%s' to fill this identified research gap.",
}


@query(
    "gap_text_templates",
    f"""WITH {GAPS}, q AS (SELECT *, chr(39) || part_id || chr(39) AS m, chr(39) || dataset || chr(39) AS d FROM gaps)
    SELECT part_id, dataset, CASE WHEN gap_score >= 4 THEN 'HIGH' WHEN gap_score >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
      'Method ' || m || ' has never been evaluated on dataset ' || d || ' (gap score: ' || gap_score || '). Method used in: ' || n_method_papers || ' papers; dataset used in: ' || n_dataset_papers || ' papers.' AS description,
      'gap matrix: method=' || m || ', dataset=' || d || ', gap_score=' || gap_score || '.' AS evidence, 'Evaluate ' || m || ' on ' || d || ' to fill this identified research gap.' AS suggestion FROM q""",
)
def gap_text_templates(t: Tables) -> DataFrame:
    """What is said of each empty cell of the gap matrix."""
    c = gap_cells(t).withColumn("m", F.col("part_id").cast("string"))
    priority = F.when(F.col("gap_score") >= 4, "HIGH").when(F.col("gap_score") >= 2, "MEDIUM").otherwise("LOW")
    values = {"description": ("m", "dataset", "gap_score", "n_method_papers", "n_dataset_papers"), "evidence": ("m", "dataset", "gap_score"), "suggestion": ("m", "dataset")}
    return c.select("part_id", "dataset", priority.alias("priority"), *(F.format_string(_TEXTS[n], *columns).alias(n) for n, columns in values.items()))


@query("string_match_fallback", """WITH b AS (SELECT DISTINCT lower(p_brand) AS name FROM part), k AS (SELECT DISTINCT lower(p_brand) AS known FROM part WHERE p_size > 45), s AS (SELECT name, known, CASE WHEN name = known THEN 1.0 ELSE 0.85 END AS score FROM b JOIN k ON contains(name, known) OR contains(known, name))
    SELECT name, known, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, known) AS n FROM s) WHERE n = 1""")
def string_match_fallback(t: Tables) -> DataFrame:
    """A name's best match in a dictionary: equal, or one inside the other."""
    from ..operators.dictionary import resolve_names

    return resolve_names(t.part.select(F.lower("p_brand").alias("name")), "name", t.part.where("p_size > 45").select(F.lower("p_brand").alias("known")), "known")


_BOXES = "b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS id, l_quantity * 10 AS x0, l_linenumber * 30.0 AS y0, l_quantity * 10 + 100 AS x1, l_linenumber * 30.0 + 40 AS y1, l_returnflag FROM lineitem)"


@query("layout_overlap", "WITH " + _BOXES + """, h AS (SELECT DISTINCT a.page, a.id FROM b AS a JOIN b AS c ON a.page = c.page AND c.l_returnflag = 'R' WHERE a.l_returnflag <> 'R'
      AND greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) > 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0))
    SELECT page, CAST(id AS INTEGER) AS id, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(y0 / 10), x0, id) AS INTEGER) AS place FROM b ANTI JOIN h USING (page, id) WHERE l_returnflag <> 'R'""")
def layout_overlap(t: Tables) -> DataFrame:
    """Text blocks that no table covers by half, in reading order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    b = t.lineitem.select(F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_linenumber") * 30.0).alias("y0"), (F.col("l_quantity") * 10 + 100).alias("x1"), (F.col("l_linenumber") * 30.0 + 40).alias("y1"), "l_returnflag")
    free = layout.uncovered(b.where("l_returnflag <> 'R'"), b.where("l_returnflag = 'R'"), "page", "id")
    return layout.reading_order(free, "page", "id").select("page", "id", "place")


@query("review_methods", "WITH {MENTIONS}, m AS (SELECT method, count(DISTINCT paper_id) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, method LIMIT 10) SELECT '## Methods' || chr(10) || string_agg('- ' || method || ' (' || n || ' papers)', chr(10) ORDER BY n DESC, method) AS text FROM m")
def review_methods(t: Tables) -> DataFrame:
    top = t.mentions.groupBy("method").agg(F.count_distinct("paper_id").alias("n")).orderBy(F.col("n").desc(), "method").limit(10)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "method", F.format_string("- %s (%d papers)", "method", "n").alias("line"))))
    return top.agg(F.concat(F.lit("## Methods\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


@query("review_results", "WITH {CLAIMS}, r AS (SELECT metric, dataset, value, claim_id FROM claims WHERE value > 0 ORDER BY value DESC, claim_id LIMIT 20) SELECT string_agg(metric || ' on ' || dataset, '; ' ORDER BY value DESC, claim_id) AS text, count(*) AS n FROM r")
def review_results(t: Tables) -> DataFrame:
    top = t.claims.where("value > 0").orderBy(F.col("value").desc(), "claim_id").limit(20)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("k"), "claim_id", F.concat_ws(" on ", "metric", F.col("dataset").cast("string")).alias("line"))))
    return top.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("text"), F.count(F.lit(1)).alias("n"))


@query("references", """SELECT c_custkey, '[' || element || ' ' || (1990 + c_nationkey) || ']' AS citation FROM (SELECT c_custkey, c_nationkey, string_split(c_name, '#')[-1] AS element FROM customer)""")
def references(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat(F.lit("["), F.element_at(F.split("c_name", "#"), -1), F.lit(" "), (F.lit(1990) + F.col("c_nationkey")).cast("string"), F.lit("]")).alias("citation"))


@query("setup_attach", f"WITH {_SETUP_VIEW} SELECT id, CAST(coalesce(bs, 32) AS INTEGER) AS batch_size, coalesce(opt, 'unknown') AS optimizer FROM x")
def setup_attach(t: Tables) -> DataFrame:
    """The setup of each paper, defaults where its text names none."""
    found = setups(t).where("batch_size IS NOT NULL").select("id", F.col("batch_size").cast("int").alias("b"), "optimizer")
    papers = t.orders.select(F.col("o_orderkey").alias("id"))
    return papers.join(found, "id", "left").select("id", F.coalesce("b", F.lit(32)).alias("batch_size"), F.coalesce("optimizer", F.lit("unknown")).alias("optimizer"))


@query("title_caption_clean", """WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) SELECT page_id, trim(regexp_replace(title, '[^\\p{L}\\p{N} .,;:!?-]', '', 'g')) AS clean, len(regexp_split_to_array(trim(title), '\\s+')) >= 3 AS is_title FROM p""")
def title_caption_clean(t: Tables) -> DataFrame:
    from ..sources.markup import page_parts

    title = F.col("title")
    return page_parts(t.pages).select("page_id", F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} .,;:!?-]", "")).alias("clean"), (F.size(F.split(F.trim(title), r"\s+")) >= 3).alias("is_title"))


@query("document_tokens", "SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[a-z]') AND x NOT IN (" + ", ".join(f"'{w}'" for w in STOP_TOKENS) + "))))::INTEGER AS n_tokens FROM documents")
def document_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"))


_TUMBLING = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


@query("batch_tumbling", _TUMBLING)
def batch_tumbling(t: Tables) -> DataFrame:
    from ..streaming.events import tumbling_counts

    return tumbling_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, s"""


@query("batch_sessions", _SESSIONS)
def batch_sessions(t: Tables) -> DataFrame:
    from ..streaming.events import session_counts

    out = session_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_tumbling", _TUMBLING)
def stream_tumbling(t: Tables) -> DataFrame:
    from ..streaming.events import drain, read_events, tumbling_counts

    return drain(t.spark, read_events(t.spark, t._dir), tumbling_counts, "tumbling", close=True).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_sessions", _SESSIONS)
def stream_sessions(t: Tables) -> DataFrame:
    from ..streaming.events import drain, read_events, session_counts

    out = drain(t.spark, read_events(t.spark, t._dir), session_counts, "sessions", close=True)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("stream_dedup")
def stream_dedup(t: Tables) -> DataFrame:
    from ..streaming.events import drain, first_events, read_events

    return drain(t.spark, read_events(t.spark, t._dir).select("user_id", "event_type", "ts"), lambda events: first_events(events, ["user_id", "event_type"]), "dedup", close=False)
