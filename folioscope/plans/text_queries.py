"""Queries over texts: normalisers, extraction, signals, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.scores import fixed
from .registry import Tables, query

#: Pairs of a spelling and its canonical name.
METRIC_CASES = [
    ("BLEU score", "bleu"), ("bleu", "bleu"), ("BLEU-4", "bleu"), ("tokenized BLEU", "bleu"), ("SacreBLEU", "bleu"), ("val perplexity", "perplexity"), ("validation perplexity", "perplexity"),
    ("ppl", "perplexity"), ("NLL", "nll"), ("negative log likelihood", "nll"), ("cross entropy", "nll"), ("Top-1 Accuracy", "top-1"), ("top-5 acc", "top-5"), ("F1 score", "f1"),
    ("macro-F1", "f1-macro"), ("ROUGE-L", "rouge-l"), ("rouge1", "rouge-1"), ("WER", "wer"), ("training time", "training-time"), ("rouge", "rouge-l"), ("weighted f1", "f1-weighted"), ("test loss", "nll"),
    ("top-3 acc", "top-3"), ("perplexity", "perplexity"), ("Detection Rate", "detection"), ("val acc", "accuracy"), ("character error rate", "character error"), ("cer", "cer"), ("micro f1", "f1-micro"), ("mAP", "map"),
]
DATASET_CASES = [
    ("WMT'14 En-De", "wmt14-en-de"), ("WMT 2014 English-German dataset", "wmt14-en-de"), ("wmt 2014 english-german dataset", "wmt14-en-de"), ("WMT'14 En-Fr", "wmt14-en-fr"),
    ("WMT 2016 English-German", "wmt16-en-de"), ("WMT'20 English-Chinese", "wmt20-en-zh"), ("newstest2014", "newstest2014"), ("ntst14", "newstest2014"), ("SQuAD 1.1", "squad-v1"),
    ("squad v2.0", "squad-v2"), ("MNLI", "glue-mnli"), ("Penn Treebank", "penn-treebank"), ("WSJ", "penn-treebank"), ("ImageNet", "imagenet-1k"), ("IWSLT14 De-En", "iwslt14-de-en"), ("CIFAR-10", "cifar-10"),
    ("squad", "squad-v1"), ("snli", "glue-snli"), ("foo dataset", "foo"), ("wall street journal", "penn-treebank"), ("tiny imagenet", "tiny imagenet"), ("SST-2", "glue-sst2"), ("glue mnli matched", "glue-mnli"),
    ("wmt", "wmt"), ("WMT 19", "wmt19"), ("ilsvrc 2012", "imagenet-1k"), ("cifar 100", "cifar-100"), ("iwslt 2017 German to English", "iwslt17-de-en"), ("PeMSD7", "pemsd7"), ("newstest19", "newstest2019"),
]


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + a.replace("'", "''") + f"', '{b}')" for a, b in rows)


def _spelled(cases: list[tuple[str, str]], place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x, _ in cases)), (place % len(cases) + 1).cast("int"))


def _spelled_sql(cases: list[tuple[str, str]]) -> str:
    return f"WITH {{CLAIMS}}, v(i, spelling, canonical) AS (VALUES {', '.join(f'({i}, ' + _values([c])[1:] for i, c in enumerate(cases))}) SELECT claim_id, paper_id, spelling, canonical FROM claims JOIN v ON i = dataset % {len(cases)}"


@query("normalize_metric", _spelled_sql(METRIC_CASES))
def normalize_metric(t: Tables) -> DataFrame:
    """Metrics of claims under the names that papers give them."""
    rows = t.claims.where("dataset IS NOT NULL").select("claim_id", "paper_id", _spelled(METRIC_CASES, F.col("dataset")).alias("spelling"))
    return rows.withColumn("canonical", tx.metric_name(F.col("spelling")))


@query("normalize_dataset", _spelled_sql(DATASET_CASES))
def normalize_dataset(t: Tables) -> DataFrame:
    rows = t.claims.where("dataset IS NOT NULL").select("claim_id", "paper_id", _spelled(DATASET_CASES, F.col("dataset")).alias("spelling"))
    return rows.withColumn("canonical", tx.dataset_name(F.col("spelling")))


def _case(column: str, rules, default: str) -> str:
    # RE2 has \\b for ASCII only, which is all that these patterns need
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


@query(
    "intent_classification",
    f"""WITH q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Which results contradict ' WHEN 1 THEN 'What are the limitations of stgcn_yu_2018? ' WHEN 2 THEN 'Compare ' ELSE '' END || text AS question FROM conversations)
    SELECT conv_id, turn, {_case("lower(question)", tx.INTENTS, "general")} AS intent, nullif(regexp_extract(lower(question), '\\b([a-z][a-z0-9]+_[a-z0-9_]+\\d{{4}})\\b', 1), '') AS paper FROM q""",
)
def intent_classification(t: Tables) -> DataFrame:
    head = F.when(F.col("turn") % 4 == 0, "Which results contradict ").when(F.col("turn") % 4 == 1, "What are the limitations of stgcn_yu_2018? ").when(F.col("turn") % 4 == 2, "Compare ").otherwise("")
    q = F.concat(head, "text")
    return t.conversations.select("conv_id", "turn", tx.intent(q).alias("intent"), tx.paper_reference(q).alias("paper"))


@query(
    "keyword_signals",
    """WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), m AS (SELECT *, len(string_split(t, 'model')) - 1 AS n FROM d)
    SELECT doc_id, regexp_matches(t, 'ablation|ablate|sensitivity analysis|component analysis|remove|without|w/o|effect of|contribution of|variant|different versions|we test|we compare|configuration|setting|hyperparameter|heads|layers')
        OR n >= 3 AND regexp_matches(t, 'compare|different|vary') AS has_ablation,
      regexp_matches(t, 'p<|p <|p-value|t-test|wilcoxon|statistical significance|confidence interval|error bar|std dev|standard deviation|±') AS has_significance,
      regexp_matches(t, 'github|code|implementation|available at|open source|open-source|released|https?://') AS has_reproducibility,
      regexp_matches(t, 'words/sec|words per second|tokens/sec|throughput|training time|faster|speed|latency|step/sec') AS has_speed_metrics, CAST(n AS INTEGER) AS n_model FROM m""",
)
def keyword_signals(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *(c.alias(n) for n, c in tx.signals(F.col("text")).items()), (F.size(F.split(F.lower("text"), "model")) - 1).alias("n_model"))


_REAL = (
    "scalability|generalization|long-range|sequential|parallelization|efficiency|modalities|tasks beyond|not tested|restricted to|only evaluated|computational cost|training cost|cannot handle|lack of|absence of|limited to|"
    "does not|unable to|fixed-length|quadratic|out-of-domain|domain|interpretability|explainab|low-resource|multimodal|multi-modal|structured|variable-length|memory|context length|generalise|generaliz|require|constraint|"
    "limitation|beyond translation|non-english|other languages"
)
_ENDS = ["", " The cost is quadratic in memory.", " Dropout is limited to one layer only.", " Results might be due to a small number of runs.", " It does not cover other languages."]


@query(
    "limitation_filter",
    f"""WITH d AS (SELECT doc_id, lower(text || CASE doc_id % 5 {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_ENDS))} END) AS t FROM documents)
    SELECT doc_id, regexp_matches(t, '{_REAL}') AND NOT regexp_matches(t, 'd_k|beam size|dropout|label smoothing') AS meaningful FROM d""",
)
def limitation_filter(t: Tables) -> DataFrame:
    end = F.element_at(F.array(*(F.lit(x) for x in _ENDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return t.documents.select("doc_id", tx.meaningful_limitation(F.concat("text", end)).alias("meaningful"))


_NAMES = "SELECT DISTINCT p_name || CASE p_size % 5 WHEN 0 THEN ' lstm' WHEN 1 THEN ' self-attention' WHEN 2 THEN ' convnet' WHEN 3 THEN ' code' ELSE ' gpu' END AS name FROM part"


@query(
    "method_family",
    f"""WITH n AS ({_NAMES}), l AS (SELECT name, lower(name) AS m FROM n)
    SELECT name, CASE WHEN regexp_matches(m, 'gpu|dgx|tesla|system') THEN 'NOT_METHOD' WHEN regexp_matches(m, 'representation|function|code|transformation|processing') THEN 'WEAK_METHOD'
      WHEN regexp_matches(m, 'lstm|rnn|transformer|attention|cnn|bert') THEN 'VALID_METHOD' WHEN len(string_split(m, ' ')) >= 2 THEN 'WEAK_METHOD' ELSE 'NOT_METHOD' END AS class,
      CASE WHEN regexp_matches(m, 'lstm|rnn') THEN 'recurrent models' WHEN regexp_matches(m, 'transformer|attention') THEN 'transformer models' WHEN regexp_matches(m, 'cnn|conv') THEN 'convolutional models' ELSE m END AS family FROM l""",
)
def method_family(t: Tables) -> DataFrame:
    tail = F.when(F.col("p_size") % 5 == 0, " lstm").when(F.col("p_size") % 5 == 1, " self-attention").when(F.col("p_size") % 5 == 2, " convnet").when(F.col("p_size") % 5 == 3, " code").otherwise(" gpu")
    names = t.part.select(F.concat("p_name", tail).alias("name")).distinct()
    return names.select("name", tx.method_class(F.col("name")).alias("class"), tx.method_family(F.col("name")).alias("family"))


@query(
    "slugs_and_ids",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[-\\s]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') AS slug,
    regexp_replace(url, '[^\\p{L}\\p{N}_.-]', '_', 'g') AS file_name, substr(sha256('page::' || url || '::0'), 1, 12) AS short_id FROM pages""",
)
def slugs_and_ids(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select("page_id", tx.slug(url).alias("slug"), tx.safe_file_name(url).alias("file_name"), tx.short_id(F.lit("page"), url, F.lit("0")).alias("short_id"))


@query(
    "entity_text_cleanup",
    """WITH p AS (SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN '''s ' ELSE '-based model ' END || p_retailprice AS s, p_size FROM part)
    SELECT p_partkey, trim(trim(regexp_replace(regexp_replace(s, '''s\\b', '', 'g'), '-based \\w+', '', 'g')), '.,;:') AS clean, TRY_CAST(regexp_extract(s, '([0-9]+(\\.[0-9]+)?)$', 1) AS DOUBLE) AS number, substr(s, 1, 8) AS head FROM p""",
)
def entity_text_cleanup(t: Tables) -> DataFrame:
    s = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "'s ").otherwise("-based model "), F.regexp_replace(F.col("p_retailprice").cast("string"), "$", ""))
    clean = F.btrim(F.trim(F.regexp_replace(F.regexp_replace(s, r"'s\b", ""), r"-based \w+", "")), F.lit(".,;:"))
    return t.part.select("p_partkey", clean.alias("clean"), F.regexp_extract(s, r"([0-9]+(\.[0-9]+)?)$", 1).try_cast("double").alias("number"), F.substring(s, 1, 8).alias("head"))


#: What the texts of setups say: values in turn, as they are written and as they count.
_OPTIMIZERS, _RATES, _BATCHES, _EPOCHS = ("Adam", "SGD", "AdamW", "RMSprop"), ("0.1", "0.01", "0.001", "0.0001", "1e-5"), ("16", "64", "1024"), ("10", "90", "500")
_DEVICES = (("V100", 4), ("A100", 5), ("H100", 6), ("T4", 3), ("GTX 1080", 1))
_NOTHING = "No setup is given."


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SETUP_VIEW = f"""s AS (SELECT o_orderkey AS id, o_orderkey % 7 = 0 AS none, {_listed(v.lower() for v in _OPTIMIZERS)}[o_custkey % 4 + 1] AS opt, {_listed(_RATES)}[o_orderkey % 5 + 1]::DOUBLE AS lr, ['0.1', '0.01', '0.001', '0.0001', '1e-05'][o_orderkey % 5 + 1] AS lr_text,
    {_listed(_BATCHES)}[o_custkey % 3 + 1]::DOUBLE AS bs, {_listed(_EPOCHS)}[o_orderkey // 5 % 3 + 1]::DOUBLE AS ep, {_listed(n for n, _ in _DEVICES)}[o_custkey % 5 + 1] AS gpu, [4, 5, 6, 3, 1][o_custkey % 5 + 1] AS tier, o_orderstatus = 'P' AND o_orderkey % 7 <> 0 AS saves FROM orders),
  x AS (SELECT id, CASE WHEN NOT none THEN opt END AS opt, CASE WHEN NOT none THEN lr END AS lr, lr_text, CASE WHEN NOT none THEN bs END AS bs, CASE WHEN NOT none THEN ep END AS ep,
    CASE WHEN none THEN 'unknown' WHEN gpu = 'GTX 1080' THEN 'GTX' ELSE gpu END AS hw, CASE WHEN none THEN -1 ELSE tier END AS tier, saves FROM s)"""


def setups(t: Tables) -> DataFrame:
    """The setup that each paper's text names; an order is a paper, and its keys say what was used."""
    at = lambda values, i: F.element_at(F.array(*(F.lit(v) for v in values)), (i + 1).cast("int"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    said = F.format_string(
        "We use %s with a learning rate of %s, batch size %s for %s epochs on 8 x %s GPUs.%s", at(_OPTIMIZERS, cust % 4), at(_RATES, key % 5), at(_BATCHES, cust % 3), at(_EPOCHS, F.floor(key / 5) % 3),
        at([n for n, _ in _DEVICES], cust % 5), F.when(F.col("o_orderstatus") == "P", " Weights are pruned to int8 by pruning.").otherwise(""),
    )
    text = F.when(key % 7 == 0, _NOTHING).otherwise(said)
    return t.orders.select(key.alias("id"), text.alias("text")).select("id", *(c.alias(n) for n, c in tx.setup_values(F.col("text")).items()))


@query("setup_extraction", f"WITH {_SETUP_VIEW} SELECT id, lr AS learning_rate, bs AS batch_size, ep AS epochs, opt AS optimizer, tier::DOUBLE AS hardware_tier, hw AS hardware, saves AS uses_quantization FROM x")
def setup_extraction(t: Tables) -> DataFrame:
    return setups(t).select("id", "learning_rate", "batch_size", "epochs", "optimizer", F.col("hardware_tier").cast("double").alias("hardware_tier"), "hardware", "uses_quantization")


@query(
    "setup_divergence",
    f"""WITH {_SETUP_VIEW}, o AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a, o_orderkey AS b FROM orders),
    p AS (SELECT o.a, o.b, greatest(x.lr, y.lr) / least(x.lr, y.lr) AS lrx, greatest(x.bs, y.bs) / least(x.bs, y.bs) AS bsx, greatest(x.ep, y.ep) / least(x.ep, y.ep) AS epx, x.lr_text AS la, y.lr_text AS lb, x.opt AS oa, y.opt AS ob, x.hw AS ha, y.hw AS hb,
      x.tier >= 0 AND y.tier >= 0 AND abs(x.tier - y.tier) >= 2 AS hw, coalesce(x.opt <> y.opt, false) AS opt, x.lr IS NOT NULL AND y.lr IS NOT NULL AS known, x.saves AS sa, y.saves AS sb FROM o JOIN x ON x.id = o.a JOIN x AS y ON y.id = o.b),
    d AS (SELECT *, known AND lrx >= 10 AS lr, known AND lrx >= 100 AS lr100, known AND bsx >= 8 AS bs, known AND epx >= 5 AS ep FROM p),
    r AS (SELECT *, concat_ws('; ', CASE WHEN lr THEN 'LR differs ' || CAST(round_even(lrx, 0) AS BIGINT) || 'x (' || la || ' vs ' || lb || ')' END, CASE WHEN bs THEN 'batch size differs ' || CAST(round_even(bsx, 0) AS BIGINT) || 'x' END,
      CASE WHEN ep THEN 'training duration differs ' || CAST(round_even(epx, 0) AS BIGINT) || 'x' END, CASE WHEN opt THEN 'different optimizers: ' || oa || ' vs ' || ob END, CASE WHEN hw THEN 'hardware gap: ' || ha || ' vs ' || hb END) AS reasons FROM d)
    SELECT a, b, floor(least(0.35 * lr::INT + 0.25 * hw::INT + 0.20 * bs::INT + 0.15 * ep::INT + 0.15 * opt::INT, 1.0)::DOUBLE * 10000 + 0.5) / 10000 AS divergence,
      CASE WHEN reasons = '' THEN 'No major setup differences detected.' ELSE 'Setup differences: ' || reasons || '.' END AS summary, NOT (lr AND hw OR lr100) AS comparable,
      CASE WHEN lr AND hw THEN 'Both LR and hardware differ significantly.' WHEN lr100 THEN 'LR differs by ' || CAST(round_even(lrx, 0) AS BIGINT) || 'x.' END AS reason, CASE WHEN sa AND NOT sb THEN 'a' WHEN sb AND NOT sa THEN 'b' END AS saves_alone FROM r""",
)
def setup_divergence(t: Tables) -> DataFrame:
    """How far the setups of pairs of papers lie apart, said in words."""
    from .paper_queries import neighbours

    s = setups(t)
    a, b = (s.select(*(F.col(c).alias(f"{c}_{x}") for c in s.columns)) for x in "ab")
    names = [c for c in s.columns if c != "id"]
    d = tx.setup_divergence({n: F.col(f"{n}_a") for n in names}, {n: F.col(f"{n}_b") for n in names})
    pairs = neighbours(t).select(F.col("paper_a").alias("id_a"), F.col("paper_b").alias("id_b")).join(a, "id_a").join(b, "id_b")
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), fixed(d["divergence"]).alias("divergence"), *(d[n].alias(n) for n in ("summary", "comparable", "reason", "saves_alone")))


@query(
    "json_repair",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_id % 4 <> 3 AS valid FROM events WHERE event_id % 4 <> 3
    UNION ALL SELECT event_id, -1, false FROM events WHERE event_id % 4 = 3""",
)
def json_repair(t: Tables) -> DataFrame:
    """Answers wrapped in fences or prose, or broken, are read back."""
    props, n = F.col("props"), F.col("event_id") % 4
    answer = F.when(n == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), props, F.lit(" Done."))).when(n == 3, F.replace(props, F.lit("}"), F.lit(""))).otherwise(props)
    k = F.get_json_object(tx.repair_json(answer), "$.k").try_cast("int")
    return t.events.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), k.isNotNull().alias("valid"))


@query(
    "page_sections",
    f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading,
      len(regexp_extract_all(html, '<p>')) AS n_paragraphs, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages)
    SELECT page_id, title, heading, CAST(n_paragraphs AS INTEGER) AS n_paragraphs, CAST(length(trim(regexp_replace(body, '\\s+', ' ', 'g'))) AS INTEGER) AS text_length, {_case("lower(trim(heading))", tx.SECTIONS, "Unknown")} AS section_type FROM p""",
)
def page_sections(t: Tables) -> DataFrame:
    from ..sources.markup import page_parts

    parts = page_parts(t.pages, "html")
    return parts.select("page_id", "title", "heading", F.size("paragraphs").alias("n_paragraphs"), F.length("body").alias("text_length"), tx.section_type(F.col("heading")).alias("section_type"))


_HEADING = "regexp_replace(lower(trim(heading)), '^[0-9]+([.][0-9]+)*[.]? *', '')"


@query(
    "priority_sections",
    f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading FROM pages), n AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '1. Results of ' WHEN 1 THEN '2.1 References ' ELSE '' END || heading AS heading FROM p),
    s AS (SELECT *, {_case(_HEADING, tx.SECTIONS, "Unknown")} AS section_type FROM n)
    SELECT page_id, heading, section_type FROM s WHERE section_type IN ('Methods', 'Experiments', 'Results', 'Evaluation', 'Abstract', 'Introduction', 'Discussion', 'Conclusion', 'Related Work', 'Limitations', 'Future Work', 'Table', 'Figure')""",
)
def priority_sections(t: Tables) -> DataFrame:
    """Sections that entities are looked for in, by the type of their heading."""
    from ..functions.scholarly import is_priority_section
    from ..sources.markup import page_parts

    number = F.when(F.col("page_id") % 3 == 0, "1. Results of ").when(F.col("page_id") % 3 == 1, "2.1 References ").otherwise("")
    rows = page_parts(t.pages).select("page_id", F.concat(number, "heading").alias("heading"))
    return rows.withColumn("section_type", tx.section_type(F.col("heading"))).where(is_priority_section(F.col("section_type")))


@query(
    "jaccard_docs",
    f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3 AND regexp_matches(x, '^[a-z]') AND x NOT IN ({", ".join(f"'{x}'" for x in tx.STOP_TOKENS)}))) AS t FROM documents),
    s AS (SELECT doc_id, list_sort(t) AS t, min(doc_id) OVER (PARTITION BY list_sort(t)) AS rep FROM w WHERE len(t) > 0), r AS (SELECT doc_id, t FROM s WHERE doc_id = rep)
    SELECT rep AS a, doc_id AS b, 1.0::DOUBLE AS jaccard FROM s WHERE doc_id <> rep
    UNION ALL SELECT a.doc_id, b.doc_id, len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) FROM r AS a JOIN r AS b ON a.doc_id < b.doc_id AND len(a.t) >= 0.6 * len(b.t) AND len(b.t) >= 0.6 * len(a.t) AND len(list_intersect(a.t, b.t)) >= 0.6 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))""",
)
def jaccard_docs(t: Tables) -> DataFrame:
    """Pairs of documents with a similarity of their words of 0.6 or more. Documents with the same words are one: the first of them
    is paired with the others, and stands for them in all other pairs."""
    from ..operators.setjoin import similar_arrays
    from ..session import cut

    words = t.documents.where("doc_id IS NOT NULL").select("doc_id", F.array_sort(tx.tokens(F.col("text"))).alias("t")).where("size(t) > 0")
    said = words.select("doc_id", F.array_join("t", " ").alias("said"))  # words have no spaces, and take less room as one text
    keyed = said.withColumn("key", F.sha2("said", 256))
    first = cut(keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.first("said").alias("said")))
    same = keyed.select("key", F.col("doc_id").alias("b")).join(first.select("key", "a"), "key").where("a <> b").select("a", "b", F.lit(1.0).alias("jaccard"))
    sets = first.select(F.col("a").alias("doc_id"), F.split("said", " ").alias("items"))
    near = similar_arrays(sets.withColumn("n", F.size("items")), "doc_id", 0.6)
    return near.select("a", "b", (F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared"))).alias("jaccard")).unionByName(same)


@query(
    "entity_hint",
    """WITH k AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 9)) AS name FROM benchmark), d AS (SELECT doc_id, lower(text) AS t FROM documents)
    SELECT doc_id, min(name) AS hint, count(*) AS n_names FROM d JOIN k ON contains(t, name) GROUP BY doc_id""",
)
def entity_hint(t: Tables) -> DataFrame:
    """The first of the known names, in their order, that a text holds, and how many it holds; long words of passages are names."""
    from ..operators.dictionary import occurrences

    known = t.benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).where("char_length(name) >= 9").distinct()
    found = occurrences(t.documents.select("doc_id", F.lower("text").alias("text")), "doc_id", "text", known, "name")
    return found.groupBy("doc_id").agg(F.min("name").alias("hint"), F.count(F.lit(1)).alias("n_names"))


@query("sentence_windows")
def sentence_windows(t: Tables) -> DataFrame:
    from ..operators.windows import sentence_windows as windows

    return windows(t.documents, "doc_id", "text", max_words=120, overlap=2)
