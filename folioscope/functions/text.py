"""Text rules as columns: normalisers, slugs, extraction patterns and keyword signals. No Python runs on rows."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import first_match

#: Words that are left out when texts are compared by their tokens.
STOP_TOKENS = "the and for that with this from are was were have has not but our its can which their these than into also such been more other both".split()


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct words of lower-case ASCII letters and digits that start with a letter, stop words left out, in order."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & w.rlike("^[a-z]") & ~w.isin(STOP_TOKENS)))


#: Words that are left out of limitations, and of claims that are held against them.
LIMITATION_STOPS = "the and for are that this with have been from they which their will not can but our more also than such its may each when these use".split()
CLAIM_STOPS = "the a an of is are in to and that this we our with for on by from as at be was it its not but have has their which can also will may".split()


def limitation_tokens(text: Column) -> Column:
    """Distinct words of a letter and two or more letters or digits, stop words of limitations left out."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z0-9]{2,}\b"), F.lit(0))), lambda w: ~w.isin(LIMITATION_STOPS))


def claim_tokens(text: Column) -> Column:
    """As ``limitation_tokens``, with hyphens inside words and the stop words of claims."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z0-9\-]{2,}\b"), F.lit(0))), lambda w: ~w.isin(CLAIM_STOPS))


def long_words(text: Column) -> Column:
    """Distinct words of four or more letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, spaces and hyphens to underscores, other characters dropped, underscores collapsed and trimmed."""
    s = F.regexp_replace(F.lower(F.trim(text)), r"[-\s]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]", ""), "_+", "_")
    return F.btrim(s, F.lit("_"))


def paper_slug(text: Column) -> Column:
    """A slug of three characters or more; a shorter one is an error."""
    made = slug(text)
    return F.when(F.char_length(made) >= 3, made).otherwise(F.raise_error(F.concat(F.lit("no paper id in: "), F.coalesce(text, F.lit("null")))))


def short_id(*parts: Column) -> Column:
    """First 12 hexadecimal digits of the SHA-256 of the parts joined by ``::``."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 12)


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_")


def plain_name(text: Column) -> Column:
    """Lower case, all but letters a-z, digits and spaces blanked, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9 ]", " "), " +", " "))


def stem(word: Column) -> Column:
    """Words over three letters lose every trailing e and s."""
    return F.when(F.length(word) > 3, F.regexp_replace(word, "[es]+$", "")).otherwise(word)


#: What is dropped from the end of a metric's name, canonical names with the whole names that lead to them, and
#: whole names that carry a variant (the name with the variant filled in).
METRIC_NOISE = r"\s+(score|rate|value|metric|result|measure)s?$"
METRICS = (
    ("perplexity", r"^((val(idation)?|test|dev|train(ing)?)[\s-]?(ppl|perplexity)|ppl)$"),
    ("nll", r"^(negative[\s-]?log[\s-]?likelihood|cross[\s-]?entropy|(val(idation)?|test|train(ing)?)[\s-]?loss|nll)$"),
    ("bleu", r"^(tokenized|detokenized|uncased|cased|multi[\s-]?ref)?[\s-]?(sacre)?bleu[\s-]?\d*$"),
    ("rouge-l", r"^rouge$"),
    ("accuracy", r"^(test[\s-]?|val[\s-]?|train[\s-]?)?acc(uracy)?$"),
    ("wer", r"^(word[\s-]?error[\s-]?rate|wer)$"),
    ("cer", r"^(char(acter)?[\s-]?error[\s-]?rate|cer)$"),
)
METRIC_VARIANTS = (
    ("rouge-$1", r"^rouge[\s-]?([l\d]+)$"),
    ("f$2-$1", r"^(macro|micro|weighted)[\s-]?f[\s-]?(\d)$"),
    ("f$1", r"^f[\s-]?(\d)$"),
    ("top-$1", r"^top[\s-]?(\d)[\s-]?(?:accuracy|acc)?$"),
    ("$1-time", r"^(training|inference)[\s-]?time$"),
)


def metric_name(text: Column) -> Column:
    """The canonical name of a metric; unknown ones in lower case."""
    t = F.regexp_replace(F.trim(F.lower(text)), METRIC_NOISE, "")
    variants = [F.when(t.rlike(pattern), F.regexp_replace(t, pattern, name)) for name, pattern in METRIC_VARIANTS]
    return F.coalesce(first_match(t, METRICS), *variants, t)


#: What is dropped from the end of a dataset's name, ways to write a pair of languages and its code, and canonical
#: names with the whole names that lead to them.
DATASET_NOISE = r"\s+(dataset|corpus|data|set|benchmark|task|collection|test set|training set)s?$"
LANGUAGE_PAIRS = (
    ("en-de", r"english[\s-]?(to[\s-])?german"),
    ("de-en", r"german[\s-]?(to[\s-])?english"),
    ("en-fr", r"english[\s-]?(to[\s-])?french"),
    ("fr-en", r"french[\s-]?(to[\s-])?english"),
    ("en-zh", r"english[\s-]?(to[\s-])?chinese"),
    ("en-ja", r"english[\s-]?(to[\s-])?japanese"),
    ("en-ro", r"english[\s-]?(to[\s-])?romanian"),
    ("en-de", r"\ben[\s-]de\b"),
    ("en-fr", r"\ben[\s-]fr\b"),
    ("en-zh", r"\ben[\s-]zh\b"),
    ("de-en", r"\bde[\s-]en\b"),
)
DATASETS = (
    ("wmt", r"^wmt$"),
    ("squad-v1", r"^squad$"),
    ("penn-treebank", r"^(penn[\s-]?treebank|ptb|wall[\s-]?street[\s-]?journal|wsj)$"),
    ("imagenet-1k", r"^(imagenet|ilsvrc)[\s-]?(1k|2012)?$"),
)
#: Tasks of the language-understanding suite.
GLUE = "mnli|snli|qnli|qqp|cola|mrpc|rte|wnli|stsb|sst"


def dataset_name(text: Column) -> Column:
    """The canonical name of a dataset; unknown ones in lower case."""
    t = F.regexp_replace(F.trim(F.lower(text)), DATASET_NOISE, "")

    def dated(pattern: str, head: str) -> Column:
        """head + two digits of the year, and a pair of languages if one follows."""
        rest = F.regexp_replace(F.regexp_extract(t, pattern, 2), r"^[\s-]+|[\s-]+$", "")
        for code, written in LANGUAGE_PAIRS:
            rest = F.regexp_replace(rest, written, code)
        return F.when(t.rlike(pattern), F.concat_ws("-", F.concat(F.lit(head), F.right(F.regexp_extract(t, pattern, 1), F.lit(2))), F.when(rest != "", rest)))

    test = F.regexp_extract(t, r"^(?:newstest|ntst)[\s-]?(\d{2,4})$", 1)
    squad, cifar = F.regexp_extract(t, r"^squad[\s-]?v?(\d)[.\d]*$", 1), F.regexp_extract(t, r"^cifar[\s-]?(\d+)$", 1)
    task = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[\s-](matched|mismatched)$", ""), r"^glue[\s-]?", ""), r"[\s-]", "")
    return F.coalesce(
        dated(r"^wmt[\s'\u2019`]?(\d{2,4})[\s-]?(.*)$", "wmt"),
        F.when(test != "", F.concat(F.lit("newstest"), F.when(F.length(test) == 2, F.concat(F.lit("20"), test)).otherwise(test))),
        F.when(squad != "", F.concat(F.lit("squad-v"), squad)),
        F.when(t.rlike(rf"^(glue[\s-]?)?({GLUE})[\s-]?(matched|mismatched|\d)?$"), F.concat(F.lit("glue-"), task)),
        dated(r"^iwslt[\s'\u2019]?(\d{2,4})[\s-]?(.*)$", "iwslt"),
        F.when(cifar != "", F.concat(F.lit("cifar-"), cifar)),
        first_match(t, DATASETS),
        t,
    )


#: Question intents in the order in which they are tried, and the patterns that lead to them.
INTENTS = (
    ("limitation", r"\blimitation|\bweakness|\bshortcoming|\bproblem with|\bissue with|\bdrawback|\bwhat.{0,20}wrong|\bwhat.{0,20}bad"),
    ("future_work", r"\bfuture work|\bfuture direction|\bnext step|\bopen problem|\bopen question|\bto be explored|\bwhat.{0,20}next|\bwhat.{0,20}remain"),
    ("comparison", r"\bcompar|\bvs\b|\bversus|\boutperform|\bfaster than|\bbetter than|\bworse than|\bcontradiction|\bconflict|\bdisagree|\bdifference between|\bhow does .{0,30} differ"),
    ("performance", r"\bperformance|\baccuracy|\bresult|\bscore|\brmse\b|\bmae\b|\bf1\b|\bbleu\b|\bbenchmark|\bevaluat|\bhow well|\bhow (good|accurate|fast)"),
    ("gap", r"\bgap|\bnobody|\bno one|\bnot (yet )?tried|\buntried|\bmissing combination|\bwhich.{0,30}(hasn.t|have not|not been) (been )?tested|\bwhich.{0,30}(hasn.t|have not) (been )?explored|\bwhat.{0,30}(hasn.t|have not|not been) (been )?tested|\bwhat.{0,30}(hasn.t|have not) (been )?explored"),
    ("entity_lookup", r"\bwhat is\b|\bwhat are\b|\bwhich (method|model|dataset|metric)|\btell me about\b|\bexplain\b|\bhow does .{0,30} work"),
    ("figure", r"\bfigure\b|\bdiagram\b|\barchitecture diagram|\bshow.{0,20}figure|\bfig\.?\s*\d"),
    ("literature_review", r"\bliterature review|\bsurvey|\bsummar|\boverview|\bwrite.{0,20}review|\bwhat do (the )?papers say"),
)


def intent(question: Column) -> Column:
    """The first intent whose pattern is found in the question, else general."""
    return first_match(F.lower(question), INTENTS, "general")


def paper_reference(question: Column) -> Column:
    """The first word like name_topic_2018 in a question, or null."""
    found = F.regexp_extract(F.lower(question), r"\b([a-z][a-z0-9]+_[a-z0-9_]+\d{4})\b", 1)
    return F.when(found != "", found)


#: Words by which a text reports ablations, variants of a model, significance, its code, and speed.
ABLATION = ("ablation", "ablate", "sensitivity analysis", "component analysis", "remove", "without", "w/o", "effect of", "contribution of")
VARIANTS = ("variant", "variants", "different versions", "we test", "we compare", "configuration", "setting", "hyperparameter", "heads", "layers")
SIGNIFICANCE = ("p<", "p <", "p-value", "t-test", "wilcoxon", "statistical significance", "confidence interval", "error bar", "std dev", "standard deviation", "±")
REPRODUCIBILITY = ("github", "code", "implementation", "available at", "open source", "open-source", "released", "https://", "http://")
SPEED = ("words/sec", "words per second", "tokens/sec", "throughput", "training time", "faster", "speed", "latency", "step/sec")
#: Words that, with a model named three times, speak of models that are compared.
COMPARED = ("compare", "different", "vary")


#: Tuning details that are never research gaps, and wording that marks a limitation as a real one.
TUNING = ("d_k", "beam size", "dropout", "label smoothing")
REAL = (
    "scalability", "generalization", "long-range", "sequential", "parallelization", "efficiency", "modalities", "tasks beyond", "not tested", "restricted to", "only evaluated",
    "computational cost", "training cost", "cannot handle", "lack of", "absence of", "limited to", "does not", "unable to", "fixed-length", "quadratic", "out-of-domain", "domain",
    "interpretability", "explainab", "low-resource", "multimodal", "multi-modal", "structured", "variable-length", "memory", "context length", "generalise", "generaliz", "require",
    "constraint", "limitation", "beyond translation", "non-english", "other languages",
)


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of some literal strings; a search for each is much faster than a pattern of alternatives."""
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def signals(text: Column) -> dict[str, Column]:
    """Which kinds of evidence a text reports: has_ablation, has_significance, has_reproducibility, has_speed_metrics.

    An ablation is also what names variants, or names a model three times and compares."""
    t = F.lower(text)
    compares = (F.size(F.split(t, "model")) > 3) & holds_any(t, COMPARED)
    found = {"has_ablation": holds_any(t, ABLATION) | holds_any(t, VARIANTS) | compares}
    return found | {f"has_{n}": holds_any(t, w) for n, w in (("significance", SIGNIFICANCE), ("reproducibility", REPRODUCIBILITY), ("speed_metrics", SPEED))}


def meaningful_limitation(text: Column) -> Column:
    """Whether a limitation names a real constraint and no tuning detail."""
    t = F.lower(text)
    return holds_any(t, REAL) & ~holds_any(t, TUNING)


#: Families of methods, tried in order.
FAMILIES = (("recurrent models", "lstm|rnn"), ("transformer models", "transformer|attention"), ("convolutional models", "cnn|conv"))
#: Parts of names that are no methods, that are too weak to name one, and that always do.
NOT_METHODS, WEAK_METHODS, METHODS = ("gpu", "dgx", "tesla", "system"), ("representation", "function", "code", "transformation", "processing"), ("lstm", "rnn", "transformer", "attention", "cnn", "bert")


def method_class(name: Column) -> Column:
    """NOT_METHOD, WEAK_METHOD or VALID_METHOD; of unknown names, those of several words are weak."""
    n = F.lower(name)
    found = F.when(holds_any(n, NOT_METHODS), "NOT_METHOD").when(holds_any(n, WEAK_METHODS), "WEAK_METHOD").when(holds_any(n, METHODS), "VALID_METHOD")
    return found.when(F.size(F.split(F.trim(n), r"\s+")) >= 2, "WEAK_METHOD").otherwise("NOT_METHOD")


def method_family(name: Column) -> Column:
    n = F.lower(name)
    return F.coalesce(first_match(n, FAMILIES), n)


#: Hyper-parameters and the patterns of their values, the first that is found counts.
SETUP = {
    "learning_rate": (r"learning[\s_-]?rate[s]?\s*[=:of]*\s*([\d.e+\-]+)", r"\blr\s*[=:]\s*([\d.e+\-]+)", r"(?:set|use[sd]?)\s+(?:a\s+)?learning[\s_-]?rate\s+of\s+([\d.e+\-]+)"),
    "batch_size": (r"batch[\s_-]?size[s]?\s*(?:of\s+)?[=:of]*\s*(\d+)", r"\bbs\s*[=:]\s*(\d+)", r"mini[\s_-]?batch(?:es)?\s+of\s+(\d+)"),
    "epochs": (r"(\d+)\s+epoch[s]?", r"epoch[s]?\s*[=:]\s*(\d+)", r"train(?:ed|ing)?\s+for\s+(\d+)\s+epoch[s]?"),
    "optimizer": (r"\b(adam(?:w)?|sgd|adagrad|rmsprop|adamax|nadam|lion)\b",),
    "weight_decay": (r"weight[\s_-]?decay\s*[=:of]*\s*([\d.e+\-]+)",),
    "dropout": (r"dropout\s*(?:rate\s*)?[=:of]*\s*([\d.]+)",),
    "warmup_steps": (r"warmup[\s_-]?steps?\s*[=:of]*\s*(\d+)", r"linear\s+warmup\s+(?:over\s+)?(\d+)\s+step[s]?"),
    "max_seq_length": (r"max(?:imum)?\s+seq(?:uence)?\s+length\s*[=:of]*\s*(\d+)", r"(?:input\s+)?(?:context\s+)?length\s+of\s+(\d+)\s+token[s]?"),
}
#: Accelerators, their tier and the pattern of their name; how their number is written; what saves computation.
HARDWARE = (
    ("H100", 6, r"\bh100\b"), ("A100", 5, r"\ba100\b"), ("V100", 4, r"\bv100\b"), ("TPU", 4, r"\btpu\b"), ("T4", 3, r"\bt4\b"), ("P100", 3, r"\bp100\b"),
    ("RTX 3/4000", 2, r"\brtx\s*[34]\d{3}"), ("GTX", 1, r"\bgtx\s*\d{4}"), ("CPU-Xeon", 0, r"\bxeon\b"),
)
DEVICES = r"(\d+)\s*[×x]\s*(?:nvidia\s+)?(?:gpu[s]?|h100|a100|v100|t4|p100)"
CLUSTER = r"\b(?:distributed|multi[\s-]?(?:gpu|node)|cluster|data[\s-]?parallel|\d+\s+node[s]?)\b"
PRECISIONS = (("bf16", "bf16"), ("fp16", "fp16"), ("fp32", "fp32"), ("mixed-precision", r"mixed[\s-]?precision"))
SAVINGS = (("uses_quantization", "quantiz|4-bit|8-bit|int8"), ("uses_pruning", r"\bprun(?:ing|ed)\b"), ("uses_distillation", r"\b(?:distillation|distilled|knowledge[\s-]?distill)\b"))


def setup_values(text: Column) -> dict[str, Column]:
    """The experimental setup that a text names: hyper-parameters (null where not found or no number), hardware_tier (-1: none
    named), n_devices, is_cluster, precision, what saves computation, and a confidence of a tenth for each thing found."""
    t, found = F.lower(text), {}
    for name, patterns in SETUP.items():
        raw = F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p in patterns))
        number = raw.try_cast("double")
        found[name] = raw if name == "optimizer" else F.floor(number).cast("double") if name in ("batch_size", "epochs", "warmup_steps", "max_seq_length") else number
    found["hardware_tier"] = F.greatest(F.lit(-1), *(F.when(t.rlike(p), F.lit(tier)).otherwise(F.lit(-1)) for _, tier, p in HARDWARE))
    named = F.filter(F.array(*(F.when(t.rlike(p), F.lit(n)) for n, _, p in HARDWARE)), lambda x: x.isNotNull())
    found["hardware"] = F.coalesce(F.nullif(F.array_join(named, ", "), F.lit("")), F.lit("unknown"))
    found["n_devices"] = F.when(t.rlike(DEVICES), F.regexp_extract(t, DEVICES, 1)).try_cast("int")
    found["is_cluster"] = t.rlike(CLUSTER)
    found["precision"] = first_match(t, PRECISIONS)
    found |= {name: t.rlike(pattern) for name, pattern in SAVINGS}
    things = [c.isNotNull() for n, c in found.items() if n in (*SETUP, "n_devices", "precision")] + [found["hardware_tier"] >= 0, found["is_cluster"], *(found[n] for n, _ in SAVINGS)]
    n = things[0].cast("int")
    for x in things[1:]:
        n = n + x.cast("int")
    return found | {"confidence": F.least(F.lit(1.0), n / 10)}


def number_text(x: Column) -> Column:
    """A positive number as it is usually written: 0.001, 64.0, 1e-05."""
    raw = x.cast("string")
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    small = F.concat(F.regexp_replace(F.regexp_extract(raw, "^([0-9.]+)E", 1), r"\.0$", ""), F.lit("e-"), F.lpad(F.regexp_extract(raw, "E-([0-9]+)$", 1), 2, "0"))
    return F.when(x < 1e-4, small).otherwise(plain)


def setup_divergence(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """How far two setups lie apart: a score in [0, 1], a summary with a reason for each difference, whether they can be compared and
    why not, and which of the two (a or b) alone saves computation."""
    ratio = lambda k: F.greatest(a[k], b[k]) / F.nullif(F.least(a[k], b[k]), F.lit(0.0))  # noqa: E731  null-skipping, so guard
    both = lambda k: (a[k] > 0) & (b[k] > 0)
    over = lambda k, n: F.coalesce(F.when(both(k), ratio(k) >= n), F.lit(False))
    times = lambda k: F.concat(F.bround(ratio(k)).cast("long").cast("string"), F.lit("x"))
    lr, batch, epochs = over("learning_rate", 10), over("batch_size", 8), over("epochs", 5)
    hardware = F.when((a["hardware_tier"] >= 0) & (b["hardware_tier"] >= 0), F.abs(a["hardware_tier"] - b["hardware_tier"]) >= 2).otherwise(F.lit(False))
    optimizer = F.when(a["optimizer"].isNotNull() & b["optimizer"].isNotNull(), a["optimizer"] != b["optimizer"]).otherwise(F.lit(False))
    score = F.least(0.35 * lr.cast("int") + 0.25 * hardware.cast("int") + 0.20 * batch.cast("int") + 0.15 * epochs.cast("int") + 0.15 * optimizer.cast("int"), F.lit(1.0))
    reasons = F.concat_ws(
        "; ",
        F.when(lr, F.concat(F.lit("LR differs "), times("learning_rate"), F.lit(" ("), number_text(a["learning_rate"]), F.lit(" vs "), number_text(b["learning_rate"]), F.lit(")"))),
        F.when(batch, F.concat(F.lit("batch size differs "), times("batch_size"))),
        F.when(epochs, F.concat(F.lit("training duration differs "), times("epochs"))),
        F.when(optimizer, F.concat(F.lit("different optimizers: "), a["optimizer"], F.lit(" vs "), b["optimizer"])),
        F.when(hardware, F.concat(F.lit("hardware gap: "), a["hardware"], F.lit(" vs "), b["hardware"])),
    )
    summary = F.when(reasons == "", "No major setup differences detected.").otherwise(F.concat(F.lit("Setup differences: "), reasons, F.lit(".")))
    why = F.when(lr & hardware, "Both LR and hardware differ significantly.").when(over("learning_rate", 100), F.concat(F.lit("LR differs by "), times("learning_rate"), F.lit(".")))
    saves = {x: s["uses_quantization"] | s["uses_pruning"] | s["uses_distillation"] for x, s in (("a", a), ("b", b))}
    alone = F.when(saves["a"] & ~saves["b"], "a").when(saves["b"] & ~saves["a"], "b")
    return {"divergence": score, "summary": summary, "comparable": why.isNull(), "reason": why, "saves_alone": alone}


#: Section types by what is found in the heading, first match wins.
SECTIONS = (
    ("Abstract", r"abstract"),
    ("Introduction", r"introduction"),
    ("Related Work", r"related\s+work|prior\s+work|literature\s+review"),
    ("Background", r"^background$|^preliminar"),
    ("Future Work", r"future\s+(research|work|direction)"),
    ("Experiments", r"^training$|training\s+(data|detail|regime|procedure|setup|batching)|hardware|schedule|optimizer|regularization"),
    ("Experiments", r"experiment|empirical|evaluation\s+setup|implementation\s+detail"),
    ("Results", r"result|performance|benchmark|english\s+constituency|machine\s+translation"),
    ("Results", r"variation|ablation|benefit\s+of|training\s+efficienc"),
    ("Methods", r"method|approach|architecture|framework|proposed|models?"),
    ("Discussion", r"discussion|why\s+|analysis|comparison|motivation"),
    ("Conclusion", r"conclusion|summary"),
    ("Limitations", r"limitation"),
    ("Acknowledgements", r"acknowledg"),
    ("References", r"reference|bibliograph|appendix"),
)


def section_type(heading: Column) -> Column:
    """The type of a section by its heading, numbering stripped."""
    return first_match(F.regexp_replace(F.lower(F.trim(heading)), r"^\d+(\.\d+)*\.?\s*", ""), SECTIONS, "Unknown")


def repair_json(text: Column) -> Column:
    """The first object of an answer, code fences stripped: from its brace to the one that closes it, braces in strings left out.
    Null if there is no object or it is never closed. ``from_json`` then reads it leniently."""
    bare = F.regexp_replace(text, r"```(?:json)?", "")
    rest = F.substring(bare, F.instr(bare, "{"), F.char_length(bare))
    state = lambda depth, quoted, escaped, n, end: F.struct(depth.alias("depth"), quoted.alias("quoted"), escaped.alias("escaped"), n.alias("n"), end.alias("end"))

    def step(s: Column, c: Column) -> Column:
        live = s["end"] == 0
        quote = (c == '"') & ~s["escaped"]
        plain = ~s["quoted"] & ~s["escaped"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        closed = live & plain & (c == "}") & (depth == 0)
        return state(depth, s["quoted"] != quote, (c == "\\") & s["quoted"] & ~s["escaped"], s["n"] + 1, F.when(closed, s["n"] + 1).otherwise(s["end"]))

    end = F.aggregate(F.split(rest, ""), state(F.lit(0), F.lit(False), F.lit(False), F.lit(0), F.lit(0)), step, lambda s: s["end"])
    return F.when(F.contains(bare, F.lit("{")) & (end > 0), F.substring(rest, F.lit(1), end))
