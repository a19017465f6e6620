"""Papers against each other and their parts: validated claims, typed entities, slots of claims, features of pairs and gaps.

Tables are long: a row is a mention, a claim or a pair, so nothing grows with how common an entity is. Nulls never match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scholarly import KNOWN_DATASET, KNOWN_METRIC, garbage_heading, is_setup_section
from ..functions.scores import fixed
from ..functions.text import method_class, method_family

#: Kinds of claims and entities that are kept, the kinds of gaps and the weight of their priorities.
CLAIM_TYPES = ("performance", "comparative", "methodological")
ENTITY_TYPES = ("method", "dataset", "metric", "task")
GAP_TYPES = ("combinatorial", "limitation", "cross_paper")
PRIORITIES = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.1}
#: Words of a weakness that say a kind of evidence is absent, in order, and the evidence they speak of.
ABSENCE = (
    ("speed", "has_speed_metrics"), ("training_time", "has_speed_metrics"), ("throughput", "has_speed_metrics"), ("fast", "has_speed_metrics"), ("ablation", "has_ablation"),
    ("significance", "has_significance"), ("statistical", "has_significance"), ("reproducib", "has_reproducibility"), ("code", "has_reproducibility"), ("github", "has_reproducibility"),
)
AUTHORITY = (("ablation", "has_ablation"), ("significance", "has_significance"), ("repro", "has_reproducibility"), ("speed", "has_speed_metrics"))
ONE_DATASET = ("single dataset", "only one dataset", "single-dataset")


def validated_claims(claims: DataFrame, text: str = "description", kind: str = "claim_type", entities: str = "entities_involved", confidence: str = "confidence") -> DataFrame:
    """Claims of a known kind with a text and an entity: texts trimmed, kinds in lower case, blank entities dropped, confidence to
    four digits (none: 0)."""
    named = F.filter(F.col(entities), lambda e: F.trim(e) != "")
    out = claims.withColumns({text: F.trim(text), kind: F.lower(kind), entities: named, confidence: fixed(F.coalesce(F.col(confidence), F.lit(0.0)))})
    return out.where((F.col(text) != "") & F.col(kind).isin(*CLAIM_TYPES) & (F.size(entities) > 0))


def validated_entities(entities: DataFrame, text: str = "text", kind: str = "entity_type", confidence: str = "confidence", least: float = 0.5) -> DataFrame:
    """Entities of a known kind with a text and enough confidence."""
    out = entities.withColumns({text: F.trim(text), kind: F.lower(kind), confidence: fixed(F.coalesce(F.col(confidence), F.lit(0.0)))})
    return out.where((F.col(text) != "") & F.col(kind).isin(*ENTITY_TYPES) & (F.col(confidence) >= least))


def typed_entities(mentions: DataFrame, sources: Sequence[str], paper: str = "paper_id", source: str = "source", kind: str = "entity_type", text: str = "text") -> DataFrame:
    """Distinct entities of each paper by kind, from the first of its ``sources`` (indexes, in order of preference); papers that none
    of them covers take all their other mentions, in lower case."""
    place = F.coalesce(*(F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(sources)), F.lit(len(sources)))
    ranked = mentions.withColumn("__place", place).withColumn("__best", F.min(place).over(Window.partitionBy(paper))).where("__place = __best")
    name = F.when(F.col("__place") < len(sources), F.col(text)).otherwise(F.trim(F.lower(text)))
    return ranked.select(paper, kind, name.alias(text)).where(F.col(kind).isin(*ENTITY_TYPES) & (F.col(text) != "")).distinct()


def clean_entities(typed: DataFrame, paper: str = "paper_id", kind: str = "entity_type", text: str = "text") -> DataFrame:
    """Names over two letters in lower case; methods by their family, and only those that are methods."""
    name = F.trim(F.lower(text))
    out = typed.where(F.length(F.trim(text)) > 2).where((F.col(kind) != "method") | (method_class(name) == "VALID_METHOD"))
    return out.select(paper, kind, F.when(F.col(kind) == "method", method_family(name)).otherwise(name).alias(text)).distinct()


def claimed_together(claims: DataFrame, entities: DataFrame, a: str = "method", b: str = "dataset", paper: str = "paper_id", claim: str = "claim_id", text: str = "text", kind: str = "entity_type", name: str = "entity") -> DataFrame:
    """Pairs of entities of two kinds that one claim of their paper names both, and in how many claims; equi-joins on the paper."""
    mine = entities.select(paper, F.col(kind).alias("__kind"), F.lower(name).alias("__name")).where(F.col("__kind").isin(a, b)).distinct()
    named = claims.select(paper, claim, F.lower(text).alias("__text")).join(mine, paper).where(F.contains("__text", "__name")).select(paper, claim, "__kind", "__name")
    left = named.where(F.col("__kind") == a).select(paper, claim, F.col("__name").alias(a))
    right = named.where(F.col("__kind") == b).select(paper, claim, F.col("__name").alias(b))
    return left.join(right, [paper, claim]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n_claims"))


def resolved_slots(candidates: DataFrame, claim: list[str], pos: str = "pos", raw: str = "raw", kind: str = "entity_type", name: str = "canonical", similarity: str = "similarity") -> DataFrame:
    """One metric, one dataset and the methods of each claim, from candidates (mention, kind, canonical name, similarity).

    Mentions come in order. A known metric only tries the metric slot and a known dataset only the dataset slot; others go to the
    kind of their nearest candidate among the kinds whose slot is free (methods and tasks always are). Ties go to metric,
    dataset, method, task, then the smaller name. Only the mentions of one claim are gathered.
    """
    order = ("metric", "dataset", "method", "task")
    best = lambda k: F.max_by(F.struct(F.col(name).alias("name"), F.col(similarity).alias("sim")), F.when(F.col(kind) == k, F.struct(F.col(similarity), -F.col("__n")))).alias(k)
    tied = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*claim, pos, raw, kind).orderBy(F.col(similarity).desc(), name)))
    rows = tied.groupBy(*claim, pos, raw).agg(*(best(k) for k in order))
    listed = F.array_sort(F.collect_list(F.struct(pos, raw, *order)))
    text = lambda: F.lit(None).cast("string")
    start = F.struct(text().alias("metric"), text().alias("dataset"), F.array().cast("array<string>").alias("methods"))

    def step(acc: Column, x: Column) -> Column:
        metric, dataset = acc["metric"].isNull(), acc["dataset"].isNull()
        a_metric, a_dataset = x[raw].rlike(KNOWN_METRIC), x[raw].rlike(KNOWN_DATASET) & ~x[raw].rlike(KNOWN_METRIC)
        other = ~a_metric & ~a_dataset
        usable = {"metric": metric & (a_metric | other), "dataset": dataset & (a_dataset | other), "method": other, "task": other}
        sims = {k: F.coalesce(F.when(usable[k], x[k]["sim"]), F.lit(0.0)) for k in order}
        top = F.greatest(*sims.values())
        won, taken = {}, top <= 0
        for k in order:
            won[k] = ~taken & (sims[k] == top)
            taken = taken | won[k]
        added = F.when(won["method"], F.array(x["method"]["name"])).when(won["task"], F.array(x["task"]["name"])).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.when(won["metric"], x["metric"]["name"]).otherwise(acc["metric"]).alias("metric"),
            F.when(won["dataset"], x["dataset"]["name"]).otherwise(acc["dataset"]).alias("dataset"),
            F.concat(acc["methods"], added).alias("methods"),
        )

    return rows.groupBy(*claim).agg(F.aggregate(listed, start, step).alias("__slots")).select(*claim, "__slots.metric", "__slots.dataset", "__slots.methods")


def entity_sets(mentions: DataFrame, kinds: Sequence[str] = ENTITY_TYPES, paper: str = "paper_id", kind: str = "entity_type", name: str = "entity") -> DataFrame:
    """One row a paper: for each kind the array of its distinct entities, as long as the paper's mentions at most."""
    return mentions.groupBy(paper).agg(*(F.collect_set(F.when(F.col(kind) == k, F.col(name))).alias(k) for k in kinds))


def pair_overlaps(pairs: DataFrame, mentions: DataFrame, kinds: Sequence[str] = ENTITY_TYPES, paper: str = "paper_id", kind: str = "entity_type", name: str = "entity", a: str = "paper_a", b: str = "paper_b") -> DataFrame:
    """``set_overlaps`` of the distinct ``pairs``, from a row for each mention of an entity."""
    return set_overlaps(pairs.select(a, b).distinct(), entity_sets(mentions, kinds, paper, kind, name), kinds, paper, a, b).select(a, b, *(f"shared_{k}" for k in ("entity", *kinds)), *(f"{k}_overlap" for k in ("entity", *kinds)))


def set_overlaps(pairs: DataFrame, sets: DataFrame, kinds: Sequence[str] = ENTITY_TYPES, paper: str = "paper_id", a: str = "paper_a", b: str = "paper_b", carry: Sequence[str] = ()) -> DataFrame:
    """Of given pairs of papers: shared entities and Jaccard overlap, of all kinds but metrics together and of each kind.

    Both papers' sets are joined to the pair, one row each, and compared there: pairs are never formed here, and no entity is
    joined by itself. Columns of ``pairs`` stay, and columns ``carry`` of the sets come along as ``{c}_a`` and ``{c}_b``, so that
    nothing has to be joined to the pairs again.
    """
    side = lambda key, tag: sets.select(F.col(paper).alias(key), *(F.col(k).alias(f"{k}_{tag}") for k in (*kinds, *carry)))
    own = [*pairs.columns, *(f"{c}_{tag}" for c in carry for tag in "ab")]
    return met_overlaps(pairs.join(side(a, "a"), a, "left").join(side(b, "b"), b, "left"), own, kinds)


def met_overlaps(both: DataFrame, own: Sequence[str], kinds: Sequence[str] = ENTITY_TYPES) -> DataFrame:
    """``set_overlaps`` of pairs that have both papers' sets, ``{kind}_a`` and ``{kind}_b``, and the columns ``own``, which stay."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    none = F.array().cast("array<string>")

    def together(x: str) -> Column:
        """The entities of a side that are compared as one set: all kinds but metrics, whatever their kind."""
        held = none
        for k in kinds:
            if k != "metric":
                held = F.array_union(held, F.coalesce(F.col(f"{k}_{x}"), none))
        return held

    rows = both.select(*own, *(size(F.array_intersect(f"{k}_a", f"{k}_b")).cast("long").alias(f"shared_{k}") for k in kinds), *((size(F.col(f"{k}_a")) + size(F.col(f"{k}_b"))).alias(f"__n_{k}") for k in kinds), *(together(x).alias(f"__all_{x}") for x in "ab"))
    rows = rows.withColumn("shared_entity", size(F.array_intersect("__all_a", "__all_b")).cast("long")).withColumn("__n_entity", size(F.col("__all_a")) + size(F.col("__all_b")))
    ratio = lambda k: F.when(F.col(f"__n_{k}") > F.col(f"shared_{k}"), F.col(f"shared_{k}") / (F.col(f"__n_{k}") - F.col(f"shared_{k}"))).otherwise(F.lit(0.0))
    return rows.select(*own, *(f"shared_{k}" for k in ("entity", *kinds)), *(ratio(k).alias(f"{k}_overlap") for k in ("entity", *kinds)))


def pair_score(dataset: Column, divergence: Column, entity: Column, metric: Column, task: Column, cites: Column, setup: Column) -> Column:
    """How much there is to compare in a pair of papers; the weights are fixed and add up to one."""
    return fixed(0.30 * dataset + 0.25 * divergence + 0.15 * entity + 0.10 * metric + 0.05 * task + 0.05 * cites.cast("double") + 0.10 * (1.0 - F.least(setup, F.lit(1.0))))


def pair_vector(row: dict[str, Column]) -> Column:
    """The ten features of a pair in their fixed order."""
    names = ("entity_overlap", "dataset_overlap", "metric_overlap", "task_overlap", "result_divergence", "shared_dataset_count", "shared_method_count", "citation_link", "year_diff", "setup_divergence")
    return F.array(*(row[n].cast("double") for n in names))


def judged_contradictions(found: DataFrame, subject_a: Column, subject_b: Column, comparable: Column, on_time: Column, other_hardware: Column, other_rate: Column) -> DataFrame:
    """Contradictions with ``filter_reason`` (null: a real one) and the severity that is left.

    Claims about different subjects compare systems and are LOW; setups that can't be compared come next, then times on other
    hardware. A real one under other learning rates is MEDIUM. Unknown subjects count as equal, unknown conditions as false.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    different = true((subject_a != "") & (subject_b != "") & (subject_a != subject_b))
    reason = F.when(different, "different_subjects").when(~F.coalesce(comparable, F.lit(True)), "incomparable_setup").when(true(on_time) & true(other_hardware), "hardware_variance")
    left = F.when(F.col("filter_reason") == "different_subjects", "LOW").when(F.col("filter_reason").isNull() & true(other_rate), "MEDIUM").otherwise(F.col("severity"))
    return found.withColumn("filter_reason", reason).withColumn("severity", left)


def with_answers(found: DataFrame, answers: DataFrame, on: list[str], order: Sequence[str] = ("HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Contradictions with the classification that was answered for their metric and dataset. An answer can lower a severity,
    never raise it; ``answers`` has ``on``, classification and proposed, one row a key."""
    rank = lambda c: F.coalesce(*(F.when(F.upper(c) == s, F.lit(i)) for i, s in enumerate(order)))
    lower = F.coalesce(rank(F.col("proposed")) > rank(F.col("severity")), F.lit(False))
    return found.join(answers.select(*on, "classification", "proposed"), on, "left").withColumn("severity", F.when(lower, F.upper("proposed")).otherwise(F.col("severity"))).drop("proposed")


def confirmed_confidence(confirmed: Column, boost: Column, confidence: Column) -> Column:
    """The confidence of a complement: 0.85 if its finding was confirmed, or 0.90 with a boost by the setup; else the one it has."""
    return F.when(confirmed, F.when(boost, F.lit(0.90)).otherwise(F.lit(0.85))).otherwise(confidence)


def gap_vector(gap_type: Column, priority: Column, confidence: Column, entities: Column, papers: Column, n_candidates: Column, redundancy: Column, validated: Column, needs_review: Column, addressed: Column, context: Sequence[Column]) -> Column:
    """The eighteen features of a candidate gap: its type one-hot, priority, confidence, breadth, redundancy, flags, the six values of
    the session and a one. ``context``: papers, contradictions, high critiques, matrix used, diversity, mean coverage gain."""
    n_papers, n_contradictions, n_critiques, used, diversity, gain = context
    one = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    part = lambda n, most: F.least(n / most, F.lit(1.0))
    weight = F.coalesce(*(F.when(priority == k, F.lit(v)) for k, v in PRIORITIES.items()), F.lit(0.5))
    return F.array(
        *(one(gap_type == k) for k in GAP_TYPES), weight, F.coalesce(confidence.cast("double"), F.lit(0.5)), part(F.size(F.array_distinct(entities)), 10.0),
        part(F.size(F.array_distinct(papers)) * 1.0, F.greatest(n_candidates, F.lit(1))), F.coalesce(redundancy, F.lit(0.0)), one(validated), one(~F.coalesce(needs_review, F.lit(False))),
        one(addressed == "not_addressed"), part(n_papers, 20.0), part(n_contradictions, 10.0), part(n_critiques, 10.0), one(used), diversity.cast("double"), gain.cast("double"), F.lit(1.0),
    )


def judged_weakness(kind: Column, description: Column, evidence: Column, truth: dict[str, Column], n_datasets: Column, paper_text: Column, confidence: Column) -> dict[str, Column]:
    """Whether a weakness that a model names can stand against what the paper is known to have.

    reason: null if it stands, else CONTRADICTION (it says that something is absent that is there, or that there is one dataset where
    there are two) or HEURISTIC_AUTHORITY. Evidence of more than three long words of which fewer than two occur in the paper
    needs a review and has confidence 0.60.
    """
    said = F.lower(F.concat_ws(" ", kind, description, evidence))
    has = lambda k: F.coalesce(truth[k], F.lit(False)) if k in truth else F.lit(False)
    absent, known, single = F.lit(False), F.lit(False), F.lit(False)
    for word, fact in ABSENCE:
        absent = absent | (F.contains(said, F.lit(word)) & has(fact))
    for word, fact in AUTHORITY:
        known = known | (F.contains(said, F.lit(word)) & has(fact))
    for phrase in ONE_DATASET:
        single = single | F.contains(said, F.lit(phrase))
    long_words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 4))
    grounds = long_words(F.coalesce(evidence, F.lit("")))
    loose = (F.size(grounds) > 3) & (F.size(F.array_intersect(grounds, long_words(F.coalesce(paper_text, F.lit(""))))) < 2)
    reason = F.when(absent | (single & (n_datasets >= 2)), "CONTRADICTION").when(known, "HEURISTIC_AUTHORITY")
    return {"reason": reason, "confidence": F.when(loose, F.lit(0.60)).otherwise(confidence), "needs_review": loose}


#: What each kind of step adds to a session's context, and what their order and breadth add.
STEP_WEIGHTS = {"run_comparator": 0.35, "run_critic": 0.30, "run_gap_detector": 0.25}
IN_ORDER, WITH_GAPS = 0.05, 0.05


def context_score(ran: Column) -> Column:
    """How much of a session's context its steps (an array, in order) have built, at most 1: weights of those that ran, more where
    papers were compared before they were criticised, and where gaps were looked for beside either."""
    at = {k: F.array_position(ran, k) for k in STEP_WEIGHTS}
    score = F.lit(0.0)
    for k, w in STEP_WEIGHTS.items():
        score = score + F.when(at[k] > 0, w).otherwise(0.0)
    compared, criticised, gaps = at.values()
    score = score + F.when((compared > 0) & (compared < criticised), IN_ORDER).otherwise(0.0)
    return F.least(score + F.when(((compared > 0) | (criticised > 0)) & (gaps > 0), WITH_GAPS).otherwise(0.0), F.lit(1.0))


#: Fixed value: characters of an abstract that a record shows.
ABSTRACT = 1000


def paper_records(papers: DataFrame) -> DataFrame:
    """One flat record a paper: title (else its id, else unknown), authors as JSON, year (0: null), venue, the beginning of the
    abstract, and how many claims, entities and limitations it has. ``papers`` as read by the catalog; absent lists count as empty."""
    meta = F.col("metadata")
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    many = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long").alias(f"n_{c}")
    return papers.select(
        "paper_id",
        F.coalesce(filled(meta["title"]), filled(F.col("paper_id")), F.lit("unknown")).alias("title"),
        F.to_json(F.coalesce(meta["authors"], F.array().cast("array<string>"))).alias("authors"),
        F.nullif(meta["year"], F.lit(0)).alias("year"),
        F.coalesce(meta["venue"], F.lit("")).alias("venue"),
        F.substring(F.coalesce(meta["abstract"], F.lit("")), 1, ABSTRACT).alias("abstract"),
        *(many(c) for c in ("claims", "entities", "limitations")),
    )


def merged_formulas(rows: DataFrame, group: str, order: list[str], label: str = "label", text: str = "content", tiny: int = 6) -> DataFrame:
    """Formulas that were split come together: without a label, a tiny fragment joins what stands before it, any fragment joins an
    unlabelled one before it, and what is left unlabelled joins the next labelled formula. Empty ones are dropped.

    Between two labels a fragment that isn't tiny opens the next formula's preamble, so running counts say what belongs
    together: two windows and one aggregation, no loop.
    """
    w = Window.partitionBy(group).orderBy(*order)
    labelled = F.coalesce(F.col(label), F.lit("")) != ""
    part = rows.where(F.coalesce(F.col(text), F.lit("")) != "").withColumn("__seg", F.sum(labelled.cast("int")).over(w)).withColumn("__at", F.row_number().over(w))
    inner = Window.partitionBy(group, "__seg").orderBy("__at")
    late = F.max((~labelled & (F.length(text) > tiny)).cast("int")).over(inner)
    part = part.withColumn("__late", F.when(F.col("__seg") == 0, F.lit(1)).otherwise(late)).withColumn("__last", F.max("__seg").over(Window.partitionBy(group)))
    forward = (F.col("__late") == 1) & (F.col("__seg") < F.col("__last"))
    keyed = part.withColumn("__to", F.when(forward, F.col("__seg") + 1).otherwise(F.col("__seg"))).withColumn("__alone", (F.col("__late") == 1) & ~forward)
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("__at", F.col(text).alias("t")))), lambda p: p["t"])
    merged = keyed.groupBy(group, "__to", "__alone").agg(F.min("__at").alias("__first"), F.coalesce(F.max(F.when(labelled, F.col(label))), F.lit("")).alias(label), F.trim(F.array_join(pieces, " ")).alias(text))
    return merged.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy("__first")).cast("long")).select(group, "pos", label, text)


def absorbed_sections(sections: DataFrame, group: str, order: list[str], heading: str = "heading", text: str = "text") -> DataFrame:
    """Sections whose heading is none join the text of the section before them; those before the first section are dropped."""
    w = Window.partitionBy(group).orderBy(*order)
    numbered = sections.withColumn("__own", ~garbage_heading(F.col(heading))).withColumn("__at", F.row_number().over(w)).withColumn("pos", F.sum(F.col("__own").cast("int")).over(w))
    pieces = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda p: p["t"]), lambda t: t != "")
    return numbered.where("pos > 0").groupBy(group, "pos").agg(F.max(F.when(F.col("__own"), F.col(heading))).alias(heading), F.trim(F.array_join(pieces, " ")).alias(text))


def setup_sections(sections: DataFrame, paper: str = "paper_id", heading: str = "heading", kind: str = "section_type") -> DataFrame:
    """The sections of each paper that describe its setup; all of its sections where none does."""
    mine = F.coalesce(is_setup_section(F.col(heading), F.col(kind)), F.lit(False))
    rows = sections.withColumn("__mine", mine)
    some = rows.where("__mine").select(paper).distinct().withColumn("__some", F.lit(True))
    return rows.join(some, paper, "left").where(F.col("__mine") | F.col("__some").isNull()).drop("__mine", "__some")
