"""Rules for parsed papers as columns: titles, captions, section numbers, formula labels, ids, years, names and their clean forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import dataset_name, holds_any, metric_name, squeeze

#: Headings that are no headings, texts that are no captions or formulas, and the words of running text.
GARBAGE_HEADING = r"(?i)^(input[-\s]input|figure\s+\d|table\s+\d|attention\s+visualization|layer\d|encoder[-\s]decoder)"
GARBLED_CAPTION = r"(?i)^(Full-Connected|We execute|locate the best|data points|in the next|Evaluation Metric|[\d\.]+/[\d\.]+)|^\."
FIGURE_FORMULA = r"(?i)(ST-Conv|Conv\s+Block|Output\s+Layer|Gated.Conv|Graph.Conv|GLU|vt-M\+|Temporal\s+Gated|Spatial\s+Graph)"
PROSE = r"(?i)\b(we|the|to|in|and|of|a)\b"
#: Words of affiliations.
AFFILIATION = (
    r"(?i)\b(university|institute|laboratory|lab|department|dept|brain|research|google|facebook|meta|microsoft|amazon|apple|deepmind|openai|nvidia|intel|ibm|mit|stanford|cmu|oxford|"
    r"college|school|center|centre)\b"
)
#: Phrases of conversation that say nothing about the topic searched for.
FILLER = r"(?i)\b(i want|i need|find me|show me|give me|research papers? on|papers? about|articles? on|papers? related to|look for|search for)\b"
#: Entity types of sequence labels.
LABELS = {"Task": "task", "Method": "method", "Metric": "metric", "Material": "dataset"}
#: Sections that entities are looked for in, and parts of headings and types of sections that describe a setup.
PRIORITY_SECTIONS = ("Methods", "Experiments", "Results", "Evaluation", "Abstract", "Introduction", "Discussion", "Conclusion", "Related Work", "Limitations", "Future Work", "Table", "Figure")
SETUP_SECTIONS = (
    "experiments", "experimental", "experimental setup", "implementation", "implementation details", "training details", "training setup", "setup", "methodology", "methods", "training",
    "training procedure", "hyperparameters",
)
#: Names that are metrics, and beginnings of names that are datasets.
KNOWN_METRIC = (
    r"(?i)^(bleu|rouge[\-\d]*|f[\-\s]?1|f\d|accuracy|perplexity|ppl|recall|precision|auc|map|mrr|ndcg|wer|cer|ter|meteor|sacrebleu|cider|bits per char|bpc|top[\-\s]?\d|"
    r"training loss|test loss|val loss|cross.entropy|bleu score|edit distance|exact match)$"
)
KNOWN_DATASET = (
    r"(?i)^(wmt|newstest|squad|glue|superglue|conll|penn treebank|wsj|ptb|imdb|sst|mnli|snli|qnli|qqp|cola|sts|mrpc|rte|wnli|iwslt|europarl|ntst)"
)


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """Compatibility composition (NFKC) with white space collapsed; no built-in function composes."""
    return text.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()), na_action="ignore")


def words(text: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _upper(word: Column) -> Column:
    """Whether a word has letters with case, and all of them are capital."""
    return (F.upper(word) == word) & (F.lower(word) != word)


def clean_title(title: Column) -> Column:
    """The last sentence of a title if it has three words; else from its first capital word of five letters on, if words in
    another case stand before it; else the whole."""
    whole = squeeze(title)
    sentences = F.split(whole, r"\.\s+")
    last = F.trim(F.element_at(sentences, -1))
    parts = F.split(whole, r"\s+")
    at = F.array_position(F.transform(parts, lambda w: _upper(F.regexp_replace(w, "^-+", "")) & (F.length(F.regexp_replace(w, "^-+", "")) >= 5)), True)
    before = F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
    mixed = F.exists(before, lambda w: ~_upper(F.regexp_replace(w, "^-+", "")))
    rest = F.array_join(F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.size(parts)), " ")
    return F.when((F.size(sentences) > 1) & (F.size(words(last)) >= 3), last).when((at > 1) & mixed, rest).otherwise(whole)


def rescued_caption(text: Column) -> Column:
    """The last sentence of a garbled caption with five words that begins with a capital, with a full stop; else empty."""
    fit = F.filter(F.transform(F.split(text, r"\.\s+"), lambda s: F.trim(s)), lambda s: (F.size(words(s)) >= 5) & s.rlike(r"^\p{Lu}"))
    found = F.try_element_at(fit, F.lit(-1))
    return F.coalesce(F.when(found.endswith("."), found).otherwise(F.concat(found, F.lit("."))), F.lit(""))


def garbled_caption(text: Column) -> Column:
    """Whether a caption is missing, running text or numbers."""
    return (F.coalesce(text, F.lit("")) == "") | text.rlike(GARBLED_CAPTION)


def garbled_table(rows: Column) -> Column:
    """Whether a table (array of arrays) is empty, or four fifths of its rows have one cell and three fifths of those are prose."""
    single = F.filter(rows, lambda r: F.size(r) == 1)
    prose = F.filter(single, lambda r: (F.size(words(r[0])) > 5) & r[0].rlike(PROSE))
    return F.coalesce(F.size(rows), F.lit(0)).isin(0, -1) | ((F.size(single) >= F.size(rows) * 0.8) & (F.size(prose) >= F.size(single) * 0.6))


def garbage_heading(heading: Column) -> Column:
    return F.coalesce(heading.rlike(GARBAGE_HEADING), F.lit(False))


def top_level(number: Column) -> Column:
    """The number of the section that a numbered subsection belongs to; empty if there is none."""
    return F.coalesce(F.split_part(F.trim(number), F.lit("."), F.lit(1)), F.lit(""))


def section_level(number: Column) -> Column:
    """unnumbered, subsection or section."""
    n = F.coalesce(F.trim(number), F.lit(""))
    return F.when(n == "", "unnumbered").when(F.contains(n, F.lit(".")), "subsection").otherwise("section")


def formula_label(label: Column) -> Column:
    """Bare numbers come into brackets; a missing label is empty."""
    bare = F.trim(F.coalesce(label, F.lit("")))
    return F.when(bare.rlike(r"^\d+$"), F.concat(F.lit("("), bare, F.lit(")"))).otherwise(bare)


def formula_content(content: Column, label: Column) -> Column:
    """A formula without its label, in brackets or not, at either end."""
    out = content
    for form in (label, F.btrim(label, F.lit("()"))):
        quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(form, r"\\E", ""), F.lit(r"\E"))
        out = F.trim(F.regexp_replace(out, F.concat(F.lit(r"\s*"), quoted, F.lit(r"\s*$")), F.lit("")))
        out = F.trim(F.regexp_replace(out, F.concat(F.lit(r"^\s*"), quoted, F.lit(r"\s*")), F.lit("")))
    return F.when(label == "", content).otherwise(out)


def is_author(name: Column) -> Column:
    """Names of two words or more without a word of an affiliation."""
    return (F.size(words(name)) >= 2) & ~name.rlike(AFFILIATION)


def paper_id(doi: Column, title: Column, year: Column) -> Column:
    """``doi:`` and the DOI, slashes to underscores; without one, the first five words of the title and the year."""
    head = F.array_join(F.slice(words(F.lower(F.coalesce(title, F.lit("unknown")))), 1, 5), "_")
    made = F.concat_ws("_", F.regexp_replace(head, r"[^\p{L}\p{N}_]", ""), F.coalesce(year.cast("string"), F.lit("0000")))
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), F.translate(doi, "/", "_"))).otherwise(made)


def year_of(year: Column, *names: Column) -> Column:
    """A year in 1900 to 2025, else the century of the first four digits in a row of the names (a number like 1706.03762 first)."""
    found = F.when(year.between(1900, 2025), year.cast("int"))
    for name in names:
        digits = F.coalesce(F.nullif(F.regexp_extract(name, r"(\d{2})\d{2}\.\d+", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"(\d{2})\d{2}", 1), F.lit("")))
        short = digits.cast("int")
        found = F.coalesce(found, F.when(short >= 90, 1900 + short).otherwise(2000 + short))
    return found


def without_filler(question: Column) -> Column:
    """A question without phrases of conversation; the question itself if nothing stays."""
    bare = F.trim(F.regexp_replace(question, FILLER, ""))
    return F.when(bare != "", bare).otherwise(question)


def entity_type_of(tag: Column) -> Column:
    """The entity type of a sequence label with or without B- or I-; null for others."""
    kind = F.regexp_replace(tag, "^[BI]-", "")
    return F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))[kind]


def is_setup_section(heading: Column, kind: Column) -> Column:
    place = F.concat_ws("\n", F.lower(heading), F.lower(kind))
    return holds_any(place, SETUP_SECTIONS)


def is_priority_section(kind: Column) -> Column:
    """Whether entities are looked for in a section of this type."""
    return kind.isin(*PRIORITY_SECTIONS)


def normalised(text: Column, kind: Column, answer: Column | None = None) -> Column:
    """The name of a metric or dataset by the rules; where they leave it as it is, the kept answer for it, else lower case.

    Other kinds only lose case and outer spaces. Blank names stay as they are.
    """
    plain = F.trim(F.lower(text))
    ruled = F.when(kind == "metric", metric_name(text)).when(kind == "dataset", dataset_name(text))
    told = F.when(kind.isin("metric", "dataset"), answer) if answer is not None else F.lit(None).cast("string")
    return F.when(F.trim(text) == "", text).otherwise(F.coalesce(F.when(ruled != plain, ruled), F.when(told != "", told), plain))


def setup_lines(setup: dict[str, Column]) -> Column:
    """What is known of an experimental setup, a line each; a note if there is nothing."""
    shown = [F.concat(F.lit(f"{name}: "), c.cast("string")) for name, c in setup.items()]
    text = F.array_join(F.array(*shown), "\n")
    return F.when(text != "", text).otherwise(F.lit("(no experimental setup data found)"))
