"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Everything is measured inside a row, so there is no shuffle and no user function. Arrays that a lambda reads more than once
are bound with ``let``; otherwise they would be computed again for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it was for on with as be at by this have from or an are not what you he "
    "der die und das den von zu mit des auf für ist im dem nicht ein eine als auch sich es "
    "le la les de et un une du en que qui dans est pour pas au sur plus par ce "
    "el los las y del se por con no su al lo una como más para o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= measure <= high``; a bound of None is open, and so is a null measure."""

    name: str
    measure: str  # SQL over the measures
    low: float | None = None
    high: float | None = None


#: Lengths in words, ratios over words or over lines that have a word.
RULES = (
    Rule("length", "n_words", 20, 1_000_000),
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2, 20),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.5),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", None, 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(sorted_: Column) -> Column:
        at = lambda i: F.get(sorted_, i)["h"]
        twice = F.filter(
            F.transform(sorted_, lambda x, i: F.when(F.coalesce(x["h"] == at(i - 1), F.lit(False)) | F.coalesce(x["h"] == at(i + 1), F.lit(False)), x["i"])),
            lambda p: p.isNotNull(),
        )
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(twice), start, step, lambda acc: acc["n"])

    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs(h), covered)))


def measures(text: Column, window: int = 8) -> dict[str, Column]:
    """The measures of a text, by name."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    n_windows = lambda w: F.size(w) - (window - 1)
    hashes = lambda w: F.when(n_windows(w) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n_windows(w), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, window))))
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(hashes(w), window).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.rtrim(F.lower(x), F.lit(".,;:!?")).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "counted": counted,
        "of_lines": of_lines,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean over the measures: whether every rule holds."""
    passed = F.lit(True)
    for rule in rules:
        value = F.expr(rule.measure)
        if rule.low is not None:
            passed &= F.coalesce(value >= rule.low, F.lit(True))
        if rule.high is not None:
            passed &= F.coalesce(value <= rule.high, F.lit(True))
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of ``docs``.

    Words lie between ASCII white space; a null text has none. base_failed: under 20 words, or over 30 % of the words lie in
    8-word windows found twice or more in the text. kept is false for those, else whether every rule holds; a ratio over
    nothing holds. Repeated rows and null ids are kept as rows; an empty table gives no rows; other columns are not read.
    """
    m = measures(F.col("text"))
    held = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = held.select("doc_id", *(c.alias(n) for n, c in m.items()))
    flat = found.select("doc_id", "counted.n_words", "word_chars", "n_symbols", "of_lines.n_lines", "of_lines.n_dup_lines", "counted.n_repeat_words", "counted.n_stop_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return flat.select("*", failed.alias("base_failed")).select("*", (~F.col("base_failed") & compile_rules(rules)).alias("kept"))
