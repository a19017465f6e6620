"""Pages of markup read into parts with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_text(html: Column) -> Column:
    """The text of a page without scripts, styles, navigation, footers, comments and tags."""
    bare = F.regexp_replace(html, r"(?s)<(script|style|nav|footer)[^>]*>.*?</(script|style|nav|footer)>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with title, heading, paragraphs (raw inner markup) and body text."""
    h = F.col(html)
    return pages.select(
        *[c for c in pages.columns if c != html],
        F.regexp_extract(h, r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(h, r"(?s)<h1>(.*?)</h1>", 1).alias("heading"),
        F.slice(F.split(h, "<p>"), 2, F.greatest(F.size(F.split(h, "<p>")) - 1, F.lit(0))).alias("paragraphs"),
        plain_text(h).alias("body"),
    )
