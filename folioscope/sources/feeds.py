"""Search feeds: the query that asks for papers and the entries of an Atom answer. Fetching is a provider's business."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_query(words: str) -> str:
    """A quoted phrase is looked for in abstracts; one word anywhere; several words all in titles or all in abstracts."""
    words = words.strip()
    if words.startswith('"') and words.endswith('"') and len(words) > 2:
        return f"abs:{words}"
    parts = words.split()
    if len(parts) < 2:
        return f"all:{words}"
    both = lambda field: "(" + " AND ".join(f"{field}:{p}" for p in parts) + ")"
    return f"{both('ti')} OR {both('abs')}"


def parse_atom(pages: DataFrame, xml: str) -> DataFrame:
    """One row for each entry: id without its version, title, authors, abstract, published, pdf_url."""
    entries = pages.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<entry>.*?</entry>)"), 1)).alias("e"))
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    return entries.select(
        F.regexp_replace(F.regexp_extract("e", r"<id>[^<]*/([^/<]+)</id>", 1), r"v\d+$", "").alias("id"),
        one("title").alias("title"),
        F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), 1), lambda x: F.trim(x)).alias("authors"),
        one("summary").alias("abstract"),
        one("published").alias("published"),
        F.regexp_extract("e", r'title="pdf"[^>]*href="([^"]+)"', 1).alias("pdf_url"),
    )
