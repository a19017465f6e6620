"""Parsed scholarly XML (TEI) read into one nested row a paper; the ordered walk over mixed content needs a parser in Python."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scholarly as rule
from ..session import ship

SPACE = "{http://www.tei-c.org/ns/1.0}"
ID = "{http://www.w3.org/XML/1998/namespace}id"
DOCUMENT = (
    "struct<title:string,authors:array<string>,year:int,venue:string,doi:string,abstract:string,sections:array<struct<heading:string,text:string>>,"
    "figures:array<struct<figure_id:string,label:string,caption:string>>,tables:array<struct<table_id:string,label:string,caption:string,rows:array<array<string>>>>>"
)
#: Papers whose parsed form is held at once; a batch has more.
AT_ONCE = 100
#: Elements whose own text is no part of the running text; what follows them is.
SKIPPED = {f"{SPACE}ref", f"{SPACE}note"}


def running_text(node: ElementTree.Element | None) -> str:
    """All text below a node in order, references and notes left out."""
    if node is None:
        return ""
    parts: list[str] = []

    def walk(x: ElementTree.Element) -> None:
        parts.append(x.text or "")
        for child in x:
            if child.tag not in SKIPPED:
                walk(child)
            parts.append(child.tail or "")

    walk(node)
    return re.sub(r"\s+", " ", " ".join(parts)).strip()


def read_document(xml: str) -> dict:
    root = ElementTree.fromstring(xml)
    abstract = root.find(f".//{SPACE}profileDesc/{SPACE}abstract")
    titles = [t for t in root.iter(f"{SPACE}title") if running_text(t)]
    main = next((t for t in titles if t.get("type") == "main"), titles[0] if titles else None)
    names = [" ".join(running_text(x) for x in p if x.tag in (f"{SPACE}forename", f"{SPACE}surname")) for p in root.iter(f"{SPACE}persName")]
    dates = " ".join((d.get("when") or "") + " " + running_text(d) for d in root.iter(f"{SPACE}date"))
    year = re.search(r"\b(19|20)\d{2}\b", dates.replace("-", " "))
    doi = next((running_text(i) for i in root.iter(f"{SPACE}idno") if i.get("type") == "DOI"), None)
    venue = next((running_text(t) for t in titles if t.get("level") in ("j", "m")), None)
    sections = []
    for div in root.iterfind(f".//{SPACE}body//{SPACE}div"):
        text = "\n".join(x for x in (running_text(p) for p in div if p.tag in (f"{SPACE}p", f"{SPACE}formula")) if x)
        if text:
            sections.append({"heading": running_text(div.find(f"{SPACE}head")), "text": text})
    figures, tables = [], []
    for fig in root.iter(f"{SPACE}figure"):
        label, caption = running_text(fig.find(f"{SPACE}label")), running_text(fig.find(f"{SPACE}figDesc"))
        if fig.get("type") == "table":
            rows = [[t for t in (running_text(c) for c in row.iter(f"{SPACE}cell")) if t] for row in fig.iter(f"{SPACE}row")]
            tables.append({"table_id": fig.get(ID) or "", "label": label, "caption": caption, "rows": [r for r in rows if r]})
        else:
            figures.append({"figure_id": fig.get(ID) or "", "label": label, "caption": caption})
    return {
        "title": running_text(main) or None, "authors": [n for n in dict.fromkeys(names) if n], "year": int(year[0]) if year else None, "venue": venue, "doi": doi,
        "abstract": running_text(abstract) or None, "sections": sections, "figures": figures, "tables": tables,
    }


def parse(papers: DataFrame, xml: str) -> DataFrame:
    """``papers`` with success, error and document in place of the XML; empty or broken XML fails its row only."""
    ship(papers.sparkSession)
    others = [f for f in papers.schema.fields if f.name != xml]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (whole.iloc[i : i + AT_ONCE] for whole in batches for i in range(0, len(whole), AT_ONCE)):
            done = []
            for x in pdf[xml]:
                try:
                    done.append((True, None, read_document(x)) if x else (False, "empty", None))
                except ElementTree.ParseError as e:
                    done.append((False, str(e), None))
            out = pdf.drop(columns=[xml])
            out["success"], out["error"], out["document"] = zip(*done)
            yield out

    parsed = papers.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "success boolean", "error string", f"document {DOCUMENT}"]))
    return repaired(parsed)


def _last_of_each(items: Column, key: str) -> Column:
    """Of items with the same id the last, where the first of them stood."""
    return F.transform(F.array_distinct(F.transform(items, lambda x: x[key])), lambda k: F.element_at(F.filter(items, lambda x: x[key] == k), -1))


def repaired(parsed: DataFrame, document: str = "document") -> DataFrame:
    """``parsed`` with what the parser got wrong put right, by the rules of ``functions.scholarly``.

    Titles lose what stands before them and names of institutions are no authors. Sections under headings that are no headings
    go. Figures without a label go if their caption is garbled or shorter than 20 letters; tables get a caption rescued from a
    garbled one and lose rows that are running text, and go if nothing is left. Of repeated ids the last counts.
    """
    d = F.col(document)
    figures = F.filter(d["figures"], lambda x: (x["label"] != "") | ~(rule.garbled_caption(x["caption"]) | (F.char_length(x["caption"]) < 20)))
    tables = F.transform(
        d["tables"],
        lambda x: F.struct(
            x["table_id"].alias("table_id"), x["label"].alias("label"), F.when(rule.garbled_caption(x["caption"]), rule.rescued_caption(x["caption"])).otherwise(x["caption"]).alias("caption"),
            F.when(rule.garbled_table(x["rows"]), F.array().cast("array<array<string>>")).otherwise(x["rows"]).alias("rows"),
        ),
    )
    tables = F.filter(tables, lambda x: (x["label"] != "") | (x["caption"] != "") | (F.size(x["rows"]) > 0))
    new = {
        "title": F.when(d["title"].isNotNull(), rule.clean_title(d["title"])),
        "authors": F.filter(d["authors"], rule.is_author),
        "sections": F.filter(d["sections"], lambda x: ~rule.garbage_heading(x["heading"])),
        "figures": _last_of_each(figures, "figure_id"),
        "tables": _last_of_each(tables, "table_id"),
    }
    fields = [new.get(n, d[n]).alias(n) for n in ("title", "authors", "year", "venue", "doi", "abstract", "sections", "figures", "tables")]
    return parsed.withColumn(document, F.when(d.isNotNull(), F.struct(*fields)))
