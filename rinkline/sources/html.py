"""Rows and texts out of HTML pages, read with the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """Cell texts of every innermost table row; rows of wrapper tables (which hold tables) are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[str]]] = []
        self.open: list[dict] = []
        self.tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            if self.open:
                self.open[-1]["wraps"] = True
            self.open.append({"no": self.tables, "rows": [], "cell": None, "wraps": False})
            self.tables += 1
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            self.open[-1]["cell"] = []

    def handle_endtag(self, tag: str) -> None:
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th") and t["cell"] is not None:
            t["rows"][-1].append(" ".join("".join(t["cell"]).split()))
            t["cell"] = None
        elif tag == "table":
            self.open.pop()
            if not t["wraps"]:
                self.rows += [(t["no"], r) for r in t["rows"] if r]

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cell"] is not None:
            self.open[-1]["cell"].append(data)


class _Paragraphs(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":
            self.inside = True
            self.out.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.out[-1] += data


def table_rows(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``(page_id, table_no, row_no, cells)`` of all tables of all pages; null and broken pages give what they have."""
    kind = pages.schema[page_id].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["page_id"], pdf["html"], strict=True):
                p = _Tables()
                p.feed(text or "")
                out += [(i, t, n, cells) for n, (t, cells) in enumerate(p.rows)]
            yield pd.DataFrame(out, columns=["page_id", "table_no", "row_no", "cells"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).mapInPandas(read, f"page_id {kind}, table_no int, row_no int, cells array<string>")


def body_text(html: str | None, longest: int = 1500) -> str:
    """Paragraph texts of an article, joined and cut at a length."""
    p = _Paragraphs()
    p.feed(html or "")
    return " ".join(" ".join(" ".join(p.out).split()).split())[:longest]


def article_texts(pages: DataFrame, page_id: str, html: str, longest: int = 1500) -> DataFrame:
    """``(page_id, body)``: :func:`body_text` of each page."""
    kind = pages.schema[page_id].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "body": [body_text(t, longest) for t in pdf["html"]]})

    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).mapInPandas(read, f"page_id {kind}, body string")
