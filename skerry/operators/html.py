"""HTML documents to blocks of text and tables in document order."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import _c, clean_text

#: Elements whose whole content is dropped (fixed values).
DROPPED = frozenset(("script", "style", "ix:header", "title"))
BLOCKS = "array<struct<kind: string, content: string>>"


class _Blocks(HTMLParser):
    """Collects text between tables, and each outermost table's rows of cells.

    A nested table's rows follow the row they stand in; text belongs to the innermost cell around
    it. Text of a table outside any cell is dropped. An unclosed row or cell ends where the next begins.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.dropped: list[str] = []
        self.depth = 0
        self.body = False
        self.rows: list[list[list[str]]] = []
        self.cells: list[list[str]] = []

    def flush(self) -> None:
        if any(t.strip() for t in self.text):
            self.out.append({"kind": "text", "content": "\n".join(self.text)})
        self.text = []

    def close_table(self) -> None:
        self.out.append({"kind": "table", "content": table_text([["".join(c) for c in r] for r in self.rows])})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.dropped:
            if tag == self.dropped[0]:
                self.dropped.append(tag)
        elif tag in DROPPED:
            self.dropped.append(tag)
        elif tag == "body" and not self.body:
            self.body = True
            self.text, self.out = [], []  # what stands before the body isn't part of it
        elif tag == "table":
            if not self.depth:
                self.flush()
                self.rows, self.cells = [], []
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
            self.cells = self.cells[: self.depth - 1]
        elif self.depth and tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            cell: list[str] = []
            self.rows[-1].append(cell)
            self.cells = [*self.cells[: self.depth - 1], cell]

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
        elif tag == "table" and self.depth:
            self.depth -= 1
            self.cells = self.cells[: self.depth]
            if not self.depth:
                self.close_table()
        elif tag in ("td", "th", "tr"):
            self.cells = self.cells[: max(0, self.depth - 1)]

    def handle_data(self, data: str) -> None:
        if self.dropped:
            return
        if not self.depth:
            self.text.append(data)
        elif self.cells:
            self.cells[-1].append(data)


def table_text(rows: list[list[str]]) -> str:
    """Rows of cells as lines: white space collapsed, empty rows and columns dropped, short rows filled up, cells joined by `` | ``."""
    clean = [[" ".join(c.split()) for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    keep = sorted({i for r in clean for i, c in enumerate(r) if c})
    out = (" | ".join(r[i] if i < len(r) else "" for i in keep) for r in clean)
    return "\n".join(x for x in out if x.replace("|", "").strip())


def parse(html: str | None) -> list[dict]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    if p.depth:
        p.close_table()
    p.flush()
    return p.out


def parsed(html: Column | str) -> Column:
    """``parse`` over Arrow batches."""
    return F.pandas_udf(lambda batch: pd.Series([parse(h) for h in batch], dtype=object), BLOCKS)(_c(html))


def blocks(docs: DataFrame, html: str = "html") -> DataFrame:
    """The other columns of ``docs`` and one row a block: ``pos`` from 0, ``kind`` (text or table), ``content`` cleaned; empty blocks are left out.

    Parsing and table layout are the one step in Python, by Arrow batches; cleaning is columns.
    """
    rest = [c for c in docs.columns if c != html]
    rows = docs.withColumn("_b", parsed(F.coalesce(html, F.lit("")))).select(*rest, F.posexplode("_b").alias("pos", "b"))
    content = F.when(F.col("b.kind") == "table", F.col("b.content")).otherwise(clean_text("b.content"))
    return rows.select(*rest, "pos", F.col("b.kind").alias("kind"), content.alias("content")).filter("trim(content) <> ''")
