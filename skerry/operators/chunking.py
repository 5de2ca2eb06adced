"""Blocks to chunks: item carry-forward, packing of lines with overlap, numbering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import _c, breadcrumb, chunk_id, heading_item, heading_title, lines
from skerry.operators.html import blocks

MAX_CHARS, MIN_CHARS, OVERLAP = 2400, 200, 200


def windows(rows: list[str], cap: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """``rows`` packed in order into windows of lines.

    A window takes lines while its characters, with one for each line's end, stay within ``cap``; the
    first is always taken. Every window but the first starts with the last ``overlap`` characters of
    the one before as a line of its own, and always takes one line more. Blank windows are left out.
    """
    ends = np.cumsum([0, *(len(r) + 1 for r in rows)])
    out, start, carry = [], 0, ""
    while start < len(rows):
        room = cap - (len(carry) + 1 if carry else 0)
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + room, side="right")) - 1)
        window = "\n".join(([carry] if carry else []) + rows[start:stop])
        out.append(window)
        carry, start = window[-overlap:] if overlap else "", stop
    return [w for w in out if w.strip()]


def packed(rows: Column | str, cap: Column | int = MAX_CHARS) -> Column:
    """``windows`` of an array of lines, as an array."""

    @F.pandas_udf("array<string>")
    def pack(r: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([windows(list(x), int(k)) if x is not None else [] for x, k in zip(r, c)], dtype=object)

    return pack(_c(rows), F.lit(cap) if isinstance(cap, int) else cap)


def carry_forward(rows: DataFrame, doc: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` filled from the last row before, in ``order`` within ``doc``, where it is null."""
    w = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def sections(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, segment, kind, item, item_title, rows)``: runs of lines under one heading within a block, and tables, in order.

    A heading line starts a section and is itself left out; what follows, in later blocks too,
    tables included, has its item and title.
    """
    b = blocks.withColumn("row", F.when(F.col("kind") == "table", F.array("content")).otherwise(lines("content")))
    rows = b.select(doc, "pos", "kind", F.posexplode("row").alias("line_no", "line"))
    item = F.when(F.col("kind") == "text", heading_item("line"))
    rows = rows.withColumn("heading", F.when(item.isNotNull(), F.struct(item.alias("item"), heading_title("line").alias("title"))))
    w = Window.partitionBy(doc).orderBy("pos", "line_no")
    rows = rows.withColumn("is_heading", F.col("heading").isNotNull()).withColumn("segment", F.sum(F.when(F.col("is_heading") | (F.col("line_no") == 0), 1).otherwise(0)).over(w))
    rows = carry_forward(rows, [doc], ["pos", "line_no"], "heading").filter(~F.col("is_heading"))
    g = rows.groupBy(doc, "segment", "kind").agg(F.first("heading").alias("h"), F.sort_array(F.collect_list(F.struct("pos", "line_no", "line"))).alias("r"))
    return g.select(doc, "segment", "kind", F.col("h.item").alias("item"), F.col("h.title").alias("item_title"), F.col("r.line").alias("rows"))


def chunk_sections(sections: DataFrame, doc: str = "doc_id", cap: int = MAX_CHARS, least: int = MIN_CHARS) -> DataFrame:
    """``(doc, seq, kind, item, item_title, text)``: each section packed; a table over ``cap`` in windows that each repeat its first row.

    Windows of text under ``least`` characters are left out, tables are not; ``seq`` counts what is left, from 1.
    """
    table = F.col("kind") == "table"
    whole = F.element_at("rows", 1)
    split = table & (F.length(whole) > cap)
    head = F.when(split, F.element_at(lines(whole), 1))
    body = F.when(split, F.slice(lines(whole), 2, F.greatest(F.size(lines(whole)) - 1, F.lit(0)))).otherwise(F.col("rows"))
    s = sections.withColumn("head", head).withColumn("body", body).withColumn("split", split)
    packing = packed("body", F.when(F.col("split"), cap - F.length("head") - 1).otherwise(F.lit(cap)))
    s = s.withColumn("w", F.when(table & ~F.col("split"), F.col("rows")).otherwise(packing))
    s = s.select(doc, "segment", "kind", "item", "item_title", "head", F.posexplode("w").alias("at", "text"))
    s = s.withColumn("text", F.btrim(F.concat_ws("\n", "head", "text"), F.lit(" \t\n\r"))).filter(table | (F.length("text") >= least))
    seq = F.row_number().over(Window.partitionBy(doc).orderBy("segment", "at"))
    return s.withColumn("seq", seq).select(doc, "seq", "kind", "item", "item_title", "text")


def chunk_filings(pages: DataFrame) -> DataFrame:
    """Filings with ``html`` to chunks: ``pages(ticker, company, form, report_date, accession, slug, url, html)``."""
    parts = chunk_sections(sections(blocks(pages.select(F.col("slug").alias("doc_id"), "html"))))
    meta = pages.select(F.col("slug").alias("doc_id"), "ticker", "company", "form", "report_date", "accession", F.col("url").alias("source_url"))
    c = parts.join(meta, "doc_id")
    crumb = breadcrumb("ticker", "form", "report_date", "item", "item_title", "kind")
    return c.select(
        "doc_id", chunk_id("doc_id", "seq").alias("chunk_id"), "ticker", "company", "form", "report_date", "accession", "item", "item_title", "kind", "text",
        crumb.alias("breadcrumb"), "source_url", F.length("text").alias("n_chars"),
    )
