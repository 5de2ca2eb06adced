"""JSON found in the answers of language models, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.text import _c

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def _json(text: Column) -> Column:
    """``text`` if it is JSON, trimmed; else null."""
    t = F.btrim(text, F.lit(" \t\n\r"))
    return F.when((t != "") & F.try_parse_json(t).isNotNull(), t)


def _span(text: Column, opener: str, closer: str) -> Column:
    i = F.instr(text, opener)
    j = F.length(text) - F.instr(F.reverse(text), closer) + 1
    return F.when((i > 0) & (F.instr(text, closer) > 0) & (j > i), F.substring(text, i, j - i + 1))


def extract_json(text: Column | str) -> Column:
    """The first JSON value in ``text``, as a string: the whole, each fenced block, the outermost braces, the outermost brackets; null if none parses."""
    text = _c(text)
    fenced = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), _json)
    first = F.get(F.filter(fenced, lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(_json(text), first, _json(_span(text, "{", "}")), _json(_span(text, "[", "]")))


def event_stream_text(lines: Column | str) -> Column:
    """The text of a chat answer streamed as server-sent events, one line a line: all ``content`` joined, else all ``reasoning_content``; lines that aren't data or JSON are passed over."""
    data = F.filter(F.transform(F.filter(F.split(_c(lines), r"\R"), lambda x: x.startswith("data:")), lambda x: F.btrim(F.substr(x, F.lit(6)), F.lit(" \t\r"))), lambda x: (x != "") & (x != "[DONE]"))
    shape = "struct<choices: array<struct<delta: struct<content: string, reasoning_content: string>>>>"
    deltas = F.flatten(F.transform(data, lambda x: F.coalesce(F.from_json(x, shape)["choices"], F.array().cast("array<struct<delta: struct<content: string, reasoning_content: string>>>"))))
    content = F.array_join(F.transform(deltas, lambda x: x["delta"]["content"]), "")
    reasoning = F.array_join(F.transform(deltas, lambda x: x["delta"]["reasoning_content"]), "")
    return F.btrim(F.coalesce(F.nullif(content, F.lit("")), reasoning), F.lit(" \t\n\r"))
