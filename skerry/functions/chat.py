"""Prompts and message lists as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.text import _c

#: Patterns in a model's name and the directive that keeps it from reasoning aloud, first match (fixed values).
DIRECTIVES = (("nemotron", "detailed thinking off"), (r"qwen3(\.\d)?", "/no_think"))
MESSAGES = "array<struct<role: string, content: string>>"


def directive(model: Column | str) -> Column:
    """The directive for a model's name; null if it needs none."""
    out = F.lit(None).cast("string")
    for pattern, text in reversed(DIRECTIVES):
        out = F.when(F.lower(_c(model)).rlike(pattern), F.lit(text)).otherwise(out)
    return out


def with_directive(model: Column | str, messages: Column | str) -> Column:
    """``messages`` with the model's directive before the system message's text, or as a system message put first."""
    m, p = _c(messages), directive(model)
    first = F.get(m, F.lit(0))
    role, content = F.lit("role"), F.lit("content")
    headed = F.transform(m, lambda x, i: F.when(i == 0, F.struct(x["role"].alias("role"), F.concat(p, F.lit("\n"), x["content"]).alias("content"))).otherwise(x))
    put = F.concat(F.array(F.struct(F.lit("system").alias("role"), p.alias("content"))), m)
    return F.when(p.isNull(), m).when(first["role"] == "system", headed).otherwise(put)


def template(text: str, **columns: Column | str) -> Column:
    """``text`` with each ``{name}`` replaced by that column, nulls by nothing; doubled braces are single ones."""
    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", text):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            parts.append(F.coalesce(_c(columns[piece[1:-1]]).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
