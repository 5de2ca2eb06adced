"""Fiscal years, annual periods and the ways a value is written, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.text import _c


def fiscal_year(end: Column | str) -> Column:
    """The year a period ends in, from its first four characters; null if missing, shorter or no number."""
    end = _c(end)
    year = F.left(end, F.lit(4))
    return F.when((F.length(end) >= 4) & year.rlike(r"^\d{4}$"), year.try_cast("int"))


def position_date(d: Column | str) -> Column:
    """A date read by position from ``yyyy?mm?dd``, whatever separates the parts; null if that is no date."""
    d = _c(d)
    parts = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 6, 2), F.substring(d, 9, 2))
    return F.when(parts.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(parts, "yyyy-MM-dd"))


def is_annual(start: Column | str, end: Column | str, days: int = 300) -> Column:
    """Whether a period is a year: true without a start, else if it lasts ``days`` or more; false, never null, if malformed."""
    start, end = _c(start), _c(end)
    long = F.datediff(position_date(end), position_date(start)) >= days
    return F.when(F.coalesce(start, F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(long, F.lit(False)))


def value_formats(value: Column | str) -> Column:
    """The distinct ways ``value`` may stand in a text, in thousands and millions too, of three characters or more without commas.

    Whole numbers of at least 1 at a scale with and (from 1,000) without separators; below 1,000
    also with two decimals, ties to even. Null for null.
    """
    value = _c(value).cast("double")
    out = []
    for scale in (1.0, 1e3, 1e6):
        v = value / F.lit(scale)
        n = F.rint(v)
        whole = (F.abs(v) >= 1) & (F.abs(v - n) < 1e-9) & (F.abs(v) < 9e21)
        # From 2**63 up a double is a multiple of 2**11, so neither way loses a digit.
        n = F.when(F.abs(n) < 9e18, n.cast("bigint").cast("decimal(38,0)")).otherwise((n / 2048.0).try_cast("bigint").cast("decimal(20,0)") * F.lit(2048).cast("decimal(4,0)")).cast("decimal(38,0)")
        out.append(F.when(whole, F.format_number(n, 0)))
        out.append(F.when(whole & (F.abs(n) >= 1000), n.cast("string")))
    out.append(F.when(F.abs(value) < 1000, F.format_number(F.bround(value.cast("decimal(38,17)"), 2), 2)))
    kept = F.filter(F.array_distinct(F.array(*out)), lambda s: s.isNotNull() & (F.length(F.replace(s, F.lit(","), F.lit(""))) >= 3))
    return F.when(value.isNotNull(), kept)


def in_window(report_date: Column | str, year: Column | str, years: int = 2) -> Column:
    """Whether a report dated ``report_date`` shows ``year``: its own or one of the ``years`` before."""
    return (F.left(_c(report_date), F.lit(4)).try_cast("int") - _c(year)).between(0, years)
