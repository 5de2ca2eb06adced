"""Nested JSON of filings and facts to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.facts import fiscal_year, is_annual
from skerry.functions.text import filing_url, slug

ENTRY = "struct<val: double, fy: int, fp: string, start: string, end: string, form: string, accn: string, filed: string>"
FACTS = f"struct<facts: map<string, map<string, struct<label: string, units: map<string, array<{ENTRY}>>>>>>"
TICKERS = "map<string, struct<ticker: string, cik_str: bigint, title: string>>"
RECENT = "struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>"
SUBMISSIONS = f"struct<filings: struct<recent: {RECENT}>>"
FORMS = ("10-K", "10-Q")


def flatten_facts(docs: DataFrame, json: str = "json", taxonomy: str = "us-gaap", forms: tuple[str, ...] | None = FORMS) -> DataFrame:
    """The other columns of ``docs`` and one row an entry: ``concept, label, unit, pos, value, fy, fiscal_year, annual, fp, start, end, form, accession, filed``.

    A missing or empty label is the concept; dashes leave the accession; ``forms`` are exact, so
    amendments stay out; ``pos`` is the entry's place in its unit's list. Text that isn't such JSON
    gives no rows.
    """
    rest = [c for c in docs.columns if c != json]
    d = docs.select(*rest, F.from_json(json, FACTS)["facts"].alias("f")).select(*rest, F.explode(F.try_element_at("f", F.lit(taxonomy))).alias("concept", "c"))
    d = d.select(*rest, "concept", F.coalesce(F.nullif("c.label", F.lit("")), "concept").alias("label"), F.explode("c.units").alias("unit", "entries"))
    d = d.select(*rest, "concept", "label", "unit", F.posexplode("entries").alias("pos", "e"))
    if forms is not None:
        d = d.filter(F.col("e.form").isin(*forms))
    year, annual = fiscal_year("e.end"), is_annual("e.start", "e.end")
    return d.select(
        *rest, "concept", "label", "unit", "pos", F.col("e.val").alias("value"), "e.fy", year.alias("fiscal_year"), annual.alias("annual"), "e.fp", "e.start", "e.end", "e.form",
        F.replace(F.coalesce("e.accn", F.lit("")), F.lit("-"), F.lit("")).alias("accession"), "e.filed",
    )


def ticker_map(docs: DataFrame, json: str = "json") -> DataFrame:
    """``(ticker, cik, company)`` of a ticker file's text: upper-case ticker, number padded to ten digits."""
    rows = docs.select(F.explode(F.map_values(F.from_json(json, TICKERS))).alias("x"))
    return rows.select(F.upper("x.ticker").alias("ticker"), F.lpad(F.col("x.cik_str").cast("string"), 10, "0").alias("cik"), F.col("x.title").alias("company"))


def resolve(wanted: DataFrame, tickers: DataFrame, strict: bool = True) -> DataFrame:
    """``wanted(ticker, ...)`` with ``cik`` and ``company``, whatever the ticker's case; an unknown one raises if ``strict``, else is dropped."""
    w = wanted.withColumn("ticker", F.upper("ticker"))
    if not strict:
        return w.join(tickers, "ticker")
    out = w.join(tickers, "ticker", "left")
    return out.withColumn("cik", F.when(F.col("cik").isNull(), F.raise_error(F.concat(F.lit("no such ticker: "), F.coalesce("ticker", F.lit("null"))))).otherwise(F.col("cik")))


def list_filings(docs: DataFrame, json: str = "json", forms: tuple[str, ...] = FORMS, limit: int = 8) -> DataFrame:
    """``docs(ticker, cik, company, json)`` of recent submissions to filings: those of ``forms``, newest first, the first ``limit`` a ticker, numbered in ``pos``.

    The parallel arrays are in order, newest first. An empty report date is the filing date.
    """
    r = docs.select("ticker", "cik", "company", F.from_json(json, SUBMISSIONS)["filings"]["recent"].alias("r"))
    zipped = F.arrays_zip(*(F.col(f"r.{c}").alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")))
    rows = r.select("ticker", "cik", "company", F.posexplode(zipped).alias("at", "x")).filter(F.col("x.form").isin(*forms))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy("at"))).filter(F.col("pos") <= limit)
    report = F.coalesce(F.nullif("x.reportDate", F.lit("")), "x.filingDate")
    accession = F.replace("x.accessionNumber", F.lit("-"), F.lit(""))
    return rows.select("ticker", "cik", "company", "x.form", accession.alias("accession"), F.col("x.filingDate").alias("filing_date"), report.alias("report_date"), F.col("x.primaryDocument").alias("primary_doc"), "pos")


def with_names(filings: DataFrame, base: str = "https://filings.example") -> DataFrame:
    """Filings with their ``slug`` and ``url``."""
    return filings.withColumn("slug", slug("ticker", "form", "report_date")).withColumn("url", filing_url(base, "cik", "accession", "primary_doc"))
