"""Tokenisers, overlap statistics and line cleaning as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without retrieval signal, left out before overlap is measured (fixed values).
STOP_WORDS = """
a an the and or but if then than that this these those of in on at to for from by with
without within into over under about across after before during between is are was were
be been being do does did doing have has had having will would can could may might must
shall should its it their his her our your they we you i he she as not no nor so such
what which who whom whose when where why how any all each both few more most other some
company companys business results operations financial condition
""".split()
#: English words a sparse index leaves out by default (fixed values).
INDEX_STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

WORD = "[a-z0-9']+"
INDEX_WORD = r"[\p{L}\p{N}_]{2,}"
#: Characters that break lines, as a class (fixed values).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Lines that carry nothing (fixed values).
NOISE_LINE = r"(?i)^(table of contents|index|page\s+\d+|\d+|see accompanying notes.*|the accompanying notes.*)$"
#: A heading of a numbered item (fixed values).
ITEM_HEADING = r"(?i)^item\s+(\d{1,2}[A-C]?)\s*[.:\-–—]?\s*(.{0,120})$"

#: What an error message says of something that may pass (fixed values).
TRANSIENT_MESSAGE = r"(?i)\b(408|429|50\d|52\d)\b|timeout|timed out|connection|terminated|temporarily|overload|unavailable"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), F.lit(0))


def tokens(text: Column | str) -> Column:
    """Content words in order: ``[a-z0-9']+`` of the lower-cased text, longer than two characters, without stop words. Null for null."""
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def overlap_tokens(text: Column | str) -> Column:
    """Distinct words longer than three characters; no stop words."""
    return F.array_distinct(F.filter(words(text), lambda w: F.length(w) > 3))


def index_tokens(text: Column | str) -> Column:
    """What a sparse index sees: runs of two or more letters, digits and underscores of the lower-cased text, without its stop words."""
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(INDEX_WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*INDEX_STOP_WORDS))


def ngrams(seq: Column | str, n: int) -> Column:
    """Distinct runs of ``n`` elements of an array of strings, joined by a space; none of a shorter array."""
    seq = _c(seq)
    at = F.sequence(F.lit(1), F.size(seq) - (n - 1))
    return F.when(F.size(seq) >= n, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(seq, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def share_of(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where ``whole`` isn't positive or missing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(_c(a), _c(b)))
    return share_of(both.cast("double"), F.size(_c(a)) + F.size(_c(b)) - both)


def lines(text: Column | str) -> Column:
    """The lines of a text, whatever breaks them; no line after a final break, none of an empty text."""
    found = F.split(_c(text), LINE_BREAK)
    return F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)


def collapse(text: Column | str) -> Column:
    """Runs of white space, Unicode's too, as one space, trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"(?U)\s+", " "))


def clean_lines(text: Column | str) -> Column:
    """Lines with white space collapsed, without empty lines and lines that carry nothing."""
    return F.filter(F.transform(lines(text), collapse), lambda x: (x != "") & ~x.rlike(NOISE_LINE))


def clean_text(text: Column | str) -> Column:
    return F.array_join(clean_lines(text), "\n")


def heading_item(line: Column | str) -> Column:
    """The item number of a heading line, in upper case; null for any other line or one of 140 characters or more."""
    line = _c(line)
    return F.when((F.length(line) < 140) & line.rlike(ITEM_HEADING), F.upper(F.regexp_extract(line, ITEM_HEADING, 1)))


def heading_title(line: Column | str) -> Column:
    """The title of a heading line without the punctuation around it; null if there is none."""
    line = _c(line)
    title = F.btrim(F.regexp_extract(line, ITEM_HEADING, 2), F.lit(" .:-–—"))
    return F.when(heading_item(line).isNotNull(), F.nullif(title, F.lit("")))


def tail(text: Column | str, n: int) -> Column:
    return F.right(_c(text), F.lit(n))


def breadcrumb(ticker: Column | str, form: Column | str, report_date: Column | str, item: Column | str, title: Column | str, kind: Column | str) -> Column:
    """``ticker form year > Item n. title > [financial table]``, with the parts there are."""
    head = F.concat_ws(" ", _c(ticker), _c(form), F.left(_c(report_date), F.lit(4)))
    section = F.when(_c(item).isNotNull(), F.concat(F.lit("Item "), _c(item), F.when(_c(title).isNotNull(), F.concat(F.lit(". "), _c(title))).otherwise("")))
    return F.concat_ws(" > ", head, section, F.when(_c(kind) == "table", F.lit("[financial table]")))


def chunk_id(doc_id: Column | str, number: Column | str) -> Column:
    return F.format_string("%s#%04d", _c(doc_id), _c(number))


def embed_text(crumb: Column | str, text: Column | str) -> Column:
    """What is embedded and indexed: the breadcrumb, an empty line, the text."""
    return F.concat(_c(crumb), F.lit("\n\n"), _c(text))


def rerank_text(crumb: Column | str, text: Column | str) -> Column:
    """What a reranker reads: breadcrumb and text on successive lines."""
    return F.concat(_c(crumb), F.lit("\n"), _c(text))


def citation(ticker: Column | str, form: Column | str, report_date: Column | str, item: Column | str) -> Column:
    """``ticker form year``, then ``, Item n`` if there is an item."""
    return F.concat(F.concat_ws(" ", _c(ticker), _c(form), F.left(_c(report_date), F.lit(4))), F.when(_c(item).isNotNull(), F.concat(F.lit(", Item "), _c(item))).otherwise(""))


def slug(ticker: Column | str, form: Column | str, report_date: Column | str) -> Column:
    return F.concat(_c(ticker), F.lit("_"), F.replace(_c(form), F.lit("-"), F.lit("")), F.lit("_"), _c(report_date))


def filing_url(base: str, cik: Column | str, accession: Column | str, document: Column | str) -> Column:
    """``base/cik/accession/document``, the number without leading zeros and the accession without dashes."""
    return F.concat_ws("/", F.lit(base), F.regexp_replace(_c(cik), r"^0+(?=\d)", ""), F.replace(_c(accession), F.lit("-"), F.lit("")), _c(document))


def transient_error(message: Column | str) -> Column:
    """Whether an error message speaks of something that may pass."""
    return F.coalesce(_c(message).rlike(TRANSIENT_MESSAGE), F.lit(False))
