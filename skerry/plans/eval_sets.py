"""Sets of questions with gold labels, from facts and from passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.chat import template
from skerry.functions.facts import fiscal_year, is_annual
from skerry.functions.jsonx import extract_json
from skerry.operators import labels, sampling
from skerry.runtime import staged

QUESTION = "What was {ticker}'s {label} in fiscal {year}?"
WRITER = """Write one question that an analyst could ask about {ticker} and that the passage below answers.
It is from the {year} filing, section {section}. Use your own words, name the company, one sentence.

{passage}

Answer as JSON: {{"question": "...", "topic": "..."}}"""
GRADER = """Grade from 0 to 5 how well each passage answers the question.

Question: {question}

A: {passage_a}

B: {passage_b}

Answer as JSON: {{"score_a": 0, "score_b": 0}}"""
WRITER_CHARS, GRADER_CHARS = 3500, 1200


def eligible_facts(facts: DataFrame, concepts: DataFrame | None = None, form: str = "10-K") -> DataFrame:
    """``facts`` (flattened) that may become questions: of the ``form``, annual, with a value and a year; of ``concepts(concept, label)`` if given, with those labels."""
    f = facts.withColumn("fiscal_year", fiscal_year("period_end")).withColumn("annual", is_annual("period_start", "period_end"))
    f = f.filter((F.col("form") == form) & F.col("annual") & F.col("val").isNotNull() & ~F.isnan("val") & F.col("fiscal_year").isNotNull() & (F.col("fiscal_year") != 0))
    return f if concepts is None else f.drop("label").join(F.broadcast(concepts), "concept")  # a list of concepts is written by hand


def numeric_questions(facts: DataFrame, chunks: DataFrame, order: list[str], most: int = 8, per_ticker: int = 40, seed: int = 0) -> DataFrame:
    """One question a fact whose value stands in 1 to ``most`` chunks of its ticker and years.

    The first such fact, in ``order``, of a ticker, concept and year; a fact that fails doesn't
    block a later one. At most ``per_ticker`` a ticker, in seeded order.
    """
    f = facts.select("ticker", "concept", F.coalesce(F.nullif("label", F.lit("")), "concept").alias("label"), "unit", F.col("val").alias("value"), "fiscal_year", *(c for c in order if c not in ("ticker", "concept", "label", "unit", "val", "fiscal_year"))).distinct()
    f = f.withColumn("fact_id", F.xxhash64(*f.columns))
    gold = labels.value_matches(f, chunks, most=most).groupBy("fact_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("gold_chunk_ids"))
    rows = f.join(gold, "fact_id")
    by = ["value" if c == "val" else c for c in order]
    rows = sampling.first_wins(rows, ["ticker", "concept", "fiscal_year"], [F.col(c).asc_nulls_first() for c in by])
    qid = F.concat_ws("-", "ticker", "concept", F.col("fiscal_year").cast("string"))
    rows = rows.withColumn("qid", qid).withColumn("question", template(QUESTION, ticker="ticker", label="label", year="fiscal_year"))
    rows = sampling.quota(rows, "ticker", per_ticker, [sampling.seeded(seed, "qid"), "qid"])
    return rows.select("qid", "question", "ticker", "concept", "fiscal_year", F.col("value").alias("expected_value"), "unit", "gold_chunk_ids", F.lit("numeric").alias("split"), F.lit("facts").alias("source"))


def narrative_passages(chunks: DataFrame, items: list[str], least: int = 900) -> DataFrame:
    """Chunks of running text in ``items`` of at least ``least`` characters."""
    return chunks.filter(F.col("item").isin(*items) & (F.col("kind") == "text") & (F.length("text") >= least))


def writer_prompts(passages: DataFrame) -> DataFrame:
    """``(id, prompt)`` that asks for a question about each passage's first characters."""
    section = F.coalesce("item_title", F.concat(F.lit("Item "), "item"))
    return passages.select(F.col("chunk_id").alias("id"), template(WRITER, ticker="ticker", year=F.left("report_date", F.lit(4)), section=section, passage=F.left("text", F.lit(WRITER_CHARS))).alias("prompt"))


def grader_prompts(pairs: DataFrame) -> DataFrame:
    """``(id, prompt)`` of ``pairs(qid, question, text_a, text_b)``."""
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(GRADER_CHARS))
    return pairs.select(F.col("qid").alias("id"), template(GRADER, question="question", passage_a=cut("text_a"), passage_b=cut("text_b")).alias("prompt"))


def to_ask(passages: DataFrame, per_ticker: int = 5, oversample: int = 2, seed: int = 0) -> DataFrame:
    """The passages that a model is asked about: in seeded order, ``oversample`` times as many as a ticker's quota, so that refused ones can be made up for."""
    return sampling.quota(passages, "ticker", per_ticker * oversample, [sampling.seeded(seed, "chunk_id"), "chunk_id"]).drop("place")


def narrative_questions(passages: DataFrame, answers: DataFrame, corpus: DataFrame, links: DataFrame, members: DataFrame, per_ticker: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Accepted questions and the histogram of rejections.

    ``answers(id, answer)`` hold JSON with a ``question``; ``corpus(id, text)`` gives the idf;
    ``links`` and ``members`` are what :func:`labels.similar_sets` says of the passages: every passage
    similar to a kept one is gold too. Rejections are counted among the answers looked at before a
    ticker's quota is full, all of them if it isn't.
    """
    asked = answers.withColumn("j", F.from_json(extract_json("answer"), "question string, topic string")).filter("trim(j.question) <> ''")
    p = passages.join(asked, passages["chunk_id"] == asked["id"]).select("chunk_id", "ticker", "item", "report_date", "text", F.trim("j.question").alias("question"), "j.topic")
    verdict = labels.screened(p.select(F.col("chunk_id").alias("pid"), "question", F.col("text").alias("gold_text")), labels.idf(corpus))
    both = staged(p.join(verdict, p["chunk_id"] == verdict["pid"]).withColumn("_order", sampling.seeded(seed, "chunk_id")))
    kept = sampling.quota(both.filter("reason IS NULL"), "ticker", per_ticker, ["_order", "chunk_id"])
    last = kept.filter(F.col("place") == per_ticker).select(F.col("ticker").alias("_t"), F.struct("_order", "chunk_id").alias("_last"))
    looked = both.join(last, both["ticker"].eqNullSafe(last["_t"]), "left").filter(F.col("_last").isNull() | (F.struct("_order", "chunk_id") <= F.col("_last")))
    others = labels.near_records(kept.select(F.col("chunk_id").alias("id")), links, members).groupBy(F.col("id").alias("chunk_id")).agg(F.sort_array(F.collect_set("other")).alias("others"))
    out = kept.join(others, "chunk_id", "left")
    gold = F.concat(F.array("chunk_id"), F.coalesce("others", F.array().cast("array<string>")))
    out = out.select(F.concat("chunk_id", F.lit("-narr")).alias("qid"), "question", "topic", "ticker", "item", F.left("report_date", F.lit(4)).alias("fiscal_year"), gold.alias("gold_chunk_ids"), F.col("overlap").alias("idf_overlap"), F.lit("narrative").alias("split"), F.lit("written, screened").alias("source"))
    return out, labels.rejections(looked)
