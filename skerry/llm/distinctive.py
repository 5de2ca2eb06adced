"""Problem 7: how distinctive a term is, by log-entropy weighting."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import small, staged

WORD = "[a-z]{4,}"


def records_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, h, text)``: the distinct texts of each key, with their hash; rows without key or text are left out.

    Repeats are combined before the shuffle, which leaves each record in one place for the counts that follow.
    """
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    return rows.groupBy("id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))


def term_counts(records: DataFrame) -> DataFrame:
    """``(id, h, term, tf)`` of :func:`records_of`, the first aggregation: how often each record has each word of four letters or more.

    Rows of a record are together already, so counting needs no shuffle.
    """
    words = records.select("id", "h", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term"))
    return words.groupBy("id", "h", "term").agg(F.count("*").cast("int").alias("tf"))


def spread_weight(n_records: int) -> Column:
    """One minus the normalised entropy of a term's spread, from ``gf`` and ``tl``.

    With ``p = tf / gf``, entropy is ``ln gf - sum(tf ln tf) / gf``. It is 1 for a term of one record, 0 for a term spread evenly over all.
    """
    if n_records < 2:
        return F.lit(1.0)
    entropy = F.ln("gf") - F.col("tl") / F.col("gf")
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - entropy / F.ln(F.lit(float(n_records))))), 9)


def term_spread(counts: DataFrame, n_records: int) -> DataFrame:
    """``(term, df, gf, g)``, the second aggregation, combined before its shuffle: records and occurrences of each term, and the weight of its spread."""
    s = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("tl"))
    return s.select("term", "df", "gf", spread_weight(n_records).alias("g"))


def _counted(records: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """The staged counts of the records, and how many records there are, those without words too."""
    df = records_of(records, key, text)
    n = records.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.xxhash64(text)).distinct().count()
    return staged(term_counts(df)), n


def _weighted(counts: DataFrame, spread: DataFrame, key: str) -> DataFrame:
    weight = F.round(F.ln(F.col("tf") + 1.0) * F.col("g"), 6)
    return counts.join(spread, "term").select(F.col("id").alias(key), "term", "tf", "df", weight.alias("weight"))


def log_entropy(records: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``(<key>, term, tf, df, weight)`` with ``weight = ln(1 + tf) * g(term)``, for every word of every record.

    Words are the longest runs of a-z in the lower-cased text, of four letters or more. Null and
    blank texts have no words; a repeated row counts once; two different texts under one key count
    as two records. An empty table gives an empty result. The counts are staged once and read twice:
    for the terms' spread, and to be joined with it.
    """
    counts, n = _counted(records, key, text)
    return _weighted(counts, small(staged(term_spread(counts, n))), key)


def typical_terms(records: DataFrame, key: str = "chunk_id", text: str = "text", least_tf: int = 3, most_df: int = 3) -> DataFrame:
    """:func:`log_entropy` of the terms that occur ``least_tf`` times or more in a record and in at most ``most_df`` records.

    Spread over at most ``d`` records, a term's entropy is at most ``ln d``. So ``g`` is at least
    ``1 - ln d / ln N`` and the weight at least ``ln(1 + least_tf)`` times that; the terms and rows
    that reach these bounds are taken by their weights and then checked. Only they are joined.
    """
    counts, n = _counted(records, key, text)
    bound = max(0.0, 1.0 - math.log(max(most_df, 1)) / math.log(n)) - 1e-6 if n > 1 else 0.0
    rare = term_spread(counts, n).filter(F.col("g") >= bound)
    found = _weighted(counts.filter(F.col("tf") >= least_tf), rare, key).filter(F.col("weight") >= math.log(1 + least_tf) * bound - 1e-5)
    return found.filter(F.col("df") <= most_df)


def question_overlap(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(qid, term, tf, weight, in_gold, overlap)``: a question's words with their weights over the chunks, and the share of weight its gold chunks hold.

    A word no chunk has weighs ``ln(1 + tf)``, as one of a single record would. ``overlap`` is 0 if
    no word has weight. Questions without gold chunks overlap 0. Repeated rows count once.
    """
    counts, n = _counted(chunks, "chunk_id", "text")
    spread = staged(term_spread(counts, n))
    q = staged(term_counts(records_of(questions, "qid", "question")).select(F.col("id").alias("qid"), "term", "tf"))
    gold = questions.filter("qid IS NOT NULL").select("qid", F.explode("gold_chunk_ids").alias("id")).distinct()
    gold_terms = counts.join(gold.select("id").distinct(), "id", "left_semi").select("id", "term").distinct()
    hit = gold.join(gold_terms, "id").join(q.select("qid", "term"), ["qid", "term"], "left_semi").select("qid", "term").distinct().withColumn("in_gold", F.lit(True))
    w = q.join(spread.select("term", "g"), "term", "left").join(hit, ["qid", "term"], "left")
    w = w.select("qid", "term", "tf", F.round(F.ln(F.col("tf") + 1.0) * F.coalesce("g", F.lit(1.0)), 6).alias("weight"), F.coalesce("in_gold", F.lit(False)).alias("in_gold"))
    share = w.groupBy("qid").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("in_gold"), F.col("weight")).otherwise(0.0)).alias("got"))
    share = share.select("qid", F.round(F.when(F.col("all") > 0, F.col("got") / F.col("all")).otherwise(0.0), 6).alias("overlap"))
    return w.join(share, "qid")
