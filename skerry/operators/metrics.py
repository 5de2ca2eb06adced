"""Retrieval metrics of ranked hits against gold, and comparisons between rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``hits(..., qid, id, rnk)`` with ``hit``, whether the id is gold for the question."""
    g = gold.select("qid", "id").distinct().withColumn("_gold", F.lit(True))
    return hits.join(g, ["qid", "id"], "left").withColumn("hit", F.coalesce("_gold", F.lit(False))).drop("_gold")


def ideal(n: Column, k: int) -> Column:
    """The discounted gain of ``min(n, k)`` hits at the top; null for none."""
    gains = F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))
    return F.when(n > 0, F.aggregate(gains, F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + F.lit(1.0))))


def per_question(hits: DataFrame, gold: DataFrame, questions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., qid, r1, s1, r5, r10, ndcg, mrr)`` at ranks 1, 5 and 10.

    ``questions(by..., qid)`` says which rows come out: a question without hits, or without gold,
    scores 0. Recall is the share of gold found; success whether the first hit is gold; the gain of a
    gold hit at rank ``r`` is ``1 / log2(r + 1)``, against that of all gold at the top; the reciprocal
    is of the first gold hit's rank.
    """
    n = gold.select("qid", "id").distinct().groupBy("qid").agg(F.count("*").alias("n"))
    keys = [*by, "qid"]
    found = judged(hits, gold).filter(F.col("hit") & (F.col("rnk") <= 10))
    at = lambda k: F.count_if(F.col("rnk") <= k)
    got = found.groupBy(*keys).agg(at(1).alias("h1"), at(5).alias("h5"), at(10).alias("h10"), F.sum(1.0 / F.log2(F.col("rnk") + 1.0)).alias("dcg"), F.min("rnk").alias("first"))
    q = questions.select(*keys).distinct().join(n, "qid", "left").join(got, keys, "left")
    r = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 6)
    return q.select(
        *keys, r(F.col("h1") / F.col("n")).alias("r1"), r((F.col("h1") > 0).cast("double")).alias("s1"), r(F.col("h5") / F.col("n")).alias("r5"),
        r(F.col("h10") / F.col("n")).alias("r10"), r(F.col("dcg") / ideal(F.col("n"), 10)).alias("ndcg"), r(1.0 / F.col("first")).alias("mrr"),
    )


METRICS = ("r1", "s1", "r5", "r10", "ndcg", "mrr")


def mean_metrics(scored: DataFrame, by: tuple[str, ...], also_all: bool = False) -> DataFrame:
    """``(by..., n, <metrics>)``: means over questions; with ``also_all`` a further group ``all`` in place of the last of ``by``."""
    means = [F.round(F.avg(m), 6).alias(m) for m in METRICS]
    if not also_all:
        return scored.groupBy(*by).agg(F.count("*").alias("n"), *means)
    sets = scored.groupingSets([[F.col(c) for c in by], [F.col(c) for c in by[:-1]]], *by)
    out = sets.agg(F.count("*").alias("n"), *means, F.grouping(by[-1]).alias("_all"))
    return out.withColumn(by[-1], F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(by[-1]))).drop("_all")


def log_choose(n: Column, k: Column) -> Column:
    """Natural logarithm of the binomial coefficient, as a sum."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln(((n - k + i) / i).cast("double")))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided sign test: the chance of a split at least as uneven if either side were as likely; 1 without any."""
    n, m = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    tail = F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, k: s + F.exp(log_choose(n, k) - n * F.ln(F.lit(2.0))))
    return F.least(F.lit(1.0), 2 * tail)


def paired(scored: DataFrame, config: str, first: str, second: str, metric: str = "ndcg", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., wins, losses, ties, p)`` of ``first`` against ``second`` over the questions both have, in one aggregation."""
    pick = lambda name: F.max(F.when(F.col(config) == name, F.col(metric)))
    both = scored.filter(F.col(config).isin(first, second)).groupBy(*by, "qid").agg(pick(first).alias("a"), pick(second).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    count = [F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties")]
    out = both.groupBy(*by).agg(*count) if by else both.agg(*count)
    return out.withColumn("p", F.round(sign_test(F.col("wins"), F.col("losses")), 6))
