"""Problem 9: sources mixed to target weights, by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm.tokens import VOCABULARY, token_count
from skerry.runtime import staged

BINS = 1024


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens, quality)`` of every distinct document; quality is characters a token, between a tenth and one and a half of 4.

    Running text takes about four characters a token, codes and noise fewer.
    """
    n = F.col("n_tokens")
    rows = documents.select("doc_id", "source", F.length("text").alias("chars"), token_count("text", vocabulary).alias("n_tokens")).distinct()
    quality = F.when(n > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.5), F.col("chars") / n / 4))).otherwise(F.lit(0.1))
    return rows.select("doc_id", "source", n.cast("long").alias("n_tokens"), quality.alias("quality"))


def shares(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target source: ``(source, weight, max_repeats, tokens, target, epochs, rest, capped)``.

    ``target`` is weight times the tokens of all documents; ``epochs`` whole copies of the source and
    ``rest`` tokens of one more come to it, but never to more than ``max_repeats`` copies; ``capped``
    says that the target is out of reach. A null weight or limit counts as 0; repeated rows count
    once. A source without documents has 0 tokens.
    """
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = F.coalesce(F.lit(docs.agg(F.sum("n_tokens")).first()[0]), F.lit(0))
    t = targets.select("source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).filter("source IS NOT NULL").distinct()
    t = t.join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    most = F.col("max_repeats") * F.col("tokens")
    t = t.withColumn("target", F.col("weight") * total).withColumn("capped", F.col("target") > most)
    budget = F.least("target", most.cast("double"))
    epochs = F.when(F.col("tokens") > 0, F.floor(budget / F.nullif("tokens", F.lit(0)))).otherwise(F.lit(0)).cast("int")
    t = t.withColumn("epochs", F.least(epochs, F.col("max_repeats")))
    return t.withColumn("rest", F.greatest(F.lit(0.0), budget - F.col("epochs") * F.col("tokens")))


def mixture(docs: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)``: how many times each document is used, at least once.

    Whole epochs use every document of the source. For the rest, documents are drawn without
    replacement with chances by quality: each gets the key ``-ln(u) / quality``, with ``u`` hashed
    from ``seed`` and ``doc_id``, and the smallest keys are taken as long as their running total of
    tokens stays within the rest. Documents of a source that is not a target are left out.

    Keys fall into ``BINS`` bins by a fixed increasing function. Tokens are first totalled a source
    and bin, which decides every bin but the one where the budget ends; only that bin is sorted.
    So no task sorts a source, however large.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    d = docs.filter("source IS NOT NULL").withColumn("key", -F.ln(u) / F.col("quality"))
    d = d.withColumn("bin", F.floor((1.0 - F.exp(-F.col("key"))) * BINS).cast("int"))
    sums = d.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
    end = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    sums = sums.withColumn("end", end).join(plan.select("source", "epochs", "rest"), "source")
    state = F.when(F.col("end") <= F.col("rest"), F.lit(1)).when(F.col("end") - F.col("n") >= F.col("rest"), F.lit(0)).otherwise(F.lit(2))
    sums = sums.select("source", "bin", "epochs", (F.col("rest") - F.col("end") + F.col("n")).alias("room"), state.alias("state"))
    d = d.join(sums, ["source", "bin"])
    settled = d.filter("state <> 2").withColumn("copies", F.col("epochs") + F.col("state"))
    run = F.sum("n_tokens").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = d.filter("state = 2").withColumn("copies", F.col("epochs") + (run <= F.col("room")).cast("int"))
    return settled.unionByName(edge).filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def reached(mix: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows with what the mixture holds: ``(source, weight, max_repeats, tokens, target, capped, used, share)``; ``share`` of all tokens used."""
    used = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"))
    rows = staged(plan.join(used, "source", "left").withColumn("used", F.coalesce("used", F.lit(0))))
    total = rows.agg(F.sum("used")).first()[0] or 0
    return rows.select("source", "weight", "max_repeats", "tokens", "target", "capped", "used", F.round(F.col("used") / F.lit(max(total, 1)), 9).alias("share"))


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares it reached. Texts are measured once. Null texts have no tokens and are used along with their source."""
    docs = staged(sized(documents, vocabulary))
    plan = shares(docs, targets)
    mix = mixture(docs, plan)
    return mix, reached(mix, plan)
