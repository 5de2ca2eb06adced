"""Problem 1: one ranking out of several scores by reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.runtime import filled, hot_keys

#: field -> True if a high value is good
FIELDS = {"score": True, "dense_rank": False, "sparse_rank": False, "rerank_logit": True}
BINS = 256


def distributed_rank(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``df(group..., value, n)`` of distinct values with their counts, plus ``rnk``, the competition rank of ``value`` from the top.

    No task holds a group: quantiles cut each group into ``BINS`` bins, ranks are counted inside a
    bin, and a running total over the at most ``BINS + 1`` bins of a group gives each bin's start.
    """
    cuts = df.groupBy(*group).agg(F.percentile_approx(value, [i / BINS for i in range(1, BINS)], 2000).alias("_cuts"))
    binned = df.join(cuts, group).withColumn("_bin", F.expr(f"size(filter(_cuts, c -> c > {value}))")).drop("_cuts")
    starts = binned.groupBy(*group, "_bin").agg(F.sum("n").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy(*group).orderBy("_bin")) - F.col("_n")).drop("_n")
    inside = F.sum("n").over(Window.partitionBy(*group, "_bin").orderBy(F.desc(value))) - F.col("n")
    return binned.withColumn("_in", inside).join(starts, [*group, "_bin"]).withColumn("rnk", F.col("_start") + F.col("_in") + 1).drop("_bin", "_in", "_start")


def _hot(h: DataFrame, k: int) -> DataFrame:
    """Scores of the hits of queries too large for one task."""
    long = h.select("qid", "chunk_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) if up else -F.col(f)).alias("v")) for f, up in FIELDS.items()))).alias("x"))
    long = long.select("qid", "chunk_id", "x.field", "x.v").filter("v IS NOT NULL")
    values = long.groupBy("qid", "field", "v").agg(F.count("*").alias("n"))
    part = long.join(distributed_rank(values, ["qid", "field"], "v"), ["qid", "field", "v"])
    part = part.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (F.col("rnk") + k)).alias("rrf"))
    return h.select("qid", "chunk_id").join(part, ["qid", "chunk_id"], "left").withColumn("rrf", F.round(F.coalesce("rrf", F.lit(0.0)), 12))


def rank_fusion(hits: DataFrame, k: int = 60, hot_rows: int = 500_000) -> DataFrame:
    """``(qid, chunk_id, rrf, fused_rank)``: for every query one order of its hits.

    Per query each field ranks the hits that have it (ties share the better rank), whatever its
    scale; a hit's total is the sum of ``1 / (k + rank)``. Equal totals are ordered by ``chunk_id``.

    Nulls and NaN in a field add nothing; a hit with no field at all comes last with a total of 0.
    Rows without ``qid`` or ``chunk_id`` are dropped. Repeated hits count once, with the best value
    of each field. Extra columns are ignored; an empty table gives an empty result. One shuffle on
    ``qid`` serves the merging of repeats and all five windows; a query of more than ``hot_rows``
    rows is ranked without ever gathering it in a task, with the same result.
    """
    best = [(F.max if up else F.min)(f).alias(f) for f, up in FIELDS.items()]
    h = hits.filter("qid IS NOT NULL AND chunk_id IS NOT NULL").select("qid", "chunk_id", *(filled(f).alias(f) for f in FIELDS))
    hot = hot_keys(h, "qid", hot_rows)
    w = Window.partitionBy("qid")
    cool = (h.filter(~F.col("qid").isin(hot)) if hot else h).repartition("qid").groupBy("qid", "chunk_id").agg(*best)
    for f, up in FIELDS.items():
        order = F.col(f).desc_nulls_last() if up else F.col(f).asc_nulls_last()
        cool = cool.withColumn(f"_{f}", F.when(F.col(f).isNotNull(), 1.0 / (F.rank().over(w.orderBy(order)) + k)).otherwise(0.0))
    total = F.round(sum((F.col(f"_{f}") for f in FIELDS), F.lit(0.0)), 12)
    out = cool.select("qid", "chunk_id", total.alias("rrf")).withColumn("fused_rank", F.row_number().over(w.orderBy(F.desc("rrf"), "chunk_id")).cast("long"))
    if hot:
        big = _hot(h.filter(F.col("qid").isin(hot)).groupBy("qid", "chunk_id").agg(*best), k)
        ranks = distributed_rank(big.groupBy("qid", "rrf").agg(F.count("*").alias("n")), ["qid"], "rrf").select("qid", "rrf", "rnk")
        ties = F.row_number().over(Window.partitionBy("qid", "rrf").orderBy("chunk_id"))
        big = big.join(ranks, ["qid", "rrf"]).select("qid", "chunk_id", "rrf", (F.col("rnk") + ties - 1).cast("long").alias("fused_rank"))
        out = out.unionByName(big)
    return out
