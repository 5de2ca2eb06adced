"""Search, ablation, sweeps and per-question weights over candidate lists that are made once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.operators import metrics, retrieval
from skerry.runtime import once
from skerry.sources.files import Index

ALPHAS = tuple(i / 10 for i in range(11))
#: name -> dense, sparse, rerank (fixed values)
CONFIGS = {
    "BM25 only": (False, True, False),
    "Dense only": (True, False, False),
    "Hybrid (RRF)": (True, True, False),
    "BM25 + rerank": (False, True, True),
    "Dense + rerank": (True, False, True),
    "Hybrid + rerank": (True, True, True),
}


def ranked(lists: DataFrame, dense: bool = True, sparse: bool = True) -> DataFrame:
    """The fused order of ``lists(qid, id, dense_rank, sparse_rank)`` with either list or both; neither raises."""
    if not (dense or sparse):
        raise ValueError("at least one of dense and sparse is needed")
    keep = lambda on, c: F.col(c) if on else F.lit(None).cast("int").alias(c)
    return retrieval.fuse_ranks(lists.select("qid", "id", keep(dense, "dense_rank"), keep(sparse, "sparse_rank")))


def candidate_lists(questions: DataFrame, index: Index, qvecs: DataFrame | None, candidates: int = 50, fill: bool = False) -> DataFrame:
    """``(qid, id, dense_rank, sparse_rank)`` of both retrievers' top ``candidates``; without ``qvecs(qid, qvec)`` the sparse one alone.

    With ``fill`` the sparse list goes on with documents that match nothing, until it has ``candidates``.
    """
    s = retrieval.bm25_search(questions, index.postings, index.lengths, index.terms, candidates, fill=fill).select("qid", "id", F.lit(None).cast("int").alias("dense_rank"), F.col("rnk").alias("sparse_rank"))
    if qvecs is None:
        return s
    d = retrieval.dense_search(qvecs, index.vectors, candidates).select("qid", "id", F.col("rnk").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank"))
    return d.unionByName(s)


def search(questions: DataFrame, index: Index, qvecs: DataFrame | None = None, k: int = 8, candidates: int = 50, dense: bool = True, sparse: bool = True, logits: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """Hits of all ``questions(qid, question)`` at once, with their chunks: the fused top ``candidates``, reordered by ``logits(qid, id, logit)`` if given, cut to ``k``."""
    hits = ranked(candidate_lists(questions, index, qvecs, candidates, fill), dense and qvecs is not None, sparse).filter(F.col("rnk") <= candidates)
    if logits is not None:
        hits = retrieval.rerank(hits, logits, k, candidates).withColumn("score", F.coalesce("logit", "score"))
    return retrieval.hydrate(hits.filter(F.col("rnk") <= k), once(index.chunks))


def ablation(lists: DataFrame, logits: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """``(config, split, qid, <metrics>)`` of the six configurations, from lists and logits computed once.

    ``questions(qid, split)``. The three fused orders are made once each; with reranking their first
    50 are reordered.
    """
    parts = []
    for dense, sparse in ((False, True), (True, False), (True, True)):
        order = ranked(lists, dense, sparse)
        names = {rr: n for n, (d, s, rr) in CONFIGS.items() if (d, s) == (dense, sparse)}
        parts.append(order.filter("rnk <= 10").select(F.lit(names[False]).alias("config"), "qid", "id", "rnk"))
        parts.append(retrieval.rerank(order, logits, 10).select(F.lit(names[True]).alias("config"), "qid", "id", "rnk"))
    hits = reduce(DataFrame.unionByName, parts)
    asked = questions.select("qid", "split").distinct().withColumn("config", F.explode(F.array(*(F.lit(c) for c in CONFIGS))))
    scored = metrics.per_question(hits, gold, asked.select("config", "qid"), ("config",))
    return scored.join(questions.select("qid", "split").distinct(), "qid")


def sweep(maps: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """``(split, alpha, n, ndcg)``: mean nDCG@10 of the convex mixture at eleven weights of the dense scores."""
    alphas = F.explode(F.array(*(F.lit(a) for a in ALPHAS)))
    top = retrieval.convex(maps.withColumn("alpha", alphas), F.col("alpha"), 10, ("alpha", "qid"))
    asked = questions.select("qid").distinct().withColumn("alpha", alphas)
    scored = metrics.per_question(top, gold, asked, ("alpha",)).join(questions.select("qid", "split").distinct(), "qid")
    return scored.groupBy("split", "alpha").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


def best_alpha(curve: DataFrame) -> DataFrame:
    """``(split, alpha, ndcg)`` of the highest mean, the smallest weight of equal ones."""
    return retrieval.best(curve, ["split"], "ndcg", "alpha", 1).select("split", "alpha", "ndcg")


def first_hits(lists: DataFrame) -> DataFrame:
    """``(qid, d1, s1, disagree)``: each list's first id."""
    top = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c), "id")))["id"]
    return lists.groupBy("qid").agg(top("dense_rank").alias("d1"), top("sparse_rank").alias("s1")).withColumn("disagree", ~F.col("d1").eqNullSafe(F.col("s1")))


def weighted(maps: DataFrame, alphas: DataFrame, gold: DataFrame, fixed: float = 0.8) -> DataFrame:
    """``(qid, disagree, sv, sb, alpha, dat, fixed, dense)``: nDCG@10 of each question with its own weight, with ``fixed``, and of the dense list alone.

    ``alphas(qid, disagree, sv, sb)``; a missing grade makes both -1 and the weight ``fixed``.
    """
    ok = F.col("sv").isNotNull() & F.col("sb").isNotNull()
    a = alphas.select("qid", "disagree", F.when(ok, F.col("sv")).otherwise(-1).alias("sv"), F.when(ok, F.col("sb")).otherwise(-1).alias("sb"), F.when(ok, retrieval.dat_alpha(F.col("sv"), F.col("sb"))).otherwise(fixed).alias("alpha"))
    kinds = {"dat": F.col("alpha"), "fixed": F.lit(fixed), "dense": F.lit(1.0)}
    w = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("w")) for k, v in kinds.items())))
    each = a.select("qid", w.alias("x")).select("qid", "x.kind", "x.w")
    top = retrieval.convex(maps.join(each, "qid"), F.col("w"), 10, ("kind", "qid"))
    scored = metrics.per_question(top, gold, each.select("kind", "qid"), ("kind",))
    wide = scored.groupBy("qid").agg(*(F.max(F.when(F.col("kind") == k, F.col("ndcg"))).alias(k) for k in kinds))
    return a.join(wide, "qid")


def weight_report(rows: DataFrame) -> DataFrame:
    """One row: means of the three, over all and where the first hits differ, and wins and losses of own weights against fixed."""
    mean = lambda c, on=F.lit(True): F.round(F.coalesce(F.avg(F.when(on, F.col(c))), F.lit(0.0)), 6)
    differ = F.col("disagree")
    return rows.agg(
        F.count("*").alias("n"), F.count_if(differ).alias("n_disagree"), *(mean(c).alias(c) for c in ("dat", "fixed", "dense")), *(mean(c, differ).alias(f"{c}_disagree") for c in ("dat", "fixed", "dense")),
        F.count_if(F.col("dat") > F.col("fixed")).alias("wins"), F.count_if(F.col("dat") < F.col("fixed")).alias("losses"),
    )


def ablation_result(scored: DataFrame, questions: DataFrame, eval_sets: list[str], n_chunks: int, model: str, limit: int | None = None, most: int = 100_000) -> DataFrame:
    """One row with all that a result file holds: where it comes from, counts a ticker and split, means a split and configuration, and each question's nDCG.

    For sets of at most ``most`` questions, which are read by people; a larger one raises, and stays two frames.
    """
    n = questions.select("qid").distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"a result file of more than {most} questions")
    counts = lambda c: questions.select("qid", F.coalesce(c, F.lit("?")).alias("k")).distinct().groupBy("k").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(c))
    means = metrics.mean_metrics(scored, ("config", "split"), also_all=True)
    results = means.agg(F.sort_array(F.collect_list(F.struct("split", "config", "n", *metrics.METRICS))).alias("results"))
    each = scored.groupBy("config").agg(F.sort_array(F.collect_list(F.struct("qid", F.round("ndcg", 4).alias("ndcg")))).alias("q")).agg(F.map_from_entries(F.collect_list(F.struct("config", "q"))).alias("per_question_ndcg"))
    head = {"n_questions": n, "n_chunks": n_chunks, "embed_model": model, "eval_sets": eval_sets, "limit": limit}
    first = results.sparkSession.createDataFrame([tuple(head.values())], "n_questions long, n_chunks long, embed_model string, eval_sets array<string>, limit int")
    one = F.lit(1).alias("_one")  # each of these is one row
    frames = [f.withColumn("_one", one) for f in (first, counts("ticker").withColumnRenamed("ticker", "tickers"), counts("split").withColumnRenamed("split", "splits"), results, each)]
    return reduce(lambda a, b: a.join(b, "_one"), frames).drop("_one")
