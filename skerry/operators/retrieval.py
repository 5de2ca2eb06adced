"""Dense and sparse search, rank and score fusion, and reranking, over batches of questions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions.text import index_tokens, rerank_text
from skerry.runtime import small, staged


def best(df: DataFrame, group: list[str], score: str, tie: str, k: int, rank: str = "rnk") -> DataFrame:
    """The ``k`` rows of each group with the highest ``score``, ties by ``tie``, numbered from 1 in ``rank``.

    Spark keeps only ``k`` rows of a group in each task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _best_columns(s: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of ``s`` has its ``k`` largest values and all less than ``slack`` below them: row and column numbers, and some more at times.

    The ``k``-th largest of the maxima of groups of columns is no more than the ``k``-th largest value, so only the maxima are partitioned.
    """
    n = s.shape[1]
    groups = n // 16
    if groups >= 2 * k:
        top = s[:, : 16 * groups].reshape(len(s), 16, groups).max(1)
        top = top if 16 * groups == n else np.hstack([top, s[:, 16 * groups :]])
    else:
        top = s
    m = min(k, top.shape[1])
    edge = np.partition(top, top.shape[1] - m, axis=1)[:, top.shape[1] - m]
    return np.divmod(np.flatnonzero(s >= (edge - slack)[:, None]), n)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 50, without_self: bool = False, places: int = 6, block: int = 65_536) -> DataFrame:
    """``(qid, id, score, rnk)``: the exact top ``k`` of ``vectors(id, vec)`` for each of ``queries(qid, qvec)`` by cosine, rounded, ties by id.

    Queries and vectors are cut into blocks of about ``block`` rows; a task multiplies one block of
    each as matrices and passes on its ``k`` best a query, so that memory is bounded however many
    there are. Products in single precision leave out what can't be among the best by more than their
    error; the others are scored in double precision. A vector of zeros scores 0; nulls, and vectors of
    another length than most, are left out.
    """
    q = queries.filter("qid IS NOT NULL AND qvec IS NOT NULL").select("qid", F.col("qvec").cast("array<double>").alias("v"))
    x = vectors.filter("id IS NOT NULL AND vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("v"))
    nq, nx = q.count(), x.count()
    dim = x.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = dim[0]["d"] if dim else 0
    parts = lambda n: max(1, -(-n // block))
    mod = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bq, bx = parts(nq), max(parts(nx), min(8, parts(nx * max(nq, 1) // 1000)))
    q = q.filter(F.size("v") == d).withColumn("bq", mod("qid", bq)).withColumn("bx", every(bx))
    x = x.filter(F.size("v") == d).withColumn("bx", mod("id", bx)).withColumn("bq", every(bq))
    kinds = queries.schema["qid"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()

    def matrix(t: pa.Table) -> np.ndarray:
        m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)
        return m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) == 0, 1, n)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            a, b = matrix(left), matrix(right)
            a4, b4 = a.astype(np.float32), b.astype(np.float32).T.copy()
            most = k
            if without_self:  # besides itself, which may come several times, a query has k others
                most += max(c.as_py() for c in right["id"].value_counts().field("counts"))
            slack = 2.0 * 10.0**-places + 4e-7 * (d + 8)
            for i in range(0, len(a), 128):
                s = a4[i : i + 128] @ b4
                row, col = _best_columns(s, most, slack)
                score = np.round(np.einsum("ij,ij->i", a[i + row], b[col]), places) + 0.0
                if without_self:
                    other = np.asarray(pa.compute.not_equal(left["qid"].take(pa.array(i + row)), right["id"].take(pa.array(col))))
                    row, col, score = row[other], col[other], score[other]
                by = np.lexsort((col, -score, row))
                row, col, score = row[by], col[by], score[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                found.append((i + row[place < k], col[place < k], score[place < k]))
        i, j, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"qid": left["qid"].take(pa.array(i)), "id": right["id"].take(pa.array(j)), "score": score})

    found = q.groupBy("bq", "bx").cogroup(x.groupBy("bq", "bx")).applyInArrow(product, f"qid {kinds[0]}, id {kinds[1]}, score double")
    return best(found, ["qid"], "score", "id", k)


def postings(corpus: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(term, id, tf)``, ``(id, dl)`` and ``(term, df)`` of ``corpus(id, text)``; documents without a token have length 0."""
    t = corpus.select("id", F.coalesce(index_tokens("text"), F.array().cast("array<string>")).alias("tokens"))
    post = t.select("id", F.explode("tokens").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))
    return post, t.select("id", F.size("tokens").alias("dl")), post.groupBy("term").agg(F.count("*").alias("df"))


def _impacts(queries: DataFrame, post: DataFrame, docs: DataFrame, terms: DataFrame, k1: float, b: float) -> tuple[DataFrame, DataFrame]:
    """``(qid, term, w)``, the questions' weighted terms, staged; and ``(term, id, x)``, the saturated tf of the postings they need."""
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = stats["n"], stats["avgdl"] or 1.0
    q = queries.select("qid", F.explode(index_tokens("question")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = staged(q.join(terms, "term").select("qid", "term", (F.col("qtf") * idf).alias("w")))
    weight = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    hits = post.join(small(asked.select("term").distinct()), "term", "left_semi").join(small(docs), "id")
    return asked, hits.select("term", "id", weight.alias("x"))


def bm25_scores(queries: DataFrame, post: DataFrame, docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, keep_zero: bool = False, places: int = 6) -> DataFrame:
    """``(qid, id, score)`` of ``queries(qid, question)``: the sum over a question's tokens, repeats included, of idf times saturated tf.

    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``; a tf of ``tf`` counts ``tf / (tf + k1 (1 - b + b dl / avgdl))``.
    Every document that shares a term is scored: for all scores, not for the best, which are
    :func:`bm25_search`'s. Documents that share no term don't come out; those whose sum isn't
    positive only with ``keep_zero``.
    """
    asked, hits = _impacts(queries, post, docs, terms, k1, b)
    out = small(asked).join(hits.repartition("id"), "term").groupBy("qid", "id").agg(F.round(F.sum(F.col("w") * F.col("x")), places).alias("score"))
    return out if keep_zero else out.filter("score > 0")


def _best_of_block(terms: np.ndarray, rows: np.ndarray, x: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, places: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (ascending) and scores, for each question of ``asked(terms, weights)``, of a block's ``k`` best rows and all that tie with the last.

    Scores of all rows are added up term by term; terms that many rows have are added as whole columns.
    """
    order = np.argsort(terms, kind="stable")
    terms, rows, x = terms[order], rows[order], x[order]
    begin = np.flatnonzero(np.diff(terms, prepend=terms[0] - 1)) if len(terms) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(terms))
    there = terms[begin]
    wide = {}
    for t in np.flatnonzero(8 * (end - begin) > n):
        wide[int(t)] = np.zeros(n)
        wide[int(t)][rows[begin[t] : end[t]]] = x[begin[t] : end[t]]
    acc, one = np.zeros((1, n)), np.zeros(n)
    all_rows = acc[0]
    out = []
    for ts, ws in asked:
        at = np.minimum(np.searchsorted(there, ts), max(0, len(there) - 1))
        known = there[at] == ts if len(there) else np.zeros(len(ts), bool)
        all_rows[:] = 0.0
        for t, w in zip(at[known].tolist(), ws[known].tolist()):
            if t in wide:
                np.multiply(wide[t], w, out=one)
                all_rows += one
            else:
                all_rows[rows[begin[t] : end[t]]] += w * x[begin[t] : end[t]]
        cand = _best_columns(acc, k, 2.0 * 10.0**-places)[1] if known.any() else np.zeros(0, np.int64)
        score = np.round(all_rows[cand], places)
        keep = score > 0
        if keep.sum() > k:
            keep &= score >= -np.partition(-score, k - 1)[k - 1]
        out.append((cand[keep], score[keep]))
    return out


def bm25_search(queries: DataFrame, post: DataFrame, docs: DataFrame, terms: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, fill: bool = False, places: int = 6, block: int = 65_536, part: int = 65_536) -> DataFrame:
    """``(qid, id, score, rnk)``: the ``k`` documents of highest :func:`bm25_scores`, ties by id.

    Documents are cut into blocks of about ``block``, questions into parts of about ``part``; each
    pair is one group's work (:func:`_best_of_block`), in which only a question's best come out. With ``fill``, questions that fewer than ``k``
    documents match are filled up with documents of score 0, by id.
    """
    asked, hits = _impacts(queries, post, docs, terms, k1, b)
    n_docs, n_q = docs.count(), asked.select("qid").distinct().count()
    slots = asked.sparkSession.sparkContext.defaultParallelism
    blocks, parts = max(1, -(-n_docs // block), min(slots, n_docs // 2048)), max(1, -(-n_q // part))
    mod = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(mod("qid", parts).alias("p"), every(blocks).alias("b"), "qid", F.xxhash64("term").alias("term"), "w")
    right = hits.select(every(parts).alias("p"), mod("id", blocks).alias("b"), F.xxhash64("term").alias("term"), "id", "x")
    kinds = queries.schema["qid"].dataType.simpleString(), docs.schema["id"].dataType.simpleString()

    def search(q: pa.Table, d: pa.Table) -> pa.Table:
        qids, ids, scores = [], [], []
        if q.num_rows and d.num_rows:
            q = q.sort_by("qid")
            qid = q.column("qid").combine_chunks().dictionary_encode()
            qid = qid.combine_chunks() if isinstance(qid, pa.ChunkedArray) else qid
            code, t, w = qid.indices.to_numpy(), q.column("term").to_numpy(), q.column("w").to_numpy()
            starts = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
            names = d.column("id").combine_chunks().dictionary_encode()
            names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
            # Rows are numbered by id, so that ties go to the least.
            rank = pa.compute.rank(names.dictionary).to_numpy().astype(np.int64) - 1
            by_rank = names.dictionary.take(pa.array(np.argsort(rank)))
            rows = rank[names.indices.to_numpy()]
            found = _best_of_block(d.column("term").to_numpy(), rows, d.column("x").to_numpy(), [(t[i:j], w[i:j]) for i, j in zip(starts[:-1], starts[1:])], len(rank), k, places)
            for i, (r, s) in zip(starts[:-1], found):
                order = np.lexsort((r, -s))[:k]
                qids.append(np.full(len(order), code[i]))
                ids.append(r[order])
                scores.append(s[order])
            return pa.table({"qid": qid.dictionary.take(pa.array(np.concatenate(qids), pa.int64())), "id": by_rank.take(pa.array(np.concatenate(ids), pa.int64())), "score": pa.array(np.concatenate(scores))})
        return pa.table({"qid": q.column("qid").slice(0, 0), "id": d.column("id").slice(0, 0), "score": pa.array([], pa.float64())})

    found = left.groupBy("p", "b").cogroup(right.groupBy("p", "b")).applyInArrow(search, f"qid {kinds[0]}, id {kinds[1]}, score double")
    if not fill:
        return best(found, ["qid"], "score", "id", k)
    found = staged(best(found, ["qid"], "score", "id", k).select("qid", "id", "score"))
    short = queries.select("qid").distinct().join(found.groupBy("qid").agg(F.count("*").alias("n")), "qid", "left").filter(F.coalesce("n", F.lit(0)) < k).select("qid")
    # Among the 2 k documents of least id, at least k are not found yet.
    first = docs.select("id").distinct().orderBy("id").limit(2 * k).withColumn("one", F.lit(1))
    zero = short.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").select("qid", "id").join(found, ["qid", "id"], "left_anti").select("qid", "id", F.lit(0.0).alias("score"))
    return best(found.unionByName(zero), ["qid"], "score", "id", k)


def fuse_ranks(ranks: DataFrame, constant: int = 60) -> DataFrame:
    """``(qid, id, score, dense_rank, sparse_rank, rnk)`` from ``ranks(qid, id, dense_rank, sparse_rank)``: reciprocal rank fusion of the lists there are.

    A rank that is null adds nothing; with one list the order is that list's. Equal scores keep the
    dense list's order, then the sparse list's, then the id's.
    """
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (constant + F.col(c))).otherwise(0.0)
    both = ranks.groupBy("qid", "id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank")).filter("dense_rank IS NOT NULL OR sparse_rank IS NOT NULL")
    both = both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), "id")
    return both.withColumn("rnk", F.row_number().over(w))


def minmax(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """``scores`` with ``norm``: the score scaled to 0..1 within each group, 1 for all if they are equal; 9 digits.

    A group's ends come from one combined aggregation and are joined to its rows, so no task holds a group.
    """
    ends = scores.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    norm = F.when(F.col("_hi") <= F.col("_lo"), F.lit(1.0)).otherwise(F.round((F.col(score) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0)), 9))
    return scores.join(ends, same).withColumn("norm", norm).select(*scores.columns, "norm")


def score_maps(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """``(qid, id, nd, ns)``: both retrievers' normalised scores side by side, 0 where one lacks the id."""
    d = minmax(dense, ["qid"]).select("qid", "id", F.col("norm").alias("nd"), F.lit(0.0).alias("ns"))
    s = minmax(sparse, ["qid"]).select("qid", "id", F.lit(0.0).alias("nd"), F.col("norm").alias("ns"))
    return d.unionByName(s).groupBy("qid", "id").agg(F.sum("nd").alias("nd"), F.sum("ns").alias("ns"))


def convex(maps: DataFrame, alpha: Column, k: int = 10, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """``maps`` with ``score = alpha nd + (1 - alpha) ns``, the best ``k`` of each group in ``rnk``."""
    mixed = maps.withColumn("score", F.round(alpha * F.col("nd") + (1 - alpha) * F.col("ns"), 9))
    return best(mixed, list(by), "score", "id", k)


def dat_alpha(sv: Column, sb: Column) -> Column:
    """A question's weight of the dense list from two grades 0..5: a half if both are 0, all to one that alone is perfect, else its share, to one digit half-even."""
    share = F.bround((sv / F.nullif(sv + sb, F.lit(0))).cast("double"), 1)
    return F.when((sv == 0) & (sb == 0), 0.5).when((sv == 5) & (sb != 5), 1.0).when((sb == 5) & (sv != 5), 0.0).otherwise(share)


def grade(text: Column) -> Column:
    """A grade as a number from 0 to 5; null if it is none."""
    n = text.try_cast("double").cast("int")
    return F.when(n.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), n)))


def rerank(candidates: DataFrame, logits: DataFrame, k: int, cut: int = 50) -> DataFrame:
    """The first ``cut`` of ``candidates(qid, id, rnk, ...)`` reordered by ``logits(qid, id, logit)``, the best ``k`` kept; without a logit an id comes after all with one, in its old order."""
    c = candidates.filter(F.col("rnk") <= cut).join(logits, ["qid", "id"], "left").withColumnRenamed("rnk", "first_rnk")
    w = Window.partitionBy("qid").orderBy(F.col("logit").desc_nulls_last(), "first_rnk", "id")
    return c.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with the chunks they name; an id that names none is dropped."""
    return hits.join(chunks.withColumnRenamed("chunk_id", "id"), "id")


def passages(hits: DataFrame) -> DataFrame:
    """Hydrated hits with ``passage``, the text a reranker reads."""
    return hits.withColumn("passage", rerank_text("breadcrumb", "text"))
