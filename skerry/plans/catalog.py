"""The query catalogue: every operator over the tables of a data directory, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import chat, facts, jsonx, text
from skerry.operators import chunking, flatten, html, labels, metrics, retrieval, sampling
from skerry.plans import eval_sets, retrieval as plans
from skerry.runtime import filled, once, small, staged, table
from skerry.sources import files, providers
from skerry.sources.files import question_year

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _in(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# What several statements begin with.
STOP, INDEX_STOP = _in(text.STOP_WORDS), _in(text.INDEX_STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9'']+'), lambda w: length(w) > 2 and not list_contains({STOP}, w))"
OVERLAP = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9'']+'), lambda w: length(w) > 3))"
INDEX_TOKENS = "list_filter(regexp_extract_all(lower({0}), '[\\p{L}\\p{N}_]{2,}'), lambda w: not list_contains(" + INDEX_STOP + ", w))"
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
QS = "qs AS (SELECT DISTINCT qid, question, ticker, split, gold_chunk_ids FROM eval_narrative)"
GOLD = "gold AS (SELECT DISTINCT qid, unnest(gold_chunk_ids) AS id FROM eval_narrative)"
CH = "ch AS (SELECT DISTINCT chunk_id, ticker, form, report_date, item, item_title, kind, text, breadcrumb FROM chunks)"
LISTS = """h AS (SELECT qid, chunk_id AS id, min(dense_rank) AS dense_rank, min(sparse_rank) AS sparse_rank, max(score) AS score,
  max(CASE WHEN isnan(rerank_logit) THEN NULL ELSE rerank_logit END) AS logit FROM hits GROUP BY ALL)"""
MAPS = """d AS (SELECT qid, id, score, min(score) OVER w AS lo, max(score) OVER w AS hi FROM h WHERE dense_rank IS NOT NULL WINDOW w AS (PARTITION BY qid)),
s AS (SELECT qid, id, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM (SELECT qid, id, 1.0::DOUBLE / sparse_rank AS x FROM h WHERE sparse_rank IS NOT NULL) WINDOW w AS (PARTITION BY qid)),
m AS (SELECT qid, id, sum(nd) AS nd, sum(ns) AS ns FROM (
  SELECT qid, id, CASE WHEN hi <= lo THEN 1.0 ELSE round((score - lo) / (hi - lo), 9) END::DOUBLE AS nd, 0::DOUBLE AS ns FROM d UNION ALL
  SELECT qid, id, 0::DOUBLE, CASE WHEN hi <= lo THEN 1.0 ELSE round((x - lo) / (hi - lo), 9) END::DOUBLE FROM s) GROUP BY ALL)"""


def scored_sql(hits: str, keys: str) -> str:
    """Per-question metrics of a relation of hits with ``keys``, ``qid``, ``id``, ``rnk``, for the relation ``asked(keys, qid)``."""
    k = f"{keys}, qid" if keys else "qid"
    on = " AND ".join(f"a.{c.strip()} = g.{c.strip()}" for c in k.split(","))
    sel = ", ".join(f"a.{c.strip()}" for c in k.split(","))
    return f"""n AS (SELECT qid, count(*) AS n FROM gold GROUP BY qid),
got AS (SELECT {", ".join("x." + c.strip() for c in k.split(","))}, count(*) FILTER (rnk <= 1) AS h1, count(*) FILTER (rnk <= 5) AS h5, count(*) AS h10, sum(1.0::DOUBLE / log2(rnk + 1.0)) AS dcg, min(rnk) AS first
  FROM {hits} x JOIN gold ON x.qid = gold.qid AND x.id = gold.id WHERE rnk <= 10 GROUP BY ALL),
scored AS (SELECT {sel}, round(coalesce(h1::DOUBLE / n, 0), 6) AS r1, round(coalesce((h1 > 0)::INT::DOUBLE, 0), 6) AS s1, round(coalesce(h5::DOUBLE / n, 0), 6) AS r5, round(coalesce(h10::DOUBLE / n, 0), 6) AS r10,
  round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0))), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr
  FROM asked a LEFT JOIN n ON a.qid = n.qid LEFT JOIN got g ON {on})"""


MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in metrics.METRICS)
RANKED = """fused AS (SELECT qid, id, dense_rank, sparse_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0), 9) AS score FROM h WHERE dense_rank IS NOT NULL OR sparse_rank IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank ASC NULLS LAST, sparse_rank ASC NULLS LAST, id) AS rnk FROM fused)"""
ABLATION = f"""{LISTS}, {GOLD}, {QS},
orders AS (SELECT c AS c0, qid, id, logit, row_number() OVER (PARTITION BY c, qid ORDER BY score DESC, dr ASC NULLS LAST, sr ASC NULLS LAST, id) AS rnk FROM (
  SELECT *, round(coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0), 9) AS score FROM (
    SELECT 'BM25' AS c, qid, id, logit, NULL::INT AS dr, sparse_rank AS sr FROM h UNION ALL SELECT 'Dense', qid, id, logit, dense_rank, NULL FROM h UNION ALL SELECT 'Hybrid', qid, id, logit, dense_rank, sparse_rank FROM h)
  WHERE dr IS NOT NULL OR sr IS NOT NULL)),
top AS (SELECT CASE c0 WHEN 'BM25' THEN 'BM25 only' WHEN 'Dense' THEN 'Dense only' ELSE 'Hybrid (RRF)' END AS config, qid, id, rnk FROM orders UNION ALL
  SELECT c0 || ' + rerank', qid, id, row_number() OVER (PARTITION BY c0, qid ORDER BY logit DESC NULLS LAST, rnk, id) FROM orders WHERE rnk <= 50),
asked AS (SELECT DISTINCT unnest({_in(list(plans.CONFIGS))}) AS config, qid FROM qs),
{scored_sql("top", "config")}, final AS (SELECT scored.*, split FROM scored JOIN (SELECT DISTINCT qid, split FROM qs) USING (qid))"""


# ---- shared inputs


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_narrative").filter("qid IS NOT NULL").select("qid", "question", "ticker", "split", "gold_chunk_ids").distinct()


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_narrative").filter("qid IS NOT NULL").select("qid", F.explode("gold_chunk_ids").alias("id")).distinct()


CHUNK = ("chunk_id", "ticker", "form", "report_date", "item", "item_title", "kind", "text", "breadcrumb")


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The distinct rows of some columns of the chunks: only these are read and shuffled."""
    return table(spark, d, "chunks").select(*(columns or CHUNK)).distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "chunk_id", "text").withColumnRenamed("chunk_id", "id")


def lists(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hits").filter("qid IS NOT NULL").select("qid", F.col("chunk_id").alias("id"), "dense_rank", "sparse_rank", "score", filled("rerank_logit").alias("logit"))
    return h.groupBy("qid", "id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"), F.max("score").alias("score"), F.max("logit").alias("logit"))


def logits(h: DataFrame) -> DataFrame:
    return h.filter("logit IS NOT NULL").select("qid", "id", "logit")


def maps(h: DataFrame) -> DataFrame:
    """The dense side is the score of what the dense list holds, the sparse side the inverse of the sparse rank."""
    sparse = h.filter("sparse_rank IS NOT NULL").select("qid", "id", (1.0 / F.col("sparse_rank")).alias("score"))
    return retrieval.score_maps(h.filter("dense_rank IS NOT NULL").select("qid", "id", "score"), sparse)


def first_gold(spark: SparkSession, d: str) -> DataFrame:
    """``(pid, question, gold_text)``: each question with the text of its first gold chunk."""
    q = questions(spark, d).select(F.col("qid").alias("pid"), "question", F.get("gold_chunk_ids", F.lit(0)).alias("chunk_id"))
    c = texts(spark, d).toDF("chunk_id", "gold_text")
    return q.join(c, "chunk_id", "left").select("pid", "question", "gold_text")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """What the sparse index sees of each chunk."""
    return chunks(spark, d, "chunk_id", "breadcrumb", "text").select(F.col("chunk_id").alias("id"), F.coalesce(text.embed_text("breadcrumb", "text"), "text").alias("text"))


# ---- dense search

UNIT = "(SELECT {id} AS id, list_transform(e, lambda x: x / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS u FROM (SELECT *, sqrt(list_dot_product(e, e)) AS n FROM (SELECT {id}, list_transform({vec}, lambda x: x::DOUBLE) AS e FROM (SELECT DISTINCT {id}, {vec} FROM {t} WHERE {vec} IS NOT NULL))))"
DENSE = f"""u AS {UNIT.format(id="vec_id", vec="embedding", t="embeddings")},
top AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM (SELECT q.id AS qid, u.id, round(list_dot_product(q.u, u.u), 6) AS score FROM u JOIN u q ON q.id % 100 = 0 AND q.id <> u.id)) WHERE rnk <= 10)"""


def _embedding_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), "label")
    return retrieval.dense_search(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 10, without_self=True), q


@query(f"WITH {DENSE} SELECT qid, id, score, rnk::INT AS rnk FROM top")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _embedding_hits(spark, d)[0]


@query(f"""WITH {DENSE}, gold AS (SELECT q.vec_id AS qid, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0),
asked AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 100 = 0), {scored_sql("top", "")} SELECT * FROM scored""")
def dense_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    top, q = _embedding_hits(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    g = q.select("qid", "label").join(e, "label").filter("qid <> id").select("qid", "id")
    return metrics.per_question(top, g, q.select("qid"))


@query(f"""WITH u AS {UNIT.format(id="id", vec="vec", t="vectors")}
SELECT qid, id, score, rnk::INT AS rnk FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM (SELECT q.id AS qid, u.id, round(list_dot_product(q.u, u.u), 6) AS score FROM u JOIN u q ON q.id % 100 = 0 AND q.id <> u.id)) WHERE rnk <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vectors").select("id", "vec").distinct()
    return retrieval.dense_search(v.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), v, 5, without_self=True)


# ---- words, idf and overlap


@query(f"WITH {CH} SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM (SELECT DISTINCT chunk_id, text FROM ch))::DOUBLE / (1 + count(*))), 9) AS idf FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM (SELECT DISTINCT chunk_id, text FROM ch)) GROUP BY term")
def corpus_df_idf(spark: SparkSession, d: str) -> DataFrame:
    return labels.idf(texts(spark, d))


FIRST_GOLD = "fg AS (SELECT qid AS pid, question, c.text AS gold_text FROM qs LEFT JOIN (SELECT DISTINCT chunk_id, text FROM ch) c ON c.chunk_id = gold_chunk_ids[1])"
IDF = f"idf AS (SELECT term, round(ln((SELECT count(*) FROM (SELECT DISTINCT chunk_id, text FROM ch))::DOUBLE / (1 + count(*))), 9) AS idf FROM (SELECT unnest(list_distinct({TOKENS.format('text')})) AS term FROM (SELECT DISTINCT chunk_id, text FROM ch)) GROUP BY term)"
IDF_OVERLAP = f"""{QS}, {CH}, {FIRST_GOLD}, {IDF}, t AS (SELECT pid, unnest(list_distinct({TOKENS.format('question')})) AS term, {TOKENS.format("coalesce(gold_text, '')")} AS g FROM fg),
ov AS (SELECT fg.pid, round(coalesce(CASE WHEN a > 0 THEN b / a ELSE 0 END, 0), 6) AS overlap FROM fg LEFT JOIN (SELECT pid, sum(coalesce(idf, 0)) AS a, sum(CASE WHEN list_contains(g, t.term) THEN coalesce(idf, 0) ELSE 0 END) AS b FROM t LEFT JOIN idf ON t.term = idf.term GROUP BY pid) x ON fg.pid = x.pid)"""


@query(f"WITH {IDF_OVERLAP} SELECT * FROM ov")
def idf_overlap(spark: SparkSession, d: str) -> DataFrame:
    weights = labels.idf(texts(spark, d))
    return labels.idf_overlap(first_gold(spark, d), weights)


GRAMS = "CASE WHEN len({0}) >= 4 THEN list_transform(range(1, len({0}) - 2), lambda i: array_to_string(list_slice({0}, i, i + 3), ' ')) ELSE [] END"
REASONS = f"""{IDF_OVERLAP}, g AS (SELECT pid, {TOKENS.format('question')} AS q, {TOKENS.format("coalesce(gold_text, '')")} AS g FROM fg),
r AS (SELECT g.pid, overlap, CASE WHEN len(q) < 4 THEN 'too short' WHEN list_has_any({GRAMS.format('q')}, {GRAMS.format('g')}) THEN 'shared 4-gram' WHEN overlap > 0.725 THEN format('idf overlap {{:.2f}}', overlap) END AS reason FROM g JOIN ov ON g.pid = ov.pid)"""


def _screened(spark: SparkSession, d: str) -> DataFrame:
    weights = labels.idf(texts(spark, d))
    return labels.screened(first_gold(spark, d), weights)


@query(f"WITH {REASONS} SELECT * FROM r")
def contamination_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d)


@query(f"WITH {REASONS} SELECT split_part(reason, ' ', 1) AS reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL")
def rejection_histogram(spark: SparkSession, d: str) -> DataFrame:
    return labels.rejections(_screened(spark, d))


LEXICAL = f"""{QS}, {CH}, {GOLD}, lx AS (SELECT qid, round(CASE WHEN len(q) > 0 THEN len(list_filter(q, lambda w: list_contains(g, w)))::DOUBLE / len(q) ELSE 0 END, 6) AS overlap FROM (
  SELECT qs.qid, any_value({OVERLAP.format('question')}) AS q, flatten(list({OVERLAP.format("coalesce(text, '')")})) AS g FROM qs LEFT JOIN gold ON qs.qid = gold.qid LEFT JOIN (SELECT DISTINCT chunk_id, text FROM ch) c ON c.chunk_id = gold.id GROUP BY qs.qid))"""


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    c = texts(spark, d).toDF("id", "gold_text")
    pairs = questions(spark, d).join(gold(spark, d), "qid", "left").join(c, "id", "left").select("qid", "question", "gold_text")
    return labels.lexical_overlap(pairs)


@query(f"WITH {LEXICAL} SELECT * FROM lx")
def query_gold_lexical_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


@query(f"WITH {LEXICAL} SELECT split, count(*) AS n, round(avg(overlap), 6) AS overlap FROM lx JOIN (SELECT DISTINCT qid, split FROM qs) s ON lx.qid = s.qid GROUP BY split")
def split_overlap_control(spark: SparkSession, d: str) -> DataFrame:
    s = questions(spark, d).select("qid", "split").distinct()
    return _lexical(spark, d).join(s, "qid").groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("overlap"))


# ---- sparse search

BM25 = f"""{CH}, {QS}, corpus AS (SELECT DISTINCT chunk_id AS id, coalesce(breadcrumb || chr(10) || chr(10) || text, text) AS text FROM ch), tk AS (SELECT id, coalesce({INDEX_TOKENS.replace('{0}', 'text')}, []) AS t FROM corpus),
docs AS (SELECT id, len(t) AS dl FROM tk), post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tk) GROUP BY ALL), terms AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({INDEX_TOKENS.replace('{0}', 'question')}) AS term FROM qs) GROUP BY ALL),
bm AS (SELECT qid, id, round(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN docs USING (id) JOIN (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs) ON true GROUP BY ALL),
bmtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rnk FROM bm WHERE score > 0) WHERE rnk <= 10)"""


@query(f"WITH {BM25} SELECT term, df FROM terms")
def bm25_terms(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.postings(corpus(spark, d))[2]


@query(f"WITH {BM25} SELECT qid, id, score, rnk::INT AS rnk FROM bmtop")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    post, docs, _ = retrieval.postings(corpus(spark, d))
    post, docs = staged(post), staged(docs)  # what an index keeps on disk
    terms = post.groupBy("term").agg(F.count("*").alias("df"))
    return retrieval.bm25_search(questions(spark, d), post, docs, terms, 10)


@query(f"WITH {BM25}, {GOLD}, asked AS (SELECT DISTINCT qid FROM qs), {scored_sql('bmtop', '')} SELECT * FROM scored")
def bm25_eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.per_question(bm25_topk(spark, d), gold(spark, d), questions(spark, d).select("qid"))


# ---- fusion


@query(f"WITH {LISTS}, {RANKED} SELECT qid, id, score, dense_rank, sparse_rank, rnk::INT AS rnk FROM ranked WHERE rnk <= 10")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return plans.ranked(lists(spark, d)).filter("rnk <= 10")


@query(f"WITH {LISTS} SELECT qid, id, round(1.0::DOUBLE / (60 + sparse_rank), 9) AS score, sparse_rank, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sparse_rank, id) AS rnk FROM h WHERE sparse_rank IS NOT NULL) WHERE rnk <= 10")
def single_retriever_passthrough(spark: SparkSession, d: str) -> DataFrame:
    return plans.ranked(lists(spark, d), dense=False).filter("rnk <= 10").select("qid", "id", "score", "sparse_rank", "rnk")


@query(f"WITH {LISTS}, {MAPS} SELECT * FROM m")
def minmax_scores(spark: SparkSession, d: str) -> DataFrame:
    return maps(lists(spark, d))


SWEEP = f"""{LISTS}, {MAPS}, {GOLD}, {QS}, al AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS alpha),
top AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY sc DESC, id) AS rnk FROM (SELECT alpha, qid, id, round(alpha * nd + (1 - alpha) * ns, 9) AS sc FROM m JOIN al ON true)),
asked AS (SELECT DISTINCT alpha, qid FROM qs JOIN al ON true), {scored_sql("top", "alpha")},
curve AS (SELECT split, alpha, count(*) AS n, round(avg(ndcg), 6) AS ndcg FROM scored JOIN (SELECT DISTINCT qid, split FROM qs) s ON scored.qid = s.qid GROUP BY split, alpha)"""


@query(f"WITH {SWEEP} SELECT * FROM curve")
def convex_sweep(spark: SparkSession, d: str) -> DataFrame:
    return plans.sweep(maps(lists(spark, d)), gold(spark, d), questions(spark, d))


@query(f"WITH {SWEEP} SELECT split, alpha, ndcg FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY ndcg DESC, alpha) AS k FROM curve) WHERE k = 1")
def best_alpha(spark: SparkSession, d: str) -> DataFrame:
    return plans.best_alpha(convex_sweep(spark, d))


ALPHA = "CASE WHEN sv = 0 AND sb = 0 THEN 0.5 WHEN sv = 5 AND sb <> 5 THEN 1.0 WHEN sb = 5 AND sv <> 5 THEN 0.0 ELSE round_even(sv::DOUBLE / (sv + sb), 1) END::DOUBLE"


@query(f"SELECT sv::INT AS sv, sb::INT AS sb, {ALPHA} AS alpha FROM range(6) a(sv) JOIN range(6) b(sb) ON true")
def dat_alpha_grid(spark: SparkSession, d: str) -> DataFrame:
    g = spark.range(36).select((F.col("id") / 6).cast("int").alias("sv"), (F.col("id") % 6).cast("int").alias("sb"))
    return g.withColumn("alpha", retrieval.dat_alpha(F.col("sv"), F.col("sb")))


DAT = f"""{LISTS}, {MAPS}, {GOLD}, f AS (SELECT qid, (SELECT NULL) AS z, arg_min(id, (dense_rank, id)) FILTER (dense_rank IS NOT NULL) AS d1, arg_min(id, (sparse_rank, id)) FILTER (sparse_rank IS NOT NULL) AS s1 FROM h GROUP BY qid),
gr AS (SELECT f.qid, d1 IS DISTINCT FROM s1 AS disagree, a.logit AS la, b.logit AS lb FROM f LEFT JOIN h a ON a.qid = f.qid AND a.id = d1 LEFT JOIN h b ON b.qid = f.qid AND b.id = s1),
gd AS (SELECT qid, disagree, CASE WHEN la IS NULL OR lb IS NULL THEN -1 ELSE greatest(0, least(5, trunc(la / 3 + 3)::INT)) END AS sv, CASE WHEN la IS NULL OR lb IS NULL THEN -1 ELSE greatest(0, least(5, trunc(lb / 3 + 3)::INT)) END AS sb FROM gr),
al AS (SELECT *, CASE WHEN sv < 0 THEN 0.8 ELSE {ALPHA} END::DOUBLE AS alpha FROM gd),
ks AS (SELECT qid, 'dat' AS kind, alpha AS w FROM al UNION ALL SELECT qid, 'fixed', 0.8 FROM al UNION ALL SELECT qid, 'dense', 1.0 FROM al),
top AS (SELECT *, row_number() OVER (PARTITION BY kind, qid ORDER BY sc DESC, id) AS rnk FROM (SELECT kind, m.qid, id, round(w * nd + (1 - w) * ns, 9) AS sc FROM m JOIN ks ON m.qid = ks.qid)),
asked AS (SELECT kind, qid FROM ks), {scored_sql("top", "kind")},
dr AS (SELECT al.qid, disagree, sv::INT AS sv, sb::INT AS sb, alpha, max(ndcg) FILTER (kind = 'dat') AS dat, max(ndcg) FILTER (kind = 'fixed') AS fixed, max(ndcg) FILTER (kind = 'dense') AS dense FROM al JOIN scored ON al.qid = scored.qid GROUP BY ALL)"""


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    """The logits of the lists' first hits stand in for grades a model would give."""
    h = lists(spark, d)
    l = h.select("qid", "id", "logit")
    f = plans.first_hits(h)
    f = f.join(l.withColumnsRenamed({"id": "d1", "logit": "la"}), ["qid", "d1"], "left").join(l.withColumnsRenamed({"id": "s1", "logit": "lb"}), ["qid", "s1"], "left")
    g = lambda c: retrieval.grade((F.col(c) / 3 + 3).cast("string"))
    return plans.weighted(maps(h), f.select("qid", "disagree", g("la").alias("sv"), g("lb").alias("sb")), gold(spark, d))


@query(f"WITH {DAT} SELECT * FROM dr")
def dat_questions(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d)


@query(f"""WITH {DAT} SELECT count(*) AS n, count(*) FILTER (disagree) AS n_disagree, {", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in ("dat", "fixed", "dense"))},
{", ".join(f"round(coalesce(avg({c}) FILTER (disagree), 0), 6) AS {c}_disagree" for c in ("dat", "fixed", "dense"))}, count(*) FILTER (dat > fixed) AS wins, count(*) FILTER (dat < fixed) AS losses FROM dr""")
def dat_report(spark: SparkSession, d: str) -> DataFrame:
    return plans.weight_report(_weighted(spark, d))


# ---- reranking, ablation, comparisons


@query(f"""WITH {LISTS}, {CH}, {RANKED}, r AS (SELECT ranked.qid, ranked.id, h.logit, row_number() OVER (PARTITION BY ranked.qid ORDER BY h.logit DESC NULLS LAST, ranked.rnk, ranked.id) AS rnk FROM ranked JOIN h ON h.qid = ranked.qid AND h.id = ranked.id WHERE ranked.rnk <= 50)
SELECT qid, id, logit, rnk::INT AS rnk, concat_ws(' ', ticker, form, left(report_date, 4)) || CASE WHEN item IS NULL THEN '' ELSE ', Item ' || item END AS citation, md5(breadcrumb || chr(10) || text) AS passage FROM r JOIN ch ON ch.chunk_id = r.id WHERE rnk <= 8""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    h = lists(spark, d)
    top = retrieval.hydrate(retrieval.rerank(plans.ranked(h), logits(h), 8), chunks(spark, d))
    return retrieval.passages(top).select("qid", "id", "logit", "rnk", text.citation("ticker", "form", "report_date", "item").alias("citation"), F.md5("passage").alias("passage"))


def _ablation(spark: SparkSession, d: str) -> DataFrame:
    h = lists(spark, d)
    return plans.ablation(h, logits(h), gold(spark, d), questions(spark, d))


@query(f"WITH {ABLATION} SELECT config, coalesce(split, 'all') AS split, count(*) AS n, {MEANS} FROM final GROUP BY GROUPING SETS ((config, split), (config))")
def ablation_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mean_metrics(_ablation(spark, d), ("config", "split"), also_all=True)


COMPARED = (("Dense only", "Hybrid (RRF)"), ("Dense + rerank", "Dense only"), ("Hybrid + rerank", "Dense + rerank"))


@query(
    f"""WITH {ABLATION}, two AS (SELECT a.qid, p.a AS first, p.b AS second, a.ndcg AS x, b.ndcg AS y FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in COMPARED)}) p(a, b) JOIN final a ON a.config = p.a JOIN final b ON b.config = p.b AND b.qid = a.qid),
wl AS (SELECT first, second, count(*) FILTER (x > y) AS wins, count(*) FILTER (x < y) AS losses, count(*) FILTER (x = y) AS ties FROM two GROUP BY ALL)
SELECT *, round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1.0) - lgamma(k + 1.0) - lgamma(wins + losses - k + 1.0) - (wins + losses) * ln(2.0))))), 6) AS p FROM wl"""
)
def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    scored = staged(_ablation(spark, d))
    rows = [metrics.paired(scored, "config", a, b).select(F.lit(a).alias("first"), F.lit(b).alias("second"), "*") for a, b in COMPARED]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# ---- facts and filings

FACT_COLUMNS = ["ticker", "concept", "label", "val", "unit", "fy", "fp", "period_start", "period_end", "form", "accession", "filed"]
DATE = "try_strptime(substr({0}, 1, 4) || '-' || substr({0}, 6, 2) || '-' || substr({0}, 9, 2), '%Y-%m-%d')::DATE"
YEAR = "CASE WHEN length({0}) >= 4 AND regexp_full_match(left({0}, 4), '[0-9]{{4}}') THEN left({0}, 4)::INT END"
ANNUAL = f"CASE WHEN coalesce({{0}}, '') = '' THEN true ELSE coalesce({DATE.format('{1}')} - {DATE.format('{0}')} >= 300, false) END"
FT = f"""ft AS (SELECT DISTINCT {", ".join(FACT_COLUMNS)}, {YEAR.format('period_end')} AS fiscal_year, {ANNUAL.format('period_start', 'period_end')} AS annual FROM facts)"""


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").select(*FACT_COLUMNS).distinct()


def facts_json(spark: SparkSession, d: str) -> DataFrame:
    """The facts nested as a source publishes them: ``(ticker, doc, json)``, one document a ticker and filing."""
    f = facts_of(spark, d).withColumn("doc", F.col("accession"))
    e = F.struct("val", "fy", "fp", F.col("period_start").alias("start"), F.col("period_end").alias("end"), "form", F.col("accession").alias("accn"), "filed")
    u = f.groupBy("ticker", "doc", "concept", "unit").agg(F.max("label").alias("label"), F.collect_list(e).alias("e"))
    c = u.groupBy("ticker", "doc", "concept").agg(F.max("label").alias("label"), F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units"))
    a = c.groupBy("ticker", "doc").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("label", "units").alias("v")))).alias("m"))
    return a.select("ticker", "doc", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "m").alias("facts"))).alias("json"))


@query(f"""WITH {FT} SELECT ticker, concept, coalesce(nullif(max(label) OVER (PARTITION BY ticker, accession, concept), ''), concept) AS label, unit, val AS value, fy, fiscal_year, annual, fp, period_start AS start, period_end AS "end", form, replace(accession, '-', '') AS accession, filed
FROM ft QUALIFY form IN ('10-K', '10-Q')""")
def fact_flatten(spark: SparkSession, d: str) -> DataFrame:
    return flatten.flatten_facts(facts_json(spark, d)).drop("doc", "pos")


@query(f"""WITH {FT}, fl AS (SELECT DISTINCT accession, report_date FROM filings)
SELECT ft.ticker, concept, ft.accession, period_start, period_end, val, unit, fiscal_year, left(report_date, 4)::INT - fiscal_year AS years_back FROM ft JOIN fl ON ft.accession = fl.accession
WHERE form = '10-K' AND annual AND val IS NOT NULL AND NOT isnan(val) AND fiscal_year > 0 AND try_cast(left(report_date, 4) AS INT) - fiscal_year BETWEEN 0 AND 2""")
def fact_fiscal_filter(spark: SparkSession, d: str) -> DataFrame:
    f = eval_sets.eligible_facts(facts_of(spark, d))
    fl = table(spark, d, "filings").select("accession", "report_date").distinct()
    rows = f.join(fl, "accession").filter(facts.in_window("report_date", "fiscal_year"))
    back = F.left("report_date", F.lit(4)).try_cast("int") - F.col("fiscal_year")
    return rows.select("ticker", "concept", "accession", "period_start", "period_end", "val", "unit", "fiscal_year", back.alias("years_back"))


@query(f"SELECT * EXCLUDE (rn) FROM (WITH {FT} SELECT ticker, concept, fiscal_year, val, accession, row_number() OVER (PARTITION BY ticker, concept, fiscal_year ORDER BY filed NULLS FIRST, accession NULLS FIRST, val NULLS FIRST, period_start NULLS FIRST, period_end NULLS FIRST, unit NULLS FIRST, fp NULLS FIRST, label NULLS FIRST) AS rn FROM ft WHERE fiscal_year IS NOT NULL) WHERE rn = 1")
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = facts_of(spark, d).withColumn("fiscal_year", facts.fiscal_year("period_end")).filter("fiscal_year IS NOT NULL")
    order = [F.col(c).asc_nulls_first() for c in ("filed", "accession", "val", "period_start", "period_end", "unit", "fp", "label")]
    return sampling.first_wins(f, ["ticker", "concept", "fiscal_year"], order).select("ticker", "concept", "fiscal_year", "val", "accession")


def _variants(v: str) -> str:
    def at(scale: int) -> str:
        x = f"({v} / {scale}.0::DOUBLE)"
        whole = f"abs({x}) >= 1 AND abs({x} - round_even({x}, 0)) < 1e-9 AND abs({x}) < 9e21"
        n = f"round_even({x}, 0)::HUGEINT"
        return f"CASE WHEN {whole} THEN format('{{:,}}', {n}) END, CASE WHEN {whole} AND abs({n}) >= 1000 THEN {n}::VARCHAR END"

    return f"list_filter(list_distinct([{at(1)}, {at(1000)}, {at(1000000)}, CASE WHEN abs({v}) < 1000 THEN format('{{:,.2f}}', {v}) END]), lambda s: s IS NOT NULL AND length(replace(s, ',', '')) >= 3)"


@query(f"WITH v AS (SELECT DISTINCT val FROM facts WHERE val IS NOT NULL AND NOT isnan(val)) SELECT val, array_to_string(list_sort({_variants('val')}), ' ') AS formats FROM v")
def value_formats(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "facts").filter("val IS NOT NULL AND NOT isnan(val)").select("val").distinct()
    return v.select("val", F.array_join(F.array_sort(facts.value_formats("val")), " ").alias("formats"))


MATCH = f"""{FT}, {CH}, v AS (SELECT DISTINCT ticker, val, fiscal_year, {_variants('val')} AS vs FROM ft WHERE val IS NOT NULL AND NOT isnan(val) AND fiscal_year IS NOT NULL AND form = '10-K' AND annual),
hit AS (SELECT DISTINCT v.ticker, val, fiscal_year, chunk_id FROM v JOIN ch ON v.ticker = ch.ticker AND try_cast(left(report_date, 4) AS INT) - fiscal_year BETWEEN 0 AND 2 AND len(list_filter(vs, lambda s: contains(ch.text, s))) > 0)"""


@query(f"WITH {MATCH} SELECT * FROM hit QUALIFY count(*) OVER (PARTITION BY ticker, val, fiscal_year) <= 8")
def gold_containment(spark: SparkSession, d: str) -> DataFrame:
    f = eval_sets.eligible_facts(facts_of(spark, d)).select("ticker", F.col("val").alias("value"), "fiscal_year").distinct()
    f = f.withColumn("fact_id", F.struct("ticker", "value", "fiscal_year"))
    m = labels.value_matches(f, chunks(spark, d, "chunk_id", "ticker", "report_date", "text"), most=8)
    return m.select("fact_id.ticker", F.col("fact_id.value").alias("val"), "fact_id.fiscal_year", "chunk_id")


NUMERIC = f"""{MATCH}, ok AS (SELECT ticker, val, fiscal_year, list_sort(list(chunk_id)) AS g FROM hit GROUP BY ALL HAVING count(*) <= 8),
w AS (SELECT ft.*, g, row_number() OVER (PARTITION BY ft.ticker, concept, ft.fiscal_year ORDER BY filed NULLS FIRST, accession NULLS FIRST, ft.val NULLS FIRST, unit NULLS FIRST, label NULLS FIRST) AS rn FROM ft JOIN ok ON ft.ticker = ok.ticker AND ft.val = ok.val AND ft.fiscal_year = ok.fiscal_year WHERE form = '10-K' AND annual),
q AS (SELECT ticker || '-' || concept || '-' || fiscal_year AS qid, * FROM w WHERE rn = 1)"""


@query(f"""WITH {NUMERIC} SELECT qid, 'What was ' || ticker || '''s ' || coalesce(nullif(label, ''), concept) || ' in fiscal ' || fiscal_year || '?' AS question, ticker, fiscal_year, val AS expected_value, unit, array_to_string(g, ' ') AS gold
FROM q QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY md5('0|' || qid), qid) <= 40""")
def numeric_eval_set(spark: SparkSession, d: str) -> DataFrame:
    q = eval_sets.numeric_questions(eval_sets.eligible_facts(facts_of(spark, d)), chunks(spark, d, "chunk_id", "ticker", "report_date", "text"), ["filed", "accession", "val", "unit", "label"])
    return q.select("qid", "question", "ticker", "fiscal_year", "expected_value", "unit", F.array_join("gold_chunk_ids", " ").alias("gold"))


FL = "fl AS (SELECT DISTINCT cik, ticker, company, form, accession, filing_date, report_date, primary_doc FROM filings)"


def filings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").select("cik", "ticker", "company", "form", "accession", "filing_date", "report_date", "primary_doc").distinct()


@query(f"""WITH {FL}, x AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession DESC) AS pos FROM fl WHERE form IN ('10-K', '10-Q')), y AS (SELECT ticker, cik, company, form, replace(accession, '-', '') AS accession, filing_date, coalesce(nullif(report_date, ''), filing_date) AS report_date, primary_doc, pos::INT AS pos FROM x WHERE pos <= 8)
SELECT *, ticker || '_' || replace(form, '-', '') || '_' || report_date AS slug, 'https://filings.example/' || ltrim(cik, '0') || '/' || accession || '/' || primary_doc AS url FROM y""")
def latest_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings nested as parallel arrays, newest first, and listed from those."""
    f = filings(spark, d)
    row = F.struct("filing_date", "accession", "form", "report_date", "primary_doc")
    g = f.groupBy("ticker", "cik", "company").agg(F.sort_array(F.collect_list(row), asc=False).alias("r"))
    recent = F.struct(F.col("r.form").alias("form"), F.col("r.accession").alias("accessionNumber"), F.col("r.filing_date").alias("filingDate"), F.col("r.report_date").alias("reportDate"), F.col("r.primary_doc").alias("primaryDocument"))
    docs = g.select("ticker", "cik", "company", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")), {"ignoreNullFields": "false"}).alias("json"))
    return flatten.with_names(flatten.list_filings(docs))


@query(f"WITH {FL} SELECT DISTINCT ticker, lpad(ltrim(cik, '0'), 10, '0') AS cik, company FROM fl")
def ticker_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tickers asked for in lower case, found in a ticker file of the same companies."""
    f = filings(spark, d).select("ticker", "cik", "company").distinct()
    entry = F.struct("ticker", F.col("cik").cast("bigint").alias("cik_str"), F.col("company").alias("title"))
    doc = f.select(F.to_json(F.create_map(F.lit("0"), entry)).alias("json"))
    return flatten.resolve(f.select(F.lower("ticker").alias("ticker")).distinct(), flatten.ticker_map(doc))


# ---- samples


@query(f"WITH {QS}, t AS (SELECT DISTINCT qid, ticker FROM qs) SELECT qid, ticker, row_number() OVER (PARTITION BY ticker ORDER BY qid)::INT AS turn FROM t")
def round_robin_interleave(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its turn; the order is by turn, then ticker."""
    t = sampling.interleave(questions(spark, d).select("qid", "ticker").distinct(), "ticker", ["qid"])
    return t.orderBy("turn", F.col("ticker").asc_nulls_first())


@query(f"WITH {CH}, t AS (SELECT DISTINCT chunk_id, ticker FROM ch) SELECT chunk_id, ticker, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY md5('7|' || chunk_id), chunk_id) AS place FROM t) WHERE place <= 5")
def quota_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sampling.quota(chunks(spark, d, "chunk_id", "ticker"), "ticker", 5, [sampling.seeded(7, "chunk_id"), "chunk_id"])


@query(f"WITH {QS} SELECT coalesce(ticker, '?') AS ticker, count(DISTINCT qid) AS n, sum(len(gold_chunk_ids))::BIGINT AS gold, avg(len(gold_chunk_ids)) AS gold_each FROM qs GROUP BY ALL")
def question_counts(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).withColumn("k", F.size("gold_chunk_ids"))
    return q.groupBy(F.coalesce("ticker", F.lit("?")).alias("ticker")).agg(F.countDistinct("qid").alias("n"), F.sum("k").alias("gold"), F.avg("k").alias("gold_each"))


@query("SELECT DISTINCT qid, coalesce(try_cast(nullif(regexp_extract(fiscal_year, '(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1), '') AS INT), try_cast(nullif(regexp_extract(fiscal_year, '(?i)fy\\s*''?([0-9]{2})(?:[^0-9]|$)', 1), '') AS INT) + 2000) AS year FROM eval_narrative")
def question_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_narrative").select("qid", question_year("fiscal_year").alias("year")).distinct()


# ---- near duplicates

SETS = f"""{CH}, s AS (SELECT DISTINCT chunk_id AS id, ticker AS g, list_sort(list_distinct({TOKENS.format('text')})) AS w FROM ch WHERE ticker IS NOT NULL AND text IS NOT NULL), s1 AS (SELECT * FROM s WHERE len(w) > 0),
one AS (SELECT g, w, min(id) AS id FROM s1 GROUP BY g, w), t AS (SELECT g, id, len(w) AS n, unnest(w) AS x FROM one)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by ticker, rows repeated as they are: similar_sets counts them once."""
    return table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("ticker").alias("group"), "text")


# All records meet all others of their ticker: what is near is counted on the records themselves.
SIMILAR = "near AS (SELECT a.g, a.id AS a, b.id AS b FROM y a JOIN y b ON a.g = b.g AND a.x = b.x AND a.id <> b.id GROUP BY a.g, a.id, b.id, a.n, b.n HAVING count(*) >= 0.55 * (a.n + b.n - count(*)))"


@query(f"""WITH {SETS}, y AS (SELECT g, id, len(w) AS n, unnest(w) AS x FROM s1), {SIMILAR}
SELECT s1.g AS "group", s1.id, one.id AS cls, coalesce(k, 0) AS n_near FROM s1 JOIN one ON one.g = s1.g AND one.w = s1.w LEFT JOIN (SELECT g, a, count(*) AS k FROM near GROUP BY g, a) z ON z.g = s1.g AND z.a = s1.id""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk: its class of chunks with the same words, and how many others of its ticker are near it."""
    return labels.near_counts(*map(staged, labels.similar_sets(records(spark, d))))


@query(f"""WITH {SETS} SELECT * FROM (SELECT a.g AS "group", a.id AS a, b.id AS b, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS similarity FROM t a JOIN t b ON a.g = b.g AND a.x = b.x AND a.id < b.id GROUP BY a.g, a.id, b.id, a.n, b.n) WHERE similarity >= 0.55""")
def near_duplicate_links(spark: SparkSession, d: str) -> DataFrame:
    """The links between classes."""
    return labels.similar_sets(records(spark, d))[0]


# ---- documents


@query(f"WITH {CH} SELECT DISTINCT chunk_id, concat_ws(' > ', concat_ws(' ', ticker, form, left(report_date, 4)), 'Item ' || item || coalesce('. ' || item_title, ''), CASE WHEN kind = 'table' THEN '[financial table]' END) AS breadcrumb, md5(breadcrumb || chr(10) || chr(10) || text) AS embed_text FROM ch")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    crumb = text.breadcrumb("ticker", "form", "report_date", "item", "item_title", "kind")
    return chunks(spark, d).select("chunk_id", crumb.alias("crumb"), F.md5(text.embed_text("breadcrumb", "text")).alias("embed_text")).withColumnRenamed("crumb", "breadcrumb").distinct()


ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as a page of HTML: a paragraph a line, or a table a row a line with an empty column put in, between parts that are to be dropped."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = F.split("text", "\n")
    para = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<p>"), esc(r), F.lit("</p>\n"))), "")
    cells = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr><td>&nbsp;</td>"), F.array_join(F.transform(F.split(r, r"\|"), lambda c: F.concat(F.lit("<td> "), esc(c), F.lit("</td>"))), ""), F.lit("</tr>"))), "")
    body = F.when(F.col("kind") == "table", F.concat(F.lit("<table>"), cells, F.lit("</table>"))).otherwise(para)
    html = F.concat(F.lit("<html><head><title></title><style>p {}</style></head><body><script>if (1 < 2) {}</script>\n"), body, F.lit("<ix:header>hidden</ix:header></body></html>"))
    return chunks(spark, d, "chunk_id", "kind", "text").filter("text IS NOT NULL AND kind IS NOT NULL").select("chunk_id", html.alias("html"))


CLEAN = f"list_filter(list_transform(string_split_regex({{0}}, '{BREAK}'), lambda x: trim(regexp_replace(x, '{SPACE}', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_full_match(x, '(?i)(table of contents|index|page\\s+[0-9]+|[0-9]+|see accompanying notes.*|the accompanying notes.*)'))"
PAGE = f"""{CH}, p AS (SELECT DISTINCT chunk_id, kind, text FROM ch WHERE text IS NOT NULL AND kind IS NOT NULL),
tx AS (SELECT chunk_id, kind, array_to_string({CLEAN.replace('{0}', 'text')}, chr(10)) AS content FROM p WHERE kind <> 'table')"""


@query(f"WITH {PAGE} SELECT chunk_id, 0 AS pos, 'text' AS kind, content FROM tx WHERE trim(content) <> ''")
def html_text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.blocks(pages(spark, d)).filter("kind = 'text'")


TABLE = f"""tb AS (SELECT chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda r: list_transform(string_split(r, '|'), lambda c: trim(regexp_replace(c, '{SPACE}', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS r FROM p WHERE kind = 'table'),
keep AS (SELECT chunk_id, r, list_filter(range(1, coalesce(list_max(list_transform(r, lambda x: len(x))), 0) + 1), lambda i: len(list_filter(r, lambda x: coalesce(x[i], '') <> '')) > 0) AS k FROM tb)"""


@query(f"WITH {PAGE}, {TABLE} SELECT chunk_id, 0 AS pos, 'table' AS kind, array_to_string(list_filter(list_transform(r, lambda x: array_to_string(list_transform(k, lambda i: coalesce(x[i], '')), ' | ')), lambda x: trim(replace(x, '|', '')) <> ''), chr(10)) AS content FROM keep WHERE len(r) > 0")
def html_table_blocks(spark: SparkSession, d: str) -> DataFrame:
    return html.blocks(pages(spark, d)).filter("kind = 'table'")


def filing_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each filing's chunks as one page, an item heading at the head of each."""
    c = table(spark, d, "chunks").select("doc_id", "chunk_id", "ticker", "company", "form", "report_date", "accession", "item", "item_title").distinct().join(pages(spark, d), "chunk_id")
    head = F.when(F.col("item").isNotNull(), F.concat(F.lit("<h2>Item "), "item", F.lit(". "), F.coalesce("item_title", F.lit("")), F.lit("</h2>"))).otherwise("")
    c = c.withColumn("part", F.struct("chunk_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), head)).alias("h")))
    keys = ["doc_id", "ticker", "company", "form", "report_date", "accession"]
    g = c.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("p"))
    return g.select(F.col("doc_id").alias("slug"), *keys[1:], F.concat(F.lit("https://filings.example/"), "accession").alias("url"), F.array_join("p.h", "\n").alias("html"))


@query()
def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_filings(filing_pages(spark, d))


@query("""WITH c AS (SELECT DISTINCT doc_id, chunk_id, item, item_title, text FROM chunks WHERE text IS NOT NULL)
SELECT doc_id, chunk_id, last_value(item IGNORE NULLS) OVER w AS item, last_value(CASE WHEN item IS NULL THEN NULL ELSE coalesce(item_title, '') END IGNORE NULLS) OVER w AS item_title FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def item_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Headings parsed from lines written out of each chunk's item, carried to the chunks that follow."""
    c = table(spark, d, "chunks").filter("text IS NOT NULL").select("doc_id", "chunk_id", "item", "item_title", "text").distinct()
    line = F.when(F.col("item").isNotNull(), F.concat(F.lit("ITEM "), F.lower("item"), F.lit(" - "), F.coalesce("item_title", F.lit("")), F.lit(".")))
    item = text.heading_item("line")
    rows = c.withColumn("line", line).withColumn("heading", F.when(item.isNotNull(), F.struct(item.alias("item"), F.coalesce(text.heading_title("line"), F.lit("")).alias("title"))))
    rows = chunking.carry_forward(rows, ["doc_id"], ["chunk_id", "text"], "heading")
    return rows.select("doc_id", "chunk_id", F.col("heading.item").alias("item"), F.col("heading.title").alias("item_title"))


@query(f"""WITH ln AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT doc_id, string_split_regex(text, '{BREAK}') AS l FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, list_filter(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) + 2 <= 2400 THEN list_append(acc[:-2], acc[-1] || chr(10) || x[1]) ELSE list_append(acc, CASE WHEN acc[-1] = '' THEN x[1] ELSE right(acc[-1], 200) || chr(10) || x[1] END) END), lambda v: trim(regexp_replace(v, '{SPACE}', '', 'g')) <> '') AS w FROM ln WHERE len(l) > 0)
SELECT doc_id, (i - 1)::INT AS window_no, length(w[i])::INT AS n_chars, md5(w[i]) AS md5 FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)""")
def pack_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text").distinct()
    w = docs.select("doc_id", F.posexplode(chunking.packed(text.lines("text"))).alias("window_no", "window"))
    return w.select("doc_id", "window_no", F.length("window").alias("n_chars"), F.md5("window").alias("md5"))


# ---- whole pipelines, with stand-ins for models


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """An index built from all chunks, and all questions searched: hashed words stand in for embeddings, shared words for a reranker."""
    c = table(spark, d, "chunks").select(*CHUNK)
    seen = once(c.select("chunk_id", "breadcrumb", "text")).select(F.col("chunk_id").alias("id"), F.coalesce(text.embed_text("breadcrumb", "text"), "text").alias("text"))
    index = files.Index.build(c, providers.embedded(seen, providers.HashEmbedder(), "passage"), "hashed words")
    index.postings = staged(index.postings)
    index.terms = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    index = files.Index(**{t: getattr(index, t) if t == "postings" else staged(getattr(index, t)) for t in files.Index.TABLES})
    q = questions(spark, d).select("qid", "question").distinct()
    qvecs = providers.embedded(q.toDF("id", "text"), providers.HashEmbedder(), "query").toDF("qid", "qvec")
    first = staged(plans.search(q, index, qvecs, k=50).select("qid", "id", "rnk", "score", "dense_rank", "sparse_rank", "breadcrumb", "text"))
    asked = retrieval.passages(first).join(q, "qid").select("qid", "question", "id", "passage")
    top = retrieval.rerank(first.select("qid", "id", "rnk", "dense_rank", "sparse_rank"), providers.reranked(asked, providers.OverlapReranker()), 8)
    return top.select("qid", "id", "rnk", "first_rnk", "dense_rank", "sparse_rank", F.round("logit", 6).alias("logit"))


ITEMS = ["1", "1A", "1C", "3", "7", "7A"]


@query(f"""WITH {QS}, {CH}, {IDF}, p AS (SELECT * FROM ch WHERE item IN ({", ".join(f"'{i}'" for i in ITEMS)}) AND kind = 'text' AND length(text) >= 900),
an AS (SELECT gold_chunk_ids[1] AS id, min(question) AS question FROM qs GROUP BY 1), j AS (SELECT p.*, trim(question) AS question FROM p JOIN an ON an.id = p.chunk_id WHERE trim(question) <> ''),
tk AS (SELECT DISTINCT chunk_id, {TOKENS.format('question')} AS q, {TOKENS.format('text')} AS g FROM j), tt AS (SELECT chunk_id, g, unnest(list_distinct(q)) AS term FROM tk),
ov AS (SELECT tk.chunk_id, q, g, round(coalesce(CASE WHEN a > 0 THEN b / a ELSE 0 END, 0), 6) AS overlap FROM tk LEFT JOIN (SELECT chunk_id, sum(coalesce(idf, 0)) AS a, sum(CASE WHEN list_contains(g, tt.term) THEN coalesce(idf, 0) ELSE 0 END) AS b FROM tt LEFT JOIN idf ON tt.term = idf.term GROUP BY chunk_id) x ON x.chunk_id = tk.chunk_id),
kept AS (SELECT j.*, overlap FROM j JOIN ov ON j.chunk_id = ov.chunk_id WHERE len(q) >= 4 AND NOT list_has_any({GRAMS.format('q')}, {GRAMS.format('g')}) AND overlap <= 0.725 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY md5('0|' || j.chunk_id), j.chunk_id) <= 5),
s AS (SELECT DISTINCT chunk_id AS id, ticker AS g, list_distinct({TOKENS.format('text')}) AS w FROM p WHERE ticker IS NOT NULL), y AS (SELECT g, id, len(w) AS n, unnest(w) AS x FROM s), {SIMILAR}
SELECT chunk_id || '-narr' AS qid, question, 'topic' AS topic, ticker, item, left(report_date, 4) AS fiscal_year, concat_ws(' ', chunk_id, (SELECT string_agg(b, ' ' ORDER BY b) FROM near WHERE a = chunk_id)) AS gold_chunk_ids, overlap AS idf_overlap, 'narrative' AS split, 'written, screened' AS source FROM kept""")
def narrative_eval_set(spark: SparkSession, d: str) -> DataFrame:
    """Questions about passages, screened, with near duplicates as further gold; the questions there are stand in for a model's answers."""
    p = eval_sets.narrative_passages(table(spark, d, "chunks").select(*CHUNK), ITEMS)
    q = questions(spark, d).select(F.get("gold_chunk_ids", F.lit(0)).alias("id"), "question").groupBy("id").agg(F.min("question").alias("question"))
    answers = q.select("id", F.concat(F.lit("Here: "), F.to_json(F.struct("question", F.lit("topic").alias("topic")))).alias("answer"))
    links, members = map(staged, labels.similar_sets(p.select("chunk_id", "ticker", "text").toDF("id", "group", "text")))
    asked = p.join(small(answers.select(F.col("id").alias("chunk_id"))), "chunk_id", "left_semi").distinct()
    corpus = once(table(spark, d, "chunks").select(F.col("chunk_id").alias("id"), "text"))
    out, _ = eval_sets.narrative_questions(asked, answers, corpus, links, members)
    return out.withColumn("gold_chunk_ids", F.array_join("gold_chunk_ids", " "))


@query(f"""WITH {ABLATION} SELECT (SELECT count(DISTINCT qid) FROM qs) AS n_questions, (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_chunks, config, coalesce(split, 'all') AS split, count(*) AS n, {MEANS} FROM final GROUP BY GROUPING SETS ((config, split), (config))""")
def ablation_result(spark: SparkSession, d: str) -> DataFrame:
    """The ablation as one line of JSON, with where it comes from, and read back from that."""
    n = chunks(spark, d, "chunk_id").count()
    r = plans.ablation_result(staged(_ablation(spark, d)), questions(spark, d), ["eval_narrative"], n, "hits")
    line = r.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("result"))
    back = line.select(F.from_json("result", r.schema).alias("r")).select("r.n_questions", "r.n_chunks", F.explode("r.results").alias("x"))
    return back.select("n_questions", "n_chunks", "x.config", "x.split", "x.n", *(f"x.{m}" for m in metrics.METRICS))


# ---- models' answers and prompts


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE event_id % 5 WHEN 3 THEN 'array' WHEN 4 THEN 'none' ELSE 'object' END AS found FROM (SELECT DISTINCT event_id, props FROM events) WHERE event_id % 5 < 3 UNION ALL SELECT event_id, NULL, CASE event_id % 5 WHEN 3 THEN 'array' ELSE 'none' END FROM (SELECT DISTINCT event_id FROM events) WHERE event_id % 5 >= 3")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    """Properties as a model might answer: bare, fenced, in prose, as a list in prose, and not at all."""
    kind = F.col("event_id") % 5
    said = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).when(kind == 2, F.concat(F.lit("I think "), "props", F.lit(" fits.")))
    said = said.when(kind == 3, F.lit("Either [1, 2] or so.")).otherwise(F.lit("no {idea"))
    e = table(spark, d, "events").select("event_id", "props").distinct().withColumn("j", jsonx.extract_json(said))
    found = F.when(F.col("j").isNull(), "none").when(F.col("j").startswith("["), "array").otherwise("object")
    return e.select("event_id", F.get_json_object("j", "$.k").try_cast("bigint").alias("k"), found.alias("found"))


@query(f"WITH {QS}, m AS (SELECT DISTINCT qid, question, CASE length(question) % 3 WHEN 0 THEN 'nemotron-small' WHEN 1 THEN 'qwen3.5-large' ELSE 'plain' END AS model, CASE length(question) % 3 WHEN 0 THEN 'detailed thinking off' WHEN 1 THEN '/no_think' END AS p, length(question) % 2 = 0 AS sys FROM qs) SELECT qid, (CASE WHEN sys THEN 2 WHEN p IS NULL THEN 1 ELSE 2 END)::INT AS n, CASE WHEN sys OR p IS NOT NULL THEN 'system' ELSE 'user' END AS role, CASE WHEN sys THEN coalesce(p || chr(10), '') || 'Be brief.' ELSE coalesce(p, question) END AS content FROM m")
def chat_prefix(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d).select("qid", "question").distinct()
    n = F.length("question")
    model = F.when(n % 3 == 0, "nemotron-small").when(n % 3 == 1, "qwen3.5-large").otherwise("plain")
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    ask = F.array(msg("user", F.col("question")))
    messages = F.when(n % 2 == 0, F.concat(F.array(msg("system", F.lit("Be brief."))), ask)).otherwise(ask)
    m = q.withColumn("m", chat.with_directive(model, messages))
    first = F.get("m", F.lit(0))
    return m.select("qid", F.size("m").alias("n"), first["role"].alias("role"), first["content"].alias("content"))


@query(f"WITH {QS} SELECT DISTINCT qid, trim(question) AS answer FROM qs WHERE length(question) > 0")
def event_stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions cut into words, streamed as events between others, and put together again."""
    q = questions(spark, d).filter("length(question) > 0").select("qid", "question").distinct()
    delta = lambda w: F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content"), F.lit("hm").alias("reasoning_content")).alias("delta"))).alias("choices")))
    parts = F.transform(F.regexp_extract_all("question", F.lit(r"(?s)\S+\s*|\s+"), F.lit(0)), lambda w: F.concat(F.lit("data: "), delta(w)))
    sent = F.concat(F.array(F.lit(": open"), F.lit("data: {bad")), parts, F.array(F.lit("data: [DONE]")))
    return q.select("qid", jsonx.event_stream_text(F.array_join(sent, "\n")).alias("answer"))


@query(f"""WITH {QS}, {CH}, {FIRST_GOLD} SELECT pid AS id, 'Grade from 0 to 5 how well each passage answers the question.' || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'A: ' || left(coalesce(gold_text, ''), 1200) || chr(10) || chr(10) || 'B: ' || left(coalesce(question, ''), 1200) || chr(10) || chr(10) || 'Answer as JSON: {{"score_a": 0, "score_b": 0}}' AS prompt FROM fg""")
def grader_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = first_gold(spark, d).select(F.col("pid").alias("qid"), "question", F.col("gold_text").alias("text_a"), F.col("question").alias("text_b"))
    return eval_sets.grader_prompts(p)
