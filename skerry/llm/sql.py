"""SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

HITS = """h AS (SELECT qid, chunk_id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score, min(dense_rank) AS dr, min(sparse_rank) AS sr, max(CASE WHEN isnan(rerank_logit) THEN NULL ELSE rerank_logit END) AS lg FROM hits WHERE qid IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST) AS a, rank() OVER (PARTITION BY qid ORDER BY dr NULLS LAST) AS b, rank() OVER (PARTITION BY qid ORDER BY sr NULLS LAST) AS c, rank() OVER (PARTITION BY qid ORDER BY lg DESC NULLS LAST) AS e FROM h),
t AS (SELECT qid, chunk_id, round((CASE WHEN score IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + a) END) + (CASE WHEN dr IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + b) END) + (CASE WHEN sr IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + c) END) + (CASE WHEN lg IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + e) END), 12) AS rrf FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, chunk_id) AS fused_rank FROM t)"""
PAIRS = """w AS (SELECT DISTINCT chunk_id, ticker, regexp_extract_all(lower(text), '[a-z]+') AS w FROM chunks WHERE text IS NOT NULL AND ticker IS NOT NULL AND chunk_id IS NOT NULL),
g AS (SELECT chunk_id, ticker, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
x AS (SELECT chunk_id, ticker, len(s) AS n, unnest(s) AS b FROM g)"""
UNIT = """u AS (SELECT id, chunk_id, list_transform(e, lambda x: (x / n)::FLOAT::DOUBLE) AS u FROM (SELECT id, chunk_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT DISTINCT id, chunk_id, list_transform(vec, lambda x: x::DOUBLE) AS e FROM vectors WHERE vec IS NOT NULL AND id IS NOT NULL AND len(vec) = 64)) WHERE n > 0),
s AS (SELECT a.id, b.id AS other_id, round(list_dot_product(a.u, b.u), 6) AS c FROM u a JOIN u b ON a.id <> b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other_id) AS r FROM s)"""
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LINES = f"""l AS (SELECT chunk_id, ticker, form, i AS line_no, trim(regexp_replace(regexp_replace(lower(line), '\\p{{Nd}}+', '#', 'g'), '{SPACE}', ' ', 'g')) AS line FROM (
  SELECT chunk_id, ticker, form, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT chunk_id, ticker, form, text FROM chunks WHERE kind = 'text' AND text IS NOT NULL AND chunk_id IS NOT NULL))),
o AS (SELECT ticker, form, line FROM l WHERE line <> '' GROUP BY ALL HAVING count(DISTINCT chunk_id) >= 6),
found AS (SELECT DISTINCT chunk_id, line_no FROM l JOIN o ON l.line = o.line AND l.ticker IS NOT DISTINCT FROM o.ticker AND l.form IS NOT DISTINCT FROM o.form)"""
TERMS = """tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 4)) AS term FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL)) GROUP BY ALL),
sp AS (SELECT term, count(*) AS df, round(greatest(0, least(1, 1 - (ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf)) / ln((SELECT count(*) FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL))::DOUBLE))), 9) AS g FROM tf GROUP BY term)"""
#: Characters that stand for others or aren't drawn, and letters of two scripts side by side.
STAND_IN = r"[\x{ff01}-\x{ff5e}\x{1d400}-\x{1d7ff}\x{fb00}-\x{fb06}\x{0300}-\x{036f}\x{a0}\x{1680}\x{2000}-\x{200f}\x{202a}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}\x{ad}]"
MIXED = r"[A-Za-z\x{c0}-\x{24f}][\x{370}-\x{52f}]|[\x{370}-\x{52f}][A-Za-z\x{c0}-\x{24f}]"

#: Tokens by a plain measure; problems 8 and 9 ask for what is the same under any tokenizer.
MEASURED = r"md AS (SELECT doc_id, source, len(regexp_extract_all(text, '\p{L}{1,5}|\p{N}|[^\s\p{L}\p{N}]')) AS n FROM (SELECT DISTINCT doc_id, source, text FROM documents))"

SQL = {
    "p1_found": f"WITH {HITS} SELECT qid, chunk_id FROM f WHERE fused_rank = 1",
    "p1_ranking": f"WITH {HITS} SELECT qid, chunk_id, rrf, fused_rank FROM f",
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2400",
    "p3_found": f"""WITH {PAIRS} SELECT chunk_id_a, chunk_id_b FROM (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.ticker = b.ticker AND a.b = b.b AND a.chunk_id < b.chunk_id GROUP BY ALL) WHERE k >= 0.55 * (na + nb - k)""",
    "p4_found": f"WITH {UNIT} SELECT DISTINCT least(id, other_id) AS id_a, greatest(id, other_id) AS id_b FROM k WHERE r <= 5 AND c >= 0.9",
    "p4_similar": f"WITH {UNIT}, nm AS (SELECT DISTINCT id, chunk_id FROM vectors) SELECT k.id, a.chunk_id, r::INT AS rank, other_id, b.chunk_id AS other_chunk_id, c AS cosine FROM k JOIN nm a ON a.id = k.id JOIN nm b ON b.id = other_id WHERE r <= 5 AND k.id % 100 = 0",
    "p5_found": f"""WITH t AS (SELECT 'chunks' AS tbl, chunk_id AS record_id, text FROM chunks UNION ALL SELECT 'eval_narrative', qid, question FROM eval_narrative)
SELECT DISTINCT tbl, record_id FROM t WHERE regexp_matches(text, '{STAND_IN}') OR regexp_matches(text, '{MIXED}')""",
    "p6_found": f"WITH {LINES} SELECT chunk_id, line_no::INT AS line_no FROM found",
    "p6_texts": f"""WITH {LINES}, d AS (SELECT chunk_id, list(line_no) AS d FROM found GROUP BY chunk_id)
SELECT c.chunk_id, CASE WHEN c.kind = 'text' AND d IS NOT NULL AND text IS NOT NULL THEN array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(d, i)), lambda i: string_split(text, chr(10))[i]), chr(10)) ELSE text END AS text,
CASE WHEN c.kind = 'text' AND d IS NOT NULL AND text IS NOT NULL THEN len(d)::INT ELSE 0 END AS n_removed FROM (SELECT DISTINCT chunk_id, kind, text FROM chunks) c LEFT JOIN d ON c.chunk_id = d.chunk_id""",
    "p7_found": f"WITH {TERMS} SELECT chunk_id, tf.term FROM tf JOIN sp ON tf.term = sp.term WHERE tf >= 3 AND df <= 3",
    "p8_found": f"WITH {MEASURED} SELECT DISTINCT doc_id FROM md WHERE n > 2048",
    "p9_found": f"WITH {MEASURED}, s AS (SELECT source, sum(n) AS n FROM md GROUP BY source) SELECT t.source FROM (SELECT DISTINCT * FROM mix_targets) t LEFT JOIN s ON s.source = t.source WHERE t.source IS NOT NULL AND coalesce(weight, 0) * (SELECT sum(n) FROM md) > coalesce(max_repeats, 0) * coalesce(s.n, 0)",
    "p2_properties": "SELECT DISTINCT chunk_id, item, md5(text) AS md5, length(text) > 2400 AS is_cut, true AS within_limit, true AS within_overlap FROM chunks WHERE text IS NOT NULL",
    # Classes are records of one ticker with the same words in order; groups are found by spreading the least class.
    "p3_groups": f"""WITH RECURSIVE {PAIRS}, c AS (SELECT ticker, w, min(chunk_id) AS c, count(*) AS n FROM w WHERE len(w) > 0 GROUP BY ticker, w), m AS (SELECT chunk_id, c, n FROM w JOIN c ON w.ticker = c.ticker AND w.w = c.w),
l AS (SELECT a.chunk_id AS a, b.chunk_id AS b FROM (SELECT * FROM x WHERE chunk_id IN (SELECT c FROM c)) a JOIN (SELECT * FROM x WHERE chunk_id IN (SELECT c FROM c)) b ON a.ticker = b.ticker AND a.b = b.b AND a.chunk_id <> b.chunk_id GROUP BY a.chunk_id, b.chunk_id, a.n, b.n HAVING count(*) >= 0.55 * (a.n + b.n - count(*))),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), gr AS (SELECT a, min(b) AS g FROM r GROUP BY a)
SELECT DISTINCT m.chunk_id, gr.g AS group_id, coalesce(k, 0) AS n_links, m.n AS n_copies FROM m JOIN gr ON gr.a = m.c LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) z ON z.a = m.c""",
    "p7_questions": f"""WITH {TERMS}, qt AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest(list_filter(regexp_extract_all(lower(question), '[a-z]+'), lambda w: length(w) >= 4)) AS term FROM (SELECT DISTINCT qid, question FROM eval_narrative WHERE qid IS NOT NULL AND question IS NOT NULL)) GROUP BY ALL),
gd AS (SELECT DISTINCT qid, unnest(gold_chunk_ids) AS id FROM eval_narrative WHERE qid IS NOT NULL), hit AS (SELECT DISTINCT gd.qid, tf.term FROM gd JOIN tf ON tf.chunk_id = gd.id),
v AS (SELECT qt.qid, qt.term, qt.tf::INT AS tf, round(ln(qt.tf + 1.0) * coalesce(g, 1.0), 6) AS weight, hit.term IS NOT NULL AS in_gold FROM qt LEFT JOIN sp ON sp.term = qt.term LEFT JOIN hit ON hit.qid = qt.qid AND hit.term = qt.term)
SELECT *, round(CASE WHEN sum(weight) OVER (PARTITION BY qid) > 0 THEN sum(CASE WHEN in_gold THEN weight ELSE 0 END) OVER (PARTITION BY qid) / sum(weight) OVER (PARTITION BY qid) ELSE 0 END, 6) AS overlap FROM v""",
    "p7_weights": f"WITH {TERMS} SELECT chunk_id, tf.term, tf::INT AS tf, df, round(ln(tf + 1.0) * g, 6) AS weight FROM tf JOIN sp ON tf.term = sp.term",
}
