import random
from collections import defaultdict

from skerry.llm import fusion

SCHEMA = "qid string, chunk_id string, score double, dense_rank int, sparse_rank int, rerank_logit double"


def brute(hits, k=60):
    best = {}
    for q, c, s, d, p, l in hits:
        if q is None or c is None:
            continue
        l, s = (None if x is not None and x != x else x for x in (l, s))
        new = [s, None if d is None else -d, None if p is None else -p, l]
        old = best.get((q, c), [None] * 4)
        best[q, c] = [a if b is None else b if a is None else max(a, b) for a, b in zip(old, new)]
    by = defaultdict(dict)
    for (q, c), v in best.items():
        by[q][c] = v
    out = []
    for q, m in by.items():
        total = {c: round(sum(1 / (k + 1 + sum(w[i] is not None and w[i] > v[i] for w in m.values())) for i in range(4) if v[i] is not None), 12) for c, v in m.items()}
        out += [(q, c, n) for n, c in enumerate(sorted(total, key=lambda c: (-total[c], c)), 1)]
    return sorted(out)


def made(n, seed=1):
    r = random.Random(seed)
    maybe = lambda x: None if r.random() < 0.2 else x
    return [(r.choice(["a", "a", "a", "b", "c"]), f"c{r.randrange(n)}", maybe(r.choice([1.0, 2.5, r.random()])), maybe(r.randrange(1, 40)), maybe(r.randrange(1, 40)), maybe(r.choice([float("nan"), r.gauss(0, 9)]))) for _ in range(n)]


def test_like_brute_force(spark, rows):
    hits = made(400) + [(None, "x", 1.0, 1, 1, 1.0), ("a", None, 1.0, 1, 1, 1.0), ("d", "only", None, None, None, None), ("b", "c1", 1.0, 1, 1, 1.0), ("b", "c1", 1.0, 1, 1, 1.0)]
    df = spark.createDataFrame(hits, SCHEMA).selectExpr("*", "1 AS _bin", "2 AS rrf", "3 AS n")
    assert rows(fusion.rank_fusion(df), "qid", "chunk_id", "fused_rank") == brute(hits)


def test_a_hot_query_ranks_the_same(spark, rows):
    hits = made(600, 2)
    df = spark.createDataFrame(hits, SCHEMA)
    assert rows(fusion.rank_fusion(df, hot_rows=50), "qid", "chunk_id", "fused_rank") == brute(hits)


def test_all_tied_and_hot(spark, rows):
    hits = [("q", f"c{i:03d}", 1.0, 5, 5, 0.0) for i in range(300)]
    df = spark.createDataFrame(hits, SCHEMA)
    assert rows(fusion.rank_fusion(df, hot_rows=50), "chunk_id", "fused_rank") == [(f"c{i:03d}", i + 1) for i in range(300)]


def test_no_field_outweighs_by_range(spark, rows):
    hits = [("q", "a", 1e9, 9, 9, -9.0), ("q", "b", 1.0, 1, 1, 5.0), ("q", "c", 0.5, 2, 2, 4.0)] + [("q", f"z{i}", 2.0 + i, 10 + i, 10 + i, -10.0 - i) for i in range(5)]
    df = spark.createDataFrame(hits, SCHEMA)
    assert rows(fusion.rank_fusion(df).filter("fused_rank = 1"), "chunk_id") == [("b",)]


def test_empty(spark):
    assert fusion.rank_fusion(spark.createDataFrame([], SCHEMA)).count() == 0
