import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.operators import chunking, flatten, html, labels, metrics, retrieval, sampling
from skerry.plans import eval_sets, retrieval as plans


def test_rrf(spark, rows):
    lists = [("q", "a", 1, None), ("q", "b", 2, None), ("q", "b", None, 1), ("q", "c", None, 2)]
    got = rows(retrieval.fuse_ranks(spark.createDataFrame(lists, "qid string, id string, dense_rank int, sparse_rank int")), "id", "score", "rnk")
    assert got == [("a", round(1 / 61, 9), 2), ("b", round(1 / 62 + 1 / 61, 9), 1), ("c", round(1 / 62, 9), 3)]


def test_rrf_ties_keep_the_dense_order(spark, rows):
    lists = [("q", "b", 1, 2), ("q", "a", 2, 1), ("r", "x", None, None), ("s", "y", None, 3)]
    got = rows(retrieval.fuse_ranks(spark.createDataFrame(lists, "qid string, id string, dense_rank int, sparse_rank int")), "qid", "id", "rnk")
    assert got == [("q", "a", 2), ("q", "b", 1), ("s", "y", 1)]


def test_one_list_is_needed(spark):
    df = spark.createDataFrame([], "qid string, id string, dense_rank int, sparse_rank int")
    with pytest.raises(ValueError):
        plans.ranked(df, dense=False, sparse=False)


def test_minmax(spark, rows):
    df = spark.createDataFrame([("a", "x", 3.0), ("b", "x", 1.0), ("b", "y", 3.0), ("c", "x", 2.0), ("c", "y", 2.0)], "qid string, id string, score double")
    assert rows(retrieval.minmax(df, ["qid"]), "qid", "id", "norm") == [("a", "x", 1.0), ("b", "x", 0.0), ("b", "y", 1.0), ("c", "x", 1.0), ("c", "y", 1.0)]
    maps = retrieval.score_maps(df.filter("qid = 'b'"), df.filter("qid = 'b' AND id = 'x'").withColumn("id", F.lit("z")))
    assert rows(maps, "id", "nd", "ns") == [("x", 0.0, 0.0), ("y", 1.0, 0.0), ("z", 0.0, 1.0)]


def test_dat_alpha(spark):
    cases = {(0, 0): 0.5, (5, 5): 0.5, (5, 0): 1.0, (0, 5): 0.0, (1, 3): 0.2, (3, 1): 0.8, (4, 0): 1.0, (5, 4): 1.0, (2, 3): 0.4}
    df = spark.createDataFrame(list(cases), "sv int, sb int")
    got = {(r["sv"], r["sb"]): r["a"] for r in df.withColumn("a", retrieval.dat_alpha(F.col("sv"), F.col("sb"))).collect()}
    assert got == cases


def test_grades(spark):
    df = spark.createDataFrame([("3",), ("9",), ("-2",), ("4.9",), ("x",), (None,)], "g string")
    assert [r[0] for r in df.select(retrieval.grade(F.col("g"))).collect()] == [3, 5, 0, 4, None, None]


def vectors(spark, data):
    return spark.createDataFrame(data, "id long, vec array<float>")


def test_dense_search(spark, rows):
    v = vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 3.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [1.0, 1.0])])
    q = spark.createDataFrame([(1, [5.0, 0.0]), (9, None)], "qid long, qvec array<float>")
    assert rows(retrieval.dense_search(q, v, 3)) == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (1, 7, 0.707107, 3)]
    assert rows(retrieval.dense_search(q, v, 9, without_self=True), "id", "score") == [(2, 1.0), (3, 0.0), (4, 0.0), (7, 0.707107)]
    assert retrieval.dense_search(q, vectors(spark, []), 3).count() == 0


def test_dense_search_with_empty_blocks(spark, rows):
    """String ids with a block for each row, so that most blocks meet nothing; queries of another length are left out."""
    v = spark.createDataFrame([(f"v{i}", [1.0, float(i)]) for i in range(9)], "id string, vec array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", None)], "qid string, qvec array<double>")
    assert rows(retrieval.dense_search(q, v, 2, block=1), "qid", "id") == [("a", "v0"), ("a", "v1")]
    assert retrieval.dense_search(q.filter("qid = 'b'"), v, 2, block=1).count() == 0


@pytest.mark.parametrize("k,block", [(3, 65536), (10, 40), (50, 7)])
def test_bm25_search_is_the_best_of_all_scores(spark, rows, k, block):
    import random

    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(r.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = spark.createDataFrame([(f"d{i:03}", text(r.randrange(1, 30))) for i in range(300)] + [("e", None), ("f", "")], "id string, text string")
    q = spark.createDataFrame([(f"q{i}", text(r.randrange(1, 9))) for i in range(40)] + [("none", "zzz"), ("null", None)], "qid string, question string")
    post, lengths, terms = retrieval.postings(docs)
    want = retrieval.best(retrieval.bm25_scores(q, post, lengths, terms), ["qid"], "score", "id", k)
    got = retrieval.bm25_search(q, post, lengths, terms, k, block=block, part=9)
    assert rows(got, "qid", "id", "score", "rnk") == rows(want, "qid", "id", "score", "rnk")


def test_bm25_search_filled_up(spark, rows):
    docs = spark.createDataFrame([("a", "red"), ("b", "blue"), ("c", "red blue"), ("d", None)], "id string, text string")
    q = spark.createDataFrame([("x", "red"), ("y", "green")], "qid string, question string")
    post, lengths, terms = retrieval.postings(docs)
    got = rows(retrieval.bm25_search(q, post, lengths, terms, 3, fill=True), "qid", "rnk", "id")
    assert got == [("x", 1, "a"), ("x", 2, "c"), ("x", 3, "b"), ("y", 1, "a"), ("y", 2, "b"), ("y", 3, "c")]


def test_dense_search_in_blocks(spark, rows):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    v = vectors(spark, [(i, [float(f) for f in r]) for i, r in enumerate(x)])
    q = v.filter("id % 10 = 0").toDF("qid", "qvec")
    assert rows(retrieval.dense_search(q, v, 7, block=64)) == rows(retrieval.dense_search(q, v, 7))


def test_bm25(spark):
    docs = [("a", "net sales rose"), ("b", "net net loss"), ("c", "weather"), ("d", "")]
    post, lengths, terms = retrieval.postings(spark.createDataFrame(docs, "id string, text string"))
    q = spark.createDataFrame([("q", "Net sales net"), ("r", "absent"), ("s", "")], "qid string, question string")
    got = {(r["qid"], r["id"]): r["score"] for r in retrieval.bm25_scores(q, post, lengths, terms).collect()}
    n, avg = 4, 7 / 4
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    w = lambda tf, dl: tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {("q", "a"): round(2 * idf(2) * w(1, 3) + idf(1) * w(1, 3), 6), ("q", "b"): round(2 * idf(2) * w(2, 3), 6)}


def test_rerank(spark, rows):
    c = spark.createDataFrame([("q", f"c{i}", i) for i in range(1, 6)], "qid string, id string, rnk int")
    l = spark.createDataFrame([("q", "c2", 1.0), ("q", "c3", 5.0), ("q", "c5", 9.0)], "qid string, id string, logit double")
    assert rows(retrieval.rerank(c, l, 3, cut=4), "rnk", "id") == [(1, "c3"), (2, "c2"), (3, "c1")]


def scored(spark, hits, gold, questions):
    h = spark.createDataFrame(hits, "qid string, id string, rnk int")
    g = spark.createDataFrame(gold, "qid string, id string")
    return {r["qid"]: r for r in metrics.per_question(h, g, spark.createDataFrame([(q,) for q in questions], "qid string")).collect()}


def test_metrics(spark):
    hits = [("q", "x", 1), ("q", "g1", 2), ("q", "g2", 3), ("r", "g", 1), ("none", "x", 1), ("late", "g", 11)]
    got = scored(spark, hits, [("q", "g1"), ("q", "g2"), ("q", "g2"), ("r", "g"), ("miss", "z"), ("late", "g")], ["q", "r", "none", "miss", "late"])
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert got["q"]["ndcg"] == pytest.approx(want, abs=1e-6) and got["q"]["mrr"] == 0.5 and got["q"]["r5"] == 1.0 and got["q"]["r1"] == got["q"]["s1"] == 0.0
    assert got["r"][1:] == (1.0,) * 6
    for q in ("none", "miss", "late"):
        assert got[q][1:] == (0.0,) * 6


@pytest.mark.parametrize("w, l, p", [(69, 34, 0.00073), (72, 34, 0.00028), (28, 32, 0.699), (5, 1, 0.219), (3, 3, 1.0), (0, 0, 1.0), (9, 0, 0.003906)])
def test_sign_test(spark, w, l, p):
    got = spark.range(1).select(metrics.sign_test(F.lit(w), F.lit(l))).first()[0]
    assert got == pytest.approx(p, rel=0.02)


def test_grouping_with_all(spark, rows):
    df = spark.createDataFrame([("c", "n", "q1", *[1.0] * 6), ("c", "m", "q2", *[0.0] * 6)], "config string, split string, qid string, r1 double, s1 double, r5 double, r10 double, ndcg double, mrr double")
    assert rows(metrics.mean_metrics(df, ("config", "split"), also_all=True), "split", "n", "ndcg") == [("all", 2, 0.5), ("m", 1, 0.0), ("n", 1, 1.0)]


def test_facts_and_filings(spark, rows):
    e = lambda **k: {"val": 5, "fy": 2024, "fp": "FY", "start": "2023-01-01", "end": "2023-12-31", "form": "10-K", "accn": "1-2-3", "filed": "2024-02-01"} | k
    doc = {"facts": {"us-gaap": {"A": {"label": "", "units": {"USD": [e(), e(form="10-K/A"), e(end=None, val=None)]}}, "B": {"label": "Bee", "units": {"sh": [e(form="10-Q", start="2023-10-01")]}}}, "dei": {"C": {"label": "x", "units": {"n": [e()]}}}}}
    df = spark.createDataFrame([("T", json.dumps(doc)), ("U", "{broken"), ("V", None), ("W", "{}")], "ticker string, json string")
    got = rows(flatten.flatten_facts(df), "ticker", "concept", "label", "unit", "pos", "value", "fiscal_year", "annual", "accession")
    assert got == [("T", "A", "A", "USD", 0, 5.0, 2023, True, "123"), ("T", "A", "A", "USD", 2, None, None, False, "123"), ("T", "B", "Bee", "sh", 0, 5.0, 2023, False, "123")]
    recent = {"form": ["8-K", "10-K", "10-Q", "10-K"], "accessionNumber": ["a-0", "a-1", "a-2", "a-3"], "filingDate": ["2024-04-01", "2024-03-01", "2024-02-01", "2023-03-01"], "reportDate": ["", "2023-12-31", "", "2022-12-31"], "primaryDocument": ["w", "x", "y", "z"]}
    subs = spark.createDataFrame([("T", "0000000012", "Co", json.dumps({"filings": {"recent": recent}}))], "ticker string, cik string, company string, json string")
    got = rows(flatten.with_names(flatten.list_filings(subs, limit=2), "https://h"), "pos", "form", "accession", "report_date", "slug", "url")
    assert got == [(1, "10-K", "a1", "2023-12-31", "T_10K_2023-12-31", "https://h/12/a1/x"), (2, "10-Q", "a2", "2024-02-01", "T_10Q_2024-02-01", "https://h/12/a2/y")]


def test_tickers(spark, rows):
    doc = spark.createDataFrame([(json.dumps({"0": {"ticker": "abc", "cik_str": 77, "title": "A"}, "1": {"ticker": "X", "cik_str": 1234567890, "title": "B"}}),)], "json string")
    t = flatten.ticker_map(doc)
    assert rows(t) == [("ABC", "0000000077", "A"), ("X", "1234567890", "B")]
    wanted = spark.createDataFrame([("aBc",), ("nope",)], "ticker string")
    assert rows(flatten.resolve(wanted, t, strict=False), "ticker", "cik") == [("ABC", "0000000077")]
    with pytest.raises(Exception, match="no such ticker"):
        flatten.resolve(wanted, t).collect()


def test_windows():
    assert chunking.windows(["x" * 3000]) == ["x" * 3000]
    a, b, c = "a" * 1500, "b" * 1000, "c" * 10
    got = chunking.windows([a, b, c])
    assert got == [a, a[-200:] + "\n" + b + "\n" + c]
    assert chunking.windows([]) == [] and chunking.windows(["", " "]) == []
    assert chunking.windows(["aa", "bb", "cc"], cap=6, overlap=0) == ["aa\nbb", "cc"]
    rows = ["y" * n for n in (900, 900, 900, 900)]
    assert [len(w) for w in chunking.windows(rows)] == [1801, 2002] and chunking.windows(rows)[1].startswith("y" * 200 + "\n")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=30))
def test_windows_are_filled_and_overlap(sizes):
    """Lines come out once, in order; no window could take the next line; each starts with the end of the one before."""
    rows = [chr(97 + i) * n for i, n in enumerate(sizes)]
    left, before = list(rows), ""
    for w in chunking.windows(rows, 100, 20):
        carry = before[-20:]
        assert w.startswith(carry)
        mine = w[len(carry) + 1 :].split("\n") if carry else w.split("\n")
        assert mine == left[: len(mine)]
        del left[: len(mine)]
        assert len(w) + 1 <= 100 or len(mine) == 1
        assert not left or len(w) + 1 + len(left[0]) + 1 > 100
        before = w
    assert left == []


PAGE = """<html><head><title>t</title><script>var x = "<p>no</p>";</script><style>p {}</style></head><body><ix:header><p>hidden</p></ix:header>
<p>Cover&nbsp; page</p><p>Table of contents</p><h1>Item 1. Business</h1><p>We make <b>things</b>.</p>
<table><tr><td>Year</td><td>&nbsp;</td><td>2024</td></tr><tr><td></td><td> </td></tr><tr><td>Sales</td><td></td><td> 1,000 </td><td>x</td></tr></table>
<p>After the table</p><h2>ITEM 1A - Risks.</h2><p>Risky</p><table><tr><td>outer</td><td><table><tr><td>inner</td></tr></table></td></tr></table></body></html>"""


def test_blocks(spark, rows):
    df = spark.createDataFrame([("d", PAGE), ("e", None), ("f", "<table><tr><td> </td></tr></table>"), ("g", "plain & simple")], "doc_id string, html string")
    got = rows(html.blocks(df))
    assert [r[2] for r in got if r[0] == "d"] == ["text", "table", "text", "table"]
    assert got[0][3] == "Cover page\nItem 1. Business\nWe make\nthings\n."
    assert got[1][3] == "Year | 2024 | \nSales | 1,000 | x"
    assert got[3][3].count("inner") == 1 and "outer" in got[3][3]
    assert [r for r in got if r[0] != "d"] == [("g", 0, "text", "plain & simple")]


def test_chunks_of_a_filing(spark):
    long = " ".join(["sentence"] * 60)
    table = "<table><tr><td>Head</td><td>1</td></tr>" + "".join(f"<tr><td>row {i} {'z' * 60}</td><td>{i}</td></tr>" for i in range(60)) + "</table>"
    page = f"<p>{long}</p><p>short</p><h1>Item 7. Results</h1>{table}<p>{long} a</p>" + f"<p>{long}</p>" * 6 + "<h1>Item 8</h1><p>too short</p>"
    df = spark.createDataFrame([("T", "Co", "10-K", "2024-09-28", "acc", "T_10K", "u", page)], "ticker string, company string, form string, report_date string, accession string, slug string, url string, html string")
    got = sorted(chunking.chunk_filings(df).collect(), key=lambda r: r["chunk_id"])
    assert [r["chunk_id"] for r in got] == [f"T_10K#{i:04d}" for i in range(1, len(got) + 1)]
    assert got[0]["item"] is None and got[0]["breadcrumb"] == "T 10-K 2024"
    tables = [r for r in got if r["kind"] == "table"]
    assert len(tables) > 1 and all(r["text"].startswith("Head | 1\n") and r["breadcrumb"] == "T 10-K 2024 > Item 7. Results > [financial table]" for r in tables)
    texts = [r for r in got if r["kind"] == "text"]
    assert all(r["n_chars"] == len(r["text"]) >= 200 for r in texts) and {r["item"] for r in texts} == {None, "7"}


def test_sampling(spark, rows):
    df = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "1"), ("C", "1")], "ticker string, n string")
    assert [tuple(r) for r in sampling.interleave(df, "ticker", ["n"], limit=4).select("ticker", "n").collect()] == [("A", "1"), ("B", "1"), ("C", "1"), ("A", "2")]
    assert rows(sampling.quota(df, "ticker", 1, ["n"]), "ticker", "n") == [("A", "1"), ("B", "1"), ("C", "1")]
    assert rows(sampling.first_wins(df, ["ticker"], [F.desc("n")])) == [("A", "2"), ("B", "1"), ("C", "1")]


IDF = {"macroeconomic": 4.0, "headwinds": 4.0, "gross": 2.0, "margin": 2.0, "weak": 3.0, "economy": 3.0, "apple": 1.0}
GOLD = "Adverse macroeconomic headwinds could compress gross margin across the Company's product lines."


@pytest.mark.parametrize(
    "question, gold, reason",
    [
        ("How could adverse macroeconomic headwinds could compress gross margin?", GOLD, "shared 4-gram"),
        ("What happens to Apple's profit per unit when the economy weakens?", GOLD, None),
        ("What supplier concentration exposure might disrupt manufacturing output and delivery schedules?", "It is the case that in the event of a downturn the value of the assets held by the entity may decline substantially.", None),
        ("What is the risk to the value of the assets?", "unrelated passage text", "too short"),
        ("Gross plant margin weak today", "margin was weak and gross", "idf overlap 1.00"),
        ("", None, "too short"),
    ],
)
def test_leakage(spark, question, gold, reason):
    pairs = spark.createDataFrame([("p", question, gold)], "pid string, question string, gold_text string")
    weights = spark.createDataFrame(list(IDF.items()), "term string, idf double")
    assert labels.screened(pairs, weights).first()["reason"] == reason


def test_overlap_bounds(spark, rows):
    pairs = spark.createDataFrame([("a", "weak economy", "a weak economy hurts"), ("b", "weak economy", "unrelated text"), ("c", "of the", "of the"), ("d", "weak economy", None)], "pid string, question string, gold_text string")
    weights = spark.createDataFrame(list(IDF.items()), "term string, idf double")
    assert rows(labels.idf_overlap(pairs, weights)) == [("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 0.0)]


def test_value_matches(spark, rows):
    chunk = "chunk_id string, ticker string, form string, report_date string, item string, item_title string, kind string, text string, breadcrumb string"
    c = lambda i, t, d, x: (i, t, "10-K", d, None, None, "text", x, "")
    chunks = spark.createDataFrame([c("1", "A", "2024-01-01", "sales of $1,234 million"), c("2", "A", "2021-01-01", "1,234"), c("3", "A", "2024-02-01", "id 99912345 (1,2345)"), c("4", "B", "2024-01-01", "1,234"), c("5", "A", None, "1,234"), c("6", "A", "2023-01-01", None), c("7", "A", "2023-05-05", "loss of 6.11 each, -1,234")], chunk)
    facts = spark.createDataFrame([(1, "A", 2022, 1234e6), (2, "A", 2022, 6.11), (3, "A", None, 1234.0), (4, "A", 2022, None), (5, "A", 2022, -1234.0)], "fact_id int, ticker string, fiscal_year int, value double")
    assert rows(labels.value_matches(facts, chunks)) == [(1, "1"), (1, "3"), (1, "7"), (2, "7"), (5, "7")]
    assert rows(labels.value_matches(facts, chunks, most=2)) == [(2, "7"), (5, "7")]


def test_a_failing_first_fact_does_not_block_the_second(spark, rows):
    chunk = "chunk_id string, ticker string, form string, report_date string, item string, item_title string, kind string, text string, breadcrumb string"
    chunks = spark.createDataFrame([("c", "A", "10-K", "2023-06-01", None, None, "text", "revenue 7,777 only", "")], chunk)
    facts = spark.createDataFrame([("A", "Rev", "revenue", 1111.0, "USD", 2022, "2023-01-01"), ("A", "Rev", "revenue", 7777.0, "USD", 2022, "2023-02-01"), ("A", "Rev", "revenue", 7777.0, "EUR", 2022, "2023-03-01")], "ticker string, concept string, label string, val double, unit string, fiscal_year int, filed string")
    got = eval_sets.numeric_questions(facts, chunks, ["filed", "val"]).collect()
    assert [(r["qid"], r["question"], r["expected_value"], r["unit"], r["gold_chunk_ids"]) for r in got] == [("A-Rev-2022", "What was A's revenue in fiscal 2022?", 7777.0, "USD", ["c"])]


def test_similar_sets_like_brute_force(spark, rows):
    import random

    r = random.Random(1)
    words = ["w" + "".join(r.choices("abcdefg", k=5)) for _ in range(60)]
    data = [(f"{i:03d}", r.choice("AB"), " ".join(r.sample(words, r.randrange(1, 14)))) for i in range(150)]
    data += [("x1", "A", "alpha bravo gamma"), ("x2", "A", "gamma bravo alpha alpha"), ("x3", "A", "of the"), ("x4", None, "alpha bravo gamma"), ("x5", "A", None)]
    df = spark.createDataFrame(data, "id string, group string, text string")
    sets = {}
    for i, g, t in data:
        s = frozenset(w for w in (t or "").split() if len(w) > 2 and w not in ("the",))
        if s and g:
            sets.setdefault(g, []).append((i, s))
    want, links = [], []
    for g, L in sets.items():
        first = {s: min(i for i, t in L if t == s) for _, s in L}
        near = {i: {j for j, t in L if j != i and len(s & t) / len(s | t) >= 0.55} for i, s in L}
        want += [(g, i, first[s], len(near[i])) for i, s in L]
        reps = sorted((i, s) for s, i in first.items())
        links += [(g, a, b) for n, (a, s) in enumerate(reps) for b, t in reps[n + 1 :] if len(s & t) / len(s | t) >= 0.55]
    found, members = labels.similar_sets(df)
    assert rows(found, "group", "a", "b") == sorted(links)
    assert rows(labels.near_counts(found, members), "group", "id", "cls", "n_near") == sorted(want)


def test_copies_and_their_neighbour_are_all_near_each_other(spark, rows):
    """Three copies and a neighbour of each: every one has the three others."""
    same = "freight volumes fell harbour strikes closed terminals weeks"
    df = spark.createDataFrame([("a", "A", same), ("b", "A", same), ("c", "A", same.upper()), ("d", "A", same + " again"), ("e", "B", same)], "id string, group string, text string")
    found, members = labels.similar_sets(df)
    assert rows(labels.near_records(df.select("id"), found, members)) == sorted((x, y) for x in "abcd" for y in "abcd" if x != y)
    assert rows(labels.near_counts(found, members), "id", "cls", "n_near") == [("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("d", "d", 3), ("e", "e", 0)]
    none = df.limit(0)
    assert labels.near_counts(*labels.similar_sets(none)).count() == 0


def test_narrative_questions(spark):
    chunk = "chunk_id string, ticker string, item string, item_title string, kind string, report_date string, text string"
    body = "Freight volumes fell as harbour strikes closed several terminals for weeks. " * 15
    chunks = spark.createDataFrame([("1", "A", "1A", "Risk", "text", "2024-01-01", body), ("2", "A", "8", None, "text", "2024-01-01", body), ("3", "A", "1A", None, "table", "2024-01-01", body), ("4", "A", "1A", None, "text", "2024-01-01", "short"), ("5", "A", "7", None, "text", "2023-01-01", body + " again")], chunk)
    p = eval_sets.narrative_passages(chunks, ["1A", "7"])
    assert sorted(r[0] for r in p.select("chunk_id").collect()) == ["1", "5"]
    prompt = {r["id"]: r["prompt"] for r in eval_sets.writer_prompts(p).collect()}
    assert "section Risk." in prompt["1"] and "section Item 7." in prompt["5"] and '{"question": "..."' in prompt["1"]
    answers = spark.createDataFrame([("1", 'Sure: {"question": "Why did A ship less cargo through ports lately?", "topic": "ports"}'), ("5", '{"question": "harbour strikes closed several terminals?"}')], "id string, answer string")
    near = labels.similar_sets(p.select("chunk_id", "ticker", "text").toDF("id", "group", "text"))
    q, rejected = eval_sets.narrative_questions(p, answers, chunks.select("chunk_id", "text").toDF("id", "text"), *near)
    assert [(r["qid"], r["gold_chunk_ids"]) for r in q.collect()] == [("1-narr", ["1", "5"])]
    assert [tuple(r) for r in rejected.collect()] == [("shared", 1)]


def test_narrative_gold_holds_all_members_of_classes(spark):
    """Passages 1 and 2 have the same words, 3 and 4 others near to these: each kept one has all as gold."""
    body = "Freight volumes fell as harbour strikes closed several terminals for weeks. " * 15
    rows = [(i, "A", "7", None, "text", "2024-01-01", t) for i, t in (("1", body), ("2", body.upper()), ("3", body + "again"), ("4", body + "again again"), ("5", "Another passage of quite other content is here. " * 20))]
    p = spark.createDataFrame(rows, "chunk_id string, ticker string, item string, item_title string, kind string, report_date string, text string")
    answers = spark.createDataFrame([("4", '{"question": "Why did A ship less cargo through ports lately?"}')], "id string, answer string")
    near = labels.similar_sets(p.select("chunk_id", "ticker", "text").toDF("id", "group", "text"))
    q, _ = eval_sets.narrative_questions(p, answers, p.select("chunk_id", "text").toDF("id", "text"), *near)
    assert [r["gold_chunk_ids"] for r in q.collect()] == [["4", "1", "2", "3"]]


def test_rejections_are_counted_until_the_quota_is_full(spark):
    """Of passages in seeded order, those after the last one kept aren't looked at; twice the quota is asked about."""
    body = "Freight volumes fell as harbour strikes closed several terminals for weeks. " * 15
    p = spark.createDataFrame([(f"{i:02}", "A", "7", None, "text", "2024-01-01", f"{body} {i}") for i in range(20)], "chunk_id string, ticker string, item string, item_title string, kind string, report_date string, text string")
    asked = sorted(r[0] for r in eval_sets.to_ask(p, 3).select("chunk_id").collect())
    assert len(asked) == 6
    order = sorted((f"{i:02}" for i in range(20)), key=lambda i: __import__("hashlib").md5(f"0|{i}".encode()).hexdigest())
    assert asked == sorted(order[:6])
    bad = order[1]
    answers = spark.createDataFrame([(i, json.dumps({"question": "harbour strikes closed several terminals?" if i in (bad, order[5]) else "Why did A ship less cargo through ports lately?"})) for i in order[:6]], "id string, answer string")
    near = labels.similar_sets(p.select("chunk_id", "ticker", "text").toDF("id", "group", "text"))
    q, rejected = eval_sets.narrative_questions(p, answers, p.select("chunk_id", "text").toDF("id", "text"), *near, per_ticker=3)
    assert q.count() == 3 and [tuple(r) for r in rejected.collect()] == [("shared", 1)]


def test_concepts_keep_to_a_list(spark, rows):
    f = spark.createDataFrame([("A", "Assets", "assets", 5.0, "2020-01-01", "2020-12-31", "10-K"), ("A", "Other", "other", 5.0, "2020-01-01", "2020-12-31", "10-K")], "ticker string, concept string, label string, val double, period_start string, period_end string, form string")
    concepts = spark.createDataFrame([("Assets", "total assets")], "concept string, label string")
    assert rows(eval_sets.eligible_facts(f, concepts), "concept", "label") == [("Assets", "total assets")]


def test_interleave_numbers_a_hot_group_over_many_ranges(spark, rows):
    data = [("hot", i) for i in range(3000)] + [(f"g{i % 7}", i) for i in range(500)] + [(None, 5), (None, 4), ("hot", 7)]
    df = spark.createDataFrame(data, "g string, i int")
    got = rows(sampling.interleave(df, "g", ["i"]), "g", "i", "turn")
    want = []
    for g in {g for g, _ in data}:
        want += [(g, i, n) for n, i in enumerate(sorted(i for h, i in data if h == g), 1)]
    assert got == sorted(want, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))
    assert sampling.interleave(df.limit(0), "g", ["i"]).count() == 0
    first = sampling.interleave(df, "g", ["i"], limit=9).collect()
    assert [r["turn"] for r in first] == [1] * 9


def test_minmax_of_groups_and_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), ("a", None, "z"), ("b", 2.0, "x"), (None, 5.0, "x"), (None, 7.0, "y")], "qid string, score double, id string")
    assert rows(retrieval.minmax(df, ["qid"]), "qid", "id", "norm") == [(None, "x", 0.0), (None, "y", 1.0), ("a", "x", 0.0), ("a", "y", 1.0), ("a", "z", None), ("b", "x", 1.0)]


@pytest.mark.parametrize("block", [8, 40, 1000])
def test_similar_pairs_in_blocks_like_brute_force(spark, rows, block):
    """A large group in blocks, small ones in portions, sizes from 1 to 700; hashes that fall together lose no pair."""
    import random

    from skerry.operators import setjoin

    r = random.Random(5)
    data = []
    for g, n in (("big", 90), ("b", 12), ("c", 1)):
        for i in range(n):
            base = data[-1][2] if data and data[-1][0] == g and i % 3 else [r.randrange(4000) for _ in range(r.choice((1, 5, 40, 150, 700)))]
            data.append((g, f"{g}{i:03}", sorted({w if r.random() < 0.8 else r.randrange(4000) for w in base}), f"{g}{i}".encode()))
    sets = spark.createDataFrame([(g, i, k, [w if w % 50 else 7 for w in s]) for g, i, s, k in data], "group string, id string, key binary, h array<int>")
    got = rows(setjoin.similar_pairs(sets, sets.select("group"), 0.55, block=block), "a", "b")
    near = lambda s, t: len(set(s) & set(t)) >= 0.55 * len(set(s) | set(t))
    want = {(x[1], y[1]) for x in data for y in data if x[0] == y[0] and x[1] < y[1] and near(x[2], y[2])}
    assert len(want) > 20 and want <= set(got) and len(got) == len(set(got)) < len(want) + 20


def test_similar_sets_of_a_large_group_shuffle_no_pairs(spark, rows, monkeypatch):
    """600 sets that share their rarest words by the hundred: pairs are only written where they are similar."""
    import random

    r = random.Random(2)
    text = lambda i: " ".join([f"rare{i % 3}{x}" for x in "abcdefgh"] + [f"word{r.randrange(5000)}" for _ in range(20)])
    df = spark.createDataFrame([(f"{i:03}", "A", text(i)) for i in range(600)] + [("x", "A", None), ("y", None, "some words"), ("z", "A", "")], "id string, group string, text string")
    written, stage = [], labels.staged
    monkeypatch.setattr(labels, "staged", lambda d: written.append(stage(d)) or written[-1])
    links, members = labels.similar_sets(df)
    assert links.count() == 0 and members.count() == 600
    assert written[-1].columns[:2] == ["group", "a"] and written[-1].count() == 0


def test_near_duplicate_links_read_repeated_rows_as_they_are(spark, rows, tmp_path):
    """Texts are not sorted out before: repeated rows, one id of two texts and empty texts give each link once, and no pair of words is made."""
    from skerry.plans import catalog

    body = "freight volumes fell harbour strikes closed terminals weeks"
    data = [("a", "A", body), ("a", "A", body), ("b", "A", body + " again"), ("b", "A", body + " again"), ("c", "A", body.upper()), ("d", "B", body), ("e", "A", "other words here"), ("e", "A", "different words altogether"), ("f", "A", None), ("g", None, body), ("h", "A", "")]
    spark.createDataFrame(data, "chunk_id string, ticker string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = catalog.near_duplicate_links(spark, str(tmp_path))
    assert rows(got) == [("A", "a", "b", round(8 / 9, 6))]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_once_shuffles_repeated_rows_only(spark, rows):
    from skerry.runtime import once

    data = [("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", None), ("a", "y", None), ("b", None, 2.0), (None, None, None), (None, None, None), ("c", "z", 3.0)]
    df = spark.createDataFrame(data, "id string, text string, `n.o` double")
    assert rows(once(df)) == rows(df.distinct()) and once(df.limit(0)).count() == 0
    assert rows(once(df.distinct())) == rows(df.distinct())


def test_narrative_eval_set_reads_each_passage_once(spark, tmp_path):
    """Repeated rows of chunks change nothing, and sets of words are made of all passages, whole rows only of those with an answer."""
    from skerry.plans import catalog

    body = "Freight volumes fell as harbour strikes closed several terminals for weeks. " * 15
    row = lambda i, t: (i, "A", "10-K", "2024-01-01", "7", None, "text", t, "")
    kinds = "chunk_id string, ticker string, form string, report_date string, item string, item_title string, kind string, text string, breadcrumb string"
    data = [row("1", body), row("1", body), row("2", body + "again"), row("3", body.upper()), *(row(f"o{i}", " ".join(f"w{i}x{j}" for j in range(200))) for i in range(20))]
    spark.createDataFrame(data, kinds).write.parquet(f"{tmp_path}/chunks.parquet")
    asked = [("q", "Why did A ship less cargo through ports lately?", "A", "narrative", ["1"])] * 2
    spark.createDataFrame(asked, "qid string, question string, ticker string, split string, gold_chunk_ids array<string>").write.parquet(f"{tmp_path}/eval_narrative.parquet")
    seen, keep = [], catalog.eval_sets.narrative_questions
    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog.eval_sets, "narrative_questions", lambda p, *a: seen.append(p.count()) or keep(p, *a))
        got = [(r["qid"], r["gold_chunk_ids"]) for r in catalog.narrative_eval_set(spark, str(tmp_path)).collect()]
    assert got == [("1-narr", "1 2 3")] and seen == [1]


def test_best_columns_hold_all_that_could_be_among_the_best():
    import numpy as np

    s = np.round(np.random.default_rng(1).normal(size=(20, 3333)), 2)
    for k in (1, 7, 50, 5000):
        row, col = retrieval._best_columns(s, k, 0.02)
        got = set(zip(row.tolist(), col.tolist()))
        edge = -np.sort(-s, axis=1)[:, min(k, 3333) - 1]
        assert {(r, c) for r in range(20) for c in np.flatnonzero(s[r] >= edge[r] - 0.015).tolist()} <= got and len(got) < 20 * (3 * k + 200)


def test_words_that_stand_alone_are_those_of_the_text():
    import random
    import re

    from skerry.sources.providers import OverlapReranker

    r = random.Random(4)
    text = lambda n: "".join(r.choice(["abcd", "abcde", "'", " ", "é", "_", "9999", "ABCD", "-", "cdab"]) for _ in range(n))
    words = lambda t: {w for w in re.findall(r"[a-z0-9']+", t.lower()) if len(w) > 3}
    for _ in range(200):
        q, passages = text(8), [text(12) for _ in range(6)] + ["", q_ if (q_ := text(3)) else ""]
        assert OverlapReranker().rerank(q, passages) == [len(words(q) & words(p)) / len(words(q)) if words(q) else 0.0 for p in passages]
