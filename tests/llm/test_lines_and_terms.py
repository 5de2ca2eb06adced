import math
import re
from collections import Counter

import pytest

from skerry.llm import boilerplate, distinctive

CHUNK = "chunk_id string, ticker string, form string, kind string, text string, line_no int, line string, _drop string, n int"


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in data], CHUNK)


def test_repeated_lines(spark, rows):
    data = [(f"c{i}", "A", "10-K", "text", f"Share  PAGE {i} of 10\nonly {'abcdefgh'[i]}\n\n  share page\xa0{i} of ７") for i in range(6)]
    data += [data[0], ("t", "A", "10-K", "table", "Share page 1 of 1"), ("o", "A", "10-Q", "text", "share page 3 of 3"), ("n", None, None, "text", "share page 3 of 3"), ("z", "A", "10-K", "text", None), (None, "A", "10-K", "text", "share page 1 of 2"), ("e", "A", "10-K", "text", "")]
    df = frame(spark, data)
    assert rows(boilerplate.repeated_lines(df)) == sorted((f"c{i}", n) for i in range(6) for n in (1, 4))
    assert boilerplate.repeated_lines(df, min_docs=7).count() == 0
    texts = {r["chunk_id"]: (r["text"], r["n_removed"]) for r in boilerplate.without_repeated_lines(df).collect()}
    assert texts["c2"] == ("only c\n", 2) and texts["t"] == ("Share page 1 of 1", 0) and texts["z"] == (None, 0) and texts["e"] == ("", 0) and texts["o"][1] == 0


def test_share_of_documents(spark, rows):
    data = [(f"c{i}", "A", "K", "text", ("same\n" if i < 8 else "") + ("rare\n" if i < 6 else "") + f"x{chr(97 + i)}") for i in range(10)]
    got = boilerplate.repeated_lines(frame(spark, data), min_share=0.7)
    assert rows(got) == [(f"c{i}", 1) for i in range(8)]


def test_null_ticker_is_a_source(spark):
    data = [(f"c{i}", None, "K", "text", "same") for i in range(6)]
    assert boilerplate.repeated_lines(frame(spark, data)).count() == 6


def test_no_chunks(spark):
    df = frame(spark, [])
    assert boilerplate.repeated_lines(df).count() == 0 and boilerplate.without_repeated_lines(df).count() == 0


RECORDS = "chunk_id string, text string, term string, tf int, df int, g double, id string"


def records(spark, data):
    return spark.createDataFrame([(*r, "x", 1, 1, 0.5, "i") for r in data], RECORDS)


def brute(data):
    counts = [(c, Counter(w for w in re.findall(distinctive.WORD, t.lower()))) for c, t in dict.fromkeys(r for r in data if None not in r)]
    n, out = len(counts), []
    for c, k in counts:
        for w, tf in k.items():
            all_tf = [x[w] for _, x in counts if w in x]
            gf = sum(all_tf)
            h = -sum(x / gf * math.log(x / gf) for x in all_tf)
            g = 1.0 if n < 2 else max(0.0, min(1.0, 1 - h / math.log(n)))
            out.append((c, w, tf, len(all_tf), round(math.log(1 + tf) * g, 5)))
    return sorted(out)


def test_log_entropy(spark, rows):
    data = [("a", "Wheat wheat WHEAT harbour every record"), ("b", "every record holds harbour, harbour"), ("c", "every record"), ("c", "every record"), ("d", None), ("e", ""), (None, "wheat wheat"), ("f", "été straße wheatſ abc"), ("g", "wheat " * 50_000)]
    got = [(*r[:4], round(r[4], 5)) for r in rows(distinctive.log_entropy(records(spark, data)), "chunk_id", "term", "tf", "df", "weight")]
    want = brute(data)
    assert [x[:4] for x in got] == [x[:4] for x in want] and all(abs(x[4] - y[4]) < 2e-5 for x, y in zip(got, want))


def test_typical_terms_are_the_weighted_rows_that_fit(spark, rows):
    data = [(f"r{i}", " ".join(w * (3 + i % 2) for j, w in enumerate(("alpha ", "bravo ", "common ", "delta ", "echo ")) if i % (j + 1) == 0)) for i in range(12)]
    data += [("a", "solo solo solo twice"), ("b", "twice twice twice"), ("x", None)]
    for some in (data, data[:1], data[:2], []):
        df = records(spark, some)
        want = distinctive.log_entropy(df).filter("tf >= 3 AND df <= 3")
        assert rows(distinctive.typical_terms(df), "chunk_id", "term", "tf", "df", "weight") == rows(want, "chunk_id", "term", "tf", "df", "weight")


def test_one_and_no_record(spark, rows):
    assert rows(distinctive.log_entropy(records(spark, [("a", "wheat")])), "term", "tf") == [("wheat", 1)]
    assert distinctive.log_entropy(records(spark, [])).count() == 0


def test_question_overlap(spark):
    chunks = records(spark, [("a", "wheat harbour common"), ("b", "common rail"), ("c", "common")])
    q = spark.createDataFrame([("q1", "wheat and rail common", ["a"]), ("q1", "wheat and rail common", ["a"]), ("q2", "common", ["a", "b"]), ("q3", "unheard", None), ("q4", "", ["a"]), (None, "wheat", ["a"])], "qid string, question string, gold_chunk_ids array<string>")
    got = {(r["qid"], r["term"]): r for r in distinctive.question_overlap(q, chunks).collect()}
    assert got["q1", "wheat"]["in_gold"] and not got["q1", "rail"]["in_gold"]
    assert got["q1", "wheat"]["overlap"] == pytest.approx(0.5, abs=0.01)
    assert got["q2", "common"]["weight"] == 0 and got["q2", "common"]["overlap"] == 0
    assert got["q3", "unheard"]["overlap"] == 0 and got["q3", "unheard"]["weight"] == pytest.approx(math.log(2), abs=1e-5)
    assert {k[0] for k in got} == {"q1", "q2", "q3"}
