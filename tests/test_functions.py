"""Column functions against the known literal cases and hand-computed ones."""

import json
import math

import pytest
from pyspark.sql import functions as F

from skerry.functions import chat, facts, jsonx, text, vectors


def values(spark, column, rows, schema):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize("end, year", [("2022-09-24", 2022), ("2023-09-30", 2023), ("2024-09-28", 2024), ("2026-01-25", 2026), (None, None), ("", None), ("n/a", None), ("202", None), ("2024", 2024), ("20x4-01-01", None), (" 202-01", None)])
def test_fiscal_year(spark, end, year):
    assert values(spark, facts.fiscal_year("e"), [(end,)], "e string") == [year]


def test_is_annual(spark):
    cases = [("2023-10-01", "2024-09-28", True), ("2024-06-30", "2024-09-28", False), (None, "2024-09-28", True), ("", "2024-09-28", True), ("oops", "2024-09-28", False), ("2023-10-01", None, False), ("2023/10/01", "2024.09.28", True), ("2023-02-30", "2024-09-28", False), ("2023-01-01", "2023-10-28", True), ("2023-01-01", "2023-10-27", False)]
    assert values(spark, facts.is_annual("s", "e"), [c[:2] for c in cases], "s string, e string") == [c[2] for c in cases]


def test_value_formats(spark):
    cases = {
        364980000000.0: {"364,980,000,000", "364980000000", "364,980,000", "364980000", "364,980", "364980"},
        6.11: {"6.11"}, 100.0: {"100", "100.00"}, 0.5: {"0.50"}, 0.0: {"0.00"}, 12.0: {"12.00"}, -1234.0: {"-1,234", "-1234"}, 1500.0: {"1,500", "1500"}, 0.125: {"0.12"}, 1234.5: set(), -5.0: {"-5.00"}, None: None,
    }
    got = values(spark, facts.value_formats("v"), [(v,) for v in cases], "v double")
    assert [None if g is None else set(g) for g in got] == list(cases.values())


def test_in_window(spark):
    cases = [("2024-01-01", 2024, True), ("2024-01-01", 2022, True), ("2024-01-01", 2021, False), ("2024-01-01", 2025, False), ("", 2024, None)]
    assert values(spark, facts.in_window("r", "y"), [c[:2] for c in cases], "r string, y int") == [c[2] for c in cases]


def test_tokens(spark):
    got = values(spark, text.tokens("t"), ["The company's Net-income ROSE in 2024, it's 12 up", "", None, "of the and"], "t string")
    assert got == [["company's", "net", "income", "rose", "2024", "it's"], [], None, []]


def test_index_tokens(spark):
    got = values(spark, text.index_tokens("t"), ["The Über-Größe of a_b x 12 and Ñandú", "é"], "t string")
    assert got == [["über", "größe", "a_b", "12", "ñandú"], []]


def test_overlap_tokens_and_jaccard(spark):
    assert values(spark, text.overlap_tokens("t"), ["What was what? Revenue in 2024 was up"], "t string") == [["what", "revenue", "2024"]]
    assert values(spark, text.jaccard("a", "b"), [(["x", "y"], ["y", "z"]), ([], []), (["x"], [])], "a array<string>, b array<string>") == [1 / 3, 0.0, 0.0]


def test_ngrams(spark):
    assert values(spark, text.ngrams("t", 4), [(["a", "b", "c", "d", "e"],), (["a", "b"],), ([],)], "t array<string>") == [["a b c d", "b c d e"], [], []]


def test_lines_and_cleaning(spark):
    assert values(spark, text.lines("t"), ["a\r\nb\x0bc\x85d\u2028e\n", "", "\n", "a"], "t string") == [["a", "b", "c", "d", "e"], [], [""], ["a"]]
    dirty = "Table of Contents\n  Net\xa0 sales   rose \nPAGE  12\n17\nIndex\nSee accompanying notes to all\nThe accompanying notes are\nindexes\n\n"
    assert values(spark, text.clean_text("t"), [dirty], "t string") == ["Net sales rose\nindexes"]


@pytest.mark.parametrize(
    "line, item, title",
    [("ITEM 1A. Risk Factors", "1A", "Risk Factors"), ("Item 7", "7", None), ("Item 1Business", "1B", "usiness"), ("item 7a – Market — risk.", "7A", "Market — risk"), ("The item 7 rose", None, None), ("Item 7 " + "x" * 140, None, None), ("Item 7 discusses this", "7", "discusses this"), ("Items 7", None, None)],
)
def test_headings(spark, line, item, title):
    assert values(spark, F.struct(text.heading_item("t"), text.heading_title("t")), [line], "t string") == [(item, title)]


def test_names(spark):
    row = [("ABC", "10-K", "2024-09-28", "1A", "Risk", "table"), ("ABC", "10-K", "2024-09-28", None, None, "text"), ("ABC", "10-Q", "2024-09-28", "7", None, "text")]
    schema = "ticker string, form string, report_date string, item string, title string, kind string"
    assert values(spark, text.breadcrumb("ticker", "form", "report_date", "item", "title", "kind"), row, schema) == ["ABC 10-K 2024 > Item 1A. Risk > [financial table]", "ABC 10-K 2024", "ABC 10-Q 2024 > Item 7"]
    assert values(spark, text.citation("ticker", "form", "report_date", "item"), row, schema) == ["ABC 10-K 2024, Item 1A", "ABC 10-K 2024", "ABC 10-Q 2024, Item 7"]
    assert values(spark, text.slug("ticker", "form", "report_date"), row[:1], schema) == ["ABC_10K_2024-09-28"]
    assert values(spark, text.chunk_id("d", "n"), [("x", 7)], "d string, n int") == ["x#0007"]
    assert values(spark, text.filing_url("https://h.example", "c", "a", "p"), [("0000012345", "000-11-22", "f.htm")], "c string, a string, p string") == ["https://h.example/12345/0001122/f.htm"]
    assert values(spark, text.embed_text("a", "b"), [("x", "y")], "a string, b string") == ["x\n\ny"]
    assert values(spark, text.rerank_text("a", "b"), [("x", "y")], "a string, b string") == ["x\ny"]
    assert values(spark, text.tail("a", 2), ["xyz", "x"], "a string") == ["yz", "x"]


def test_transient(spark):
    assert values(spark, text.transient_error("t"), ["HTTP 503", "read timed out", "code 15030", "bad request", None, "Service Unavailable"], "t string") == [True, True, False, False, False, True]


def test_vectors(spark):
    got = values(spark, F.struct(vectors.norm("v"), vectors.unit("v"), vectors.dot("v", "v")), [([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert got == [(5.0, [0.6, 0.8], 25.0), (0.0, [0.0, 0.0], 0.0)]


@pytest.mark.parametrize(
    "said, found",
    [
        ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": [1, 2]}\n```\nbye', {"a": [1, 2]}), ('```\nnot\n``` then ```json {"b": 2} ```', {"b": 2}), ('I think {"a": {"b": 3}} is it', {"a": {"b": 3}}),
        ("Either [1, 2] or so", [1, 2]), ("none at all", None), ("{bad} [3]", [3]), ("", None), (None, None), (" 7 ", 7), ("} {", None),
    ],
)
def test_extract_json(spark, said, found):
    got = values(spark, jsonx.extract_json("t"), [(said,)], "t string")[0]
    assert (None if got is None else json.loads(got)) == found


def test_event_stream(spark):
    d = lambda **k: "data: " + json.dumps({"choices": [{"delta": k}]})
    a = "\n".join([": hi", d(reasoning_content="think"), d(content="Hel"), "data: {broken", "data:" + d(content="lo ")[5:], "data: {}", "data: [DONE]"])
    b = "\r\n".join([d(reasoning_content="only "), d(reasoning_content="this", content="")])
    assert values(spark, jsonx.event_stream_text("t"), [a, b, "", "nothing"], "t string") == ["Hello", "only this", "", ""]


def test_directives(spark):
    m = [("nemotron-x", [("system", "S"), ("user", "U")]), ("Qwen3.5-a", [("user", "U")]), ("qwen2", [("user", "U")]), ("qwen3", [])]
    got = values(spark, chat.with_directive("m", "l"), m, f"m string, l {chat.MESSAGES}")
    assert [[tuple(x) for x in r] for r in got] == [[("system", "detailed thinking off\nS"), ("user", "U")], [("system", "/no_think"), ("user", "U")], [("user", "U")], [("system", "/no_think")]]


def test_template(spark):
    assert values(spark, chat.template('Ask {who} for {{"n": {n}}}', who="w", n="n"), [("me", 3), (None, None)], "w string, n int") == ['Ask me for {"n": 3}', 'Ask  for {"n": }']


def test_log2_is_what_metrics_use(spark):
    assert math.isclose(values(spark, F.log2("x"), [(8.0,)], "x double")[0], 3.0)


def test_large_values_keep_all_digits(spark):
    got = values(spark, facts.value_formats("v"), [(v,) for v in (1.2345678901234567e19, -9.3e18)], "v double")
    assert "12,345,678,901,234,567,168" in got[0] and "12345678901234567168" in got[0] and "-9,300,000,000,000,000,000" in got[1]
