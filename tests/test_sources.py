import json
import re
import time

import pytest

from skerry.operators import retrieval
from skerry.plans import retrieval as plans
from skerry.sources import files, providers
from skerry.streaming import ingest

CHUNKS = [("d", f"d#{i}", "T", "Co", "10-K", "2024-01-01", "acc", "1A", None, "text", t, "T 10-K 2024", "u", len(t)) for i, t in enumerate(["net sales rose", "weather was mild “ü”", "sales of oil"])]


def test_lines_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame(CHUNKS, files.CHUNK)
    files.write_lines(df, str(tmp_path / "c"))
    raw = "".join(p.read_text() for p in (tmp_path / "c").glob("*.json"))
    assert "“ü”" in raw and '"item_title":null' in raw
    (tmp_path / "c" / "part-blank.json").write_text("\n\n")
    assert rows(files.read_lines(spark, str(tmp_path / "c"), files.CHUNK)) == rows(df)


def test_bad_lines_raise(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"qid": "a"}\n{broken\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "x.json"), "qid string").collect()


def test_questions_of_both_kinds(spark, rows, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"qid": "a", "question": "?", "concept": "C", "fiscal_year": 2022, "gold_chunk_ids": ["x"]}) + "\n")
    (tmp_path / "m.json").write_text(json.dumps({"qid": "b", "question": "?", "topic": "t", "fiscal_year": "2023", "split": "narrative"}) + "\n")
    got = files.read_questions(spark, [(str(tmp_path / "n.json"), files.NUMERIC_QUESTION), (str(tmp_path / "m.json"), files.NARRATIVE_QUESTION)])
    assert rows(got, "qid", "fiscal_year", "split", "concept", "topic") == [("a", 2022, "numeric", "C", None), ("b", 2023, "narrative", None, "t")]


def test_question_years(spark):
    cases = {"2015": 2015, "FY2015": 2015, "fiscal 2015": 2015, "FY15": 2015, "fy '15": 2015, "": None, "n/a": None, "20155": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "y string")
    assert [r[0] for r in df.select(files.question_year("y")).collect()] == list(cases.values())


def test_pages_and_documents(spark, rows, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<p>ok \xff</p>\n<p>two</p>")
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{\n "a": 1\n}')
    assert rows(files.read_pages(spark, str(tmp_path / "a.html")), "html") == [("<p>ok �</p>\n<p>two</p>",)]
    assert json.loads(files.read_documents(spark, str(tmp_path / "j")).first()["json"]) == {"a": 1}


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", 0.5, None)], "config string, ndcg double, note string")
    files.write_report(df, str(tmp_path / "r"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "r").glob("part*"))) == {"config": "x", "ndcg": 0.5, "note": None}
    assert files.markdown(df, ["config", "ndcg", "note"]) == "| config | ndcg | note |\n|---|---|---|\n| x | 0.500 |  |\n"
    with pytest.raises(ValueError):
        files.markdown(spark.range(3), ["id"], most=2)


def test_index_round_trip_and_search(spark, rows, tmp_path):
    chunks = spark.createDataFrame(CHUNKS + CHUNKS[:1], files.CHUNK)
    vectors = providers.embedded(chunks.select("chunk_id", "text").toDF("id", "text").distinct(), providers.HashEmbedder(16), "passage")
    files.Index.build(chunks, vectors, "hash").save(str(tmp_path / "i"))
    index = files.Index.load(spark, str(tmp_path / "i"))
    assert index.meta.first().asDict() == {"n_chunks": 3, "embed_model": "hash"}
    q = spark.createDataFrame([("q", "oil sales")], "qid string, question string")
    qv = providers.embedded(q.toDF("id", "text"), providers.HashEmbedder(16), "query").toDF("qid", "qvec")
    hits = plans.search(q, index, qv, k=2)
    assert [r["id"] for r in hits.orderBy("rnk").collect()][0] == "d#2" and "breadcrumb" in hits.columns
    sparse = plans.search(q, index, k=8)
    assert {r["id"] for r in sparse.collect()} == {"d#0", "d#2"}
    asked = retrieval.passages(plans.search(q, index, k=50)).join(q, "qid").select("qid", "question", "id", "passage")
    logits = providers.reranked(asked, providers.OverlapReranker())
    top = plans.search(q, index, k=1, logits=logits).first()
    assert (top["id"], top["score"]) == ("d#2", 1.0)


def test_retry():
    calls, slept = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError("no", 503)
        return "ok"

    assert providers.with_retry(flaky, providers.Retries(sleep=slept.append)) == "ok" and slept == [0.6, 1.2]
    for error in (providers.ProviderError("no", 400), ValueError("bad")):
        calls.clear()

        def failing(error=error):
            calls.append(1)
            raise error

        with pytest.raises(type(error)):
            providers.with_retry(failing, providers.Retries(sleep=slept.append))
        assert len(calls) == 1
    calls.clear()
    with pytest.raises(TimeoutError):
        providers.with_retry(lambda: (calls.append(1), (_ for _ in ()).throw(TimeoutError()))[1], providers.Retries(sleep=slept.append))
    assert len(calls) == 3


def test_deadline_abandons_the_call():
    began = time.time()
    assert providers.within(1.0, lambda: time.sleep(30)) is None
    assert time.time() - began < 5
    assert providers.within(1.0, lambda: 1 / 0) is None and providers.within(5.0, lambda: 7) == 7


def test_first_valid():
    assert providers.first_valid(["a", "b"], lambda m: m * 2, lambda x: x == "bb") == ("bb", "b")
    with pytest.raises(ValueError):
        providers.first_valid(["a"], lambda m: m, lambda x: False)


def test_ask_json():
    class Says:
        def chat(self, model, messages):
            return {"a": "nothing", "b": '```json\n{"x": 1}\n```', "c": 'so {"score": 3} it is'}[model]

    assert providers.ask_json(Says(), ["a", "b", "c"], [], lambda d: "score" in d) == ({"score": 3}, "c")
    with pytest.raises(ValueError):
        providers.ask_json(Says(), ["a"], [], lambda d: True)


def test_staged_tables_are_released(spark):
    from skerry import runtime

    df = runtime.staged(spark.range(5))
    assert df.count() == 5
    path = df.inputFiles()[0]
    assert runtime.release(spark) >= 1 and runtime.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_hot_keys(spark):
    from skerry.runtime import hot_keys

    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] + [(None,)] * 99, "k string")
    assert sorted(hot_keys(df, "k", 20)) == ["a", "b"] and hot_keys(df, "k", 60) == []
    assert hot_keys(df, "k", 20, most=2) == ["a"]


def test_throttle_and_contact():
    now, slept = [0.0], []
    t = providers.Throttle(0.15, lambda: now[0], slept.append)
    t.wait()
    t.wait()
    now[0] = 10.0
    t.wait()
    assert slept == [0.15]
    for bad in (None, "", "  "):
        with pytest.raises(ValueError):
            providers.contact(bad)


def test_fetched(spark, rows):
    urls = spark.createDataFrame([("u/1",), ("u/2",)], "url string")
    assert rows(providers.fetched(urls, lambda u, h: (200, (u + h["User-Agent"]).encode()), "me@x", 0.0)) == [("u/1", "u/1me@x"), ("u/2", "u/2me@x")]
    with pytest.raises(Exception, match="contact"):
        providers.fetched(urls, lambda u, h: (403, b""), "me@x", 0.0).collect()


def test_embedding_checks(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(70)] + [(99, None)], "id int, text string")
    with pytest.raises(ValueError):
        providers.embedded(df, providers.HashEmbedder(8), "other")
    got = {r["id"]: r["vec"] for r in providers.embedded(df, providers.HashEmbedder(8), "query", batch=32).collect()}
    assert len(got) == 71 and got[99] == [0.0] * 8 and got[1] != got[2]


def test_rerank_limit(spark):
    many = spark.createDataFrame([("q", "x", i, "p") for i in range(1001)], "qid string, question string, id int, passage string")
    with pytest.raises(Exception, match="at most 1000"):
        providers.reranked(many, providers.OverlapReranker()).collect()


def test_answers(spark, rows):
    class Echo:  # in here, so that it travels by value
        def chat(self, model, messages):
            if model == "broken":
                raise ValueError("no")
            return json.dumps({"model": model, "said": messages[0]["content"]})

    prompts = spark.createDataFrame([("1", "hello"), ("2", "fail")], "id string, prompt string")
    got = rows(providers.answered(prompts, Echo(), ["broken", "good"], lambda a: "hello" in a, seconds=5, workers=2))
    assert got == [("1", '{"model": "good", "said": "hello"}'), ("2", None)]


def test_streams(spark, rows, tmp_path):
    facts = {"facts": {"us-gaap": {"A": {"label": "a", "units": {"USD": [{"val": 1, "end": "2023-12-31", "form": "10-K", "accn": "1-1", "filed": "2024-01-01"}]}}}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"ticker": "T", "json": json.dumps(facts)}) + "\n")
    for n in (1, 2):
        ingest.append(ingest.arriving_facts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
        (tmp_path / "in" / f"{n + 1}.json").write_text(json.dumps({"ticker": f"U{n}", "json": json.dumps(facts)}) + "\n")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"doc_id": "d", "html": "<p>a</p><table><tr><td>b</td></tr></table>"}) + "\n")
    seen = []
    ingest.append(ingest.arriving_blocks(spark, str(tmp_path / "p")), "", str(tmp_path / "cp2"), each=lambda df, n: seen.extend(tuple(r) for r in df.collect())).awaitTermination()
    assert sorted(seen) == [("d", 0, "text", "a"), ("d", 1, "table", "b")]


def test_no_llm_import_in_the_core():
    from pathlib import Path

    root = Path(files.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"skerry\.llm|from skerry import llm", p.read_text()), p
