import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from skerry.__main__ import main
from skerry.sources import clients, providers

DATA = "/root/testdata/sf0.001"


class Handler(BaseHTTPRequestHandler):
    seen: list = []

    def log_message(self, *a):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        Handler.seen.append((self.path, self.headers.get("User-Agent")))
        if self.path.startswith("/old"):
            self.answer(302, Location=self.path.replace("/old", "/new"))
        elif self.path.startswith("/forbidden"):
            self.answer(403)
        else:
            self.answer(200, b"page \xff " + self.path.encode())

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/embed":
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            self.answer(200, json.dumps({"data": data[::-1]}).encode())
        elif self.path == "/rerank":
            self.answer(200, json.dumps({"rankings": [{"index": i, "logit": -float(i)} for i in range(len(body["passages"]) - 1, -1, -1)]}).encode())
        elif self.path == "/chat":
            parts = ["Hel", "lo ", body["messages"][0]["content"]]
            events = [": open", "data: {bad", *("data: " + json.dumps({"choices": [{"delta": {"content": p, "reasoning_content": "hm"}}]}) for p in parts), "data: [DONE]"]
            self.answer(200, "\n\n".join(events).encode())
        elif self.path == "/thinking":
            self.answer(200, b'data: {"choices": [{"delta": {"reasoning_content": "hm"}}]}\n\ndata: {"choices": []}\n')
        else:
            self.answer(503, b"overload")


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_followed_and_kept(spark, base, tmp_path):
    assert clients.get(f"{base}/old/a", {"User-Agent": "me"}) == (200, b"page \xff /new/a")
    assert clients.get(f"{base}/forbidden", {})[0] == 403
    wanted = spark.createDataFrame([("a", f"{base}/old/a"), ("b", f"{base}/b"), ("a", f"{base}/old/a")], "key string, url string")
    Handler.seen.clear()
    first = {r["key"]: r["body"] for r in clients.cached(spark, wanted, str(tmp_path / "kept"), "me@example.org", gap=0.0).collect()}
    assert first == {"a": "page \ufffd /new/a", "b": "page \ufffd /b"} and {w for _, w in Handler.seen} == {"me@example.org"}
    n = len(Handler.seen)
    more = wanted.union(spark.createDataFrame([("c", f"{base}/c")], "key string, url string"))
    assert clients.cached(spark, more, str(tmp_path / "kept"), "me@example.org", gap=0.0).count() == 3
    assert len(Handler.seen) == n + 1
    with pytest.raises(ValueError):
        clients.cached(spark, more.filter("false"), str(tmp_path / "kept"), None)


def test_models_over_http(spark, base):
    e = clients.HttpEmbedder(f"{base}/embed", "m", "k", dim=2)
    assert e.embed(["abc", "d"], "query") == [[3.0, 1.0], [1.0, 1.0]]
    texts = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id int, text string")
    assert sorted(r["vec"][0] for r in providers.embedded(texts, e, "passage", batch=2).collect()) == [0, 1, 2, 3, 4]
    r = clients.HttpReranker(f"{base}/rerank", "m")
    assert r.rerank("q", ["a", "b"]) == [0.0, -1.0] and r.rerank("q", []) == []
    with pytest.raises(ValueError):
        r.rerank("q", ["a"] * 1001)
    assert clients.HttpChat(f"{base}/chat").chat("m", [{"role": "user", "content": "you"}]) == "Hello you"
    assert clients.HttpChat(f"{base}/thinking").chat("m", []) == "hm"
    with pytest.raises(providers.ProviderError) as err:
        clients.HttpChat(f"{base}/down").chat("m", [])
    assert err.value.status == 503 and err.value.transient and "k" not in repr(e.key and e)[-20:]


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("SKERRY_DATA", DATA)
    main(["build-index", "--out", str(tmp_path / "index")], spark)
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"chunks", "vectors", "postings", "lengths", "terms", "meta"}
    main(["evaluate", "--out", str(tmp_path / "result"), "--limit", "5"], spark)
    line = "".join(p.read_text() for p in (tmp_path / "result").glob("part*"))
    assert json.loads(line)["n_questions"] == 5 and "Hybrid (RRF)" in capsys.readouterr().out
    main(["eval-set", "--out", str(tmp_path / "numeric")], spark)
    main(["weights", "--out", str(tmp_path / "weights")], spark)
    with pytest.raises(SystemExit):
        main(["eval-set", "--kind", "narrative", "--out", str(tmp_path / "narrative")], spark)
    with pytest.raises(SystemExit):
        main(["sweep"], spark)
