"""Clients over HTTP: pages, embeddings, reranking and streamed chat, behind the protocols of ``providers``."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from skerry.sources.providers import RERANK_LIMIT, ProviderError, fetched


def get(url: str, headers: dict[str, str], timeout: float = 60.0) -> tuple[int, bytes]:
    """Status and bytes of a page, after redirects; the shape that ``providers.fetched`` asks for."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def cached(spark: SparkSession, wanted: DataFrame, path: str, who: str | None, getter=get, gap: float = 0.15) -> DataFrame:
    """``(key, body)`` of ``wanted(key, url)``: what the table at ``path`` lacks is fetched and appended to it, so each key is fetched once.

    Filings go by their slug, facts by their company's number. Undecodable bytes are replaced. A page
    that fails raises, and what was appended before stays.
    """
    shape = "key string, body string"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], shape).write.parquet(path)
    asked = wanted.select("key", "url").dropDuplicates(["key"])
    missing = asked.join(spark.read.schema(shape).parquet(path).select("key"), "key", "left_anti")
    new = fetched(missing, getter, who, gap).join(missing, "url").select("key", "body")
    new.write.mode("append").parquet(path)
    return spark.read.schema(shape).parquet(path).join(asked.select("key"), "key", "left_semi").dropDuplicates(["key"])


@dataclass
class Service:
    """A provider's address, the model asked for and the key that opens it."""

    url: str
    model: str = ""
    key: str = field(default="", repr=False)
    timeout: float = 60.0

    def sent(self, body: dict[str, Any]):
        """The open answer to a body posted as JSON; a status that is an error raises with it."""
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        try:
            return urllib.request.urlopen(urllib.request.Request(self.url, json.dumps(body).encode(), headers), timeout=self.timeout)
        except urllib.error.HTTPError as e:
            raise ProviderError(f"status {e.code}: {e.read()[:300].decode('utf-8', 'replace')}", e.code) from e

    def asked(self, body: dict[str, Any]) -> Any:
        with self.sent(body) as answer:
            return json.load(answer)


@dataclass
class HttpEmbedder(Service):
    dim: int = 0

    def embed(self, texts: list[str], input_type: str) -> list[list[float]]:
        """Vectors in the order of ``texts``, whatever order the answer has; texts too long are cut at their end by the provider."""
        data = self.asked({"model": self.model, "input": texts, "input_type": input_type, "truncate": "END"})["data"]
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]


class HttpReranker(Service):
    def rerank(self, query: str, passages: list[str]) -> list[float]:
        """A logit for each passage, as the provider gives it; a passage it leaves out comes last."""
        if len(passages) > RERANK_LIMIT:
            raise ValueError(f"{len(passages)} passages for one question; at most {RERANK_LIMIT}")
        if not passages:
            return []
        got = self.asked({"model": self.model, "query": {"text": query}, "passages": [{"text": p} for p in passages], "truncate": "END"})
        logit = {r["index"]: float(r["logit"]) for r in got["rankings"]}
        return [logit.get(i, float("-inf")) for i in range(len(passages))]


def deltas(lines: Iterable[bytes]) -> Iterator[dict[str, Any]]:
    """The parts of a streamed answer; lines that aren't data or JSON are passed over."""
    for raw in lines:
        kind, _, data = raw.decode("utf-8", "replace").strip().partition(":")
        if kind == "data" and data.strip() != "[DONE]":
            try:
                yield from (c.get("delta") or {} for c in json.loads(data).get("choices") or [])
            except (ValueError, AttributeError):
                continue


class HttpChat(Service):
    def chat(self, model: str, messages: list[dict[str, str]]) -> str:
        """The answer put together from its stream: its content, else its reasoning; an answer of nothing raises."""
        said: dict[str, list[str]] = {"content": [], "reasoning_content": []}
        with self.sent({"model": model or self.model, "messages": messages, "stream": True}) as answer:
            for d in deltas(answer):
                for k, parts in said.items():
                    parts.append(d.get(k) or "")
        text = "".join(said["content"]).strip() or "".join(said["reasoning_content"]).strip()
        if not text:
            raise ProviderError("an answer without text")
        return text
