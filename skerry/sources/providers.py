"""Model providers and the network behind protocols, with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import TRANSIENT_MESSAGE

#: What tells an error that may pass: status codes, besides all from 500 up, and words in its message (fixed values).
TRANSIENT_STATUS = (408, 429)
TRANSIENT_TEXT = re.compile(TRANSIENT_MESSAGE)
RERANK_LIMIT = 1000


class ProviderError(RuntimeError):
    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status
        self.transient = status is not None and (status in TRANSIENT_STATUS or status >= 500)


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str], input_type: str) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, passages: list[str]) -> list[float]: ...


class Chat(Protocol):
    def chat(self, model: str, messages: list[dict[str, str]]) -> str: ...


@dataclass(frozen=True)
class Retries:
    """When a call is made again: after each of ``pauses``, as long as its error is one of ``kinds``, a provider's transient one, or speaks of something that may pass."""

    pauses: tuple[float, ...] = (0.6, 1.2)
    kinds: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)
    sleep: Callable[[float], None] = time.sleep

    def hopeful(self, error: Exception) -> bool:
        known = getattr(error, "transient", None)
        return known if known is not None else isinstance(error, self.kinds) or TRANSIENT_TEXT.search(str(error)) is not None

    def run(self, call: Callable[[], Any]) -> Any:
        for pause in self.pauses:
            try:
                return call()
            except Exception as error:
                if not self.hopeful(error):
                    raise
            self.sleep(pause)
        return call()


def with_retry(call: Callable[[], Any], policy: Retries | None = None) -> Any:
    """``call()`` under a policy of retries, the usual one if none is given: three tries, 0.6 and 1.2 seconds apart."""
    return (policy or Retries()).run(call)


def within(seconds: float, call: Callable[[], Any]) -> Any:
    """``call()``, or None if it raises or takes longer; what then still runs is left behind and hinders no end of the process."""
    pool = ThreadPool(1)
    try:
        return pool.apply_async(call).get(seconds)
    except Exception:  # noqa: BLE001 - an answer that failed or is late is no answer
        return None
    finally:
        pool.close()


def first_valid(models: list[str], ask: Callable[[str], Any], valid: Callable[[Any], bool]) -> tuple[Any, str]:
    """The first model's answer that is ``valid``, and that model; the last error if none is."""
    last: Exception = ValueError("no models")
    for m in models:
        try:
            answer = ask(m)
            if valid(answer):
                return answer, m
            last = ValueError(f"{m}: answer isn't valid")
        except Exception as e:  # noqa: BLE001 - the next model is asked
            last = e
    raise last


def found_json(text: str) -> Any:
    """The first JSON value in an answer: the whole, each fenced block, the outermost braces, the outermost brackets; raises if none parses."""
    t = text.strip()
    spans = [t, *re.findall(r"(?s)```(?:json)?\s*(.*?)```", t)]
    spans += [t[t.find(a) : t.rfind(b) + 1] for a, b in ("{}", "[]") if -1 < t.find(a) < t.rfind(b)]
    for s in spans:
        try:
            return json.loads(s)
        except ValueError:
            continue
    raise ValueError(f"no JSON in {t[:100]!r}")


def ask_json(provider: Chat, models: list[str], messages: list[dict[str, str]], valid: Callable[[Any], bool]) -> tuple[Any, str]:
    """The first model's answer that holds JSON which is ``valid``, parsed, and that model."""
    return first_valid(models, lambda m: found_json(with_retry(lambda: provider.chat(m, messages))), valid)


class Throttle:
    """At least ``gap`` seconds between calls of one task."""

    def __init__(self, gap: float = 0.15, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = gap, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
            now = self.next
        self.next = now + self.gap


def contact(value: str | None) -> str:
    """The contact string a polite reader sends; raises without one."""
    if not value or not value.strip():
        raise ValueError("a contact string is needed to read from the network")
    return value


def fetched(urls: DataFrame, get: Callable[[str, dict], tuple[int, bytes]], who: str | None, gap: float = 0.15) -> DataFrame:
    """``urls(url)`` with ``body``: each task fetches its own, ``gap`` seconds apart. ``get(url, headers)`` gives status and bytes.

    A 403 raises with a hint at the contact string; any other status but 200 raises too.
    """
    headers = {"User-Agent": contact(who)}

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        throttle = Throttle(gap)
        for b in batches:
            bodies = []
            for url in b["url"]:
                throttle.wait()
                status, body = get(url, headers)
                if status != 200:
                    raise ProviderError(f"{url}: status {status}" + (": is the contact string real?" if status == 403 else ""), status)
                bodies.append(body.decode("utf-8", "replace"))
            yield pd.DataFrame({"url": b["url"], "body": bodies})

    return urls.select("url").mapInPandas(fetch, "url string, body string")


def embedded(texts: DataFrame, provider: Embedder, input_type: str, batch: int = 32) -> DataFrame:
    """``texts(id, text)`` as ``(id, vec)``, asked for ``batch`` at a time in each task; ``input_type`` is query or passage."""
    if input_type not in ("query", "passage"):
        raise ValueError(f"input_type must be query or passage, not {input_type!r}")

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list = []
            for i in range(0, len(b), batch):
                part = list(b["text"].fillna("")[i : i + batch])
                got = with_retry(lambda part=part: provider.embed(part, input_type))
                if len(got) != len(part):
                    raise ProviderError(f"{len(part)} texts, {len(got)} vectors")
                vectors.extend(got)
            yield pd.DataFrame({"id": b["id"], "vec": vectors})

    return texts.select("id", "text").mapInPandas(embed, f"id {texts.schema['id'].dataType.simpleString()}, vec array<float>")


def reranked(candidates: DataFrame, provider: Reranker) -> DataFrame:
    """``(qid, id, logit)`` of ``candidates(qid, question, id, passage)``: one call a question, of at most 1,000 passages."""

    def rerank(b: pa.Table) -> pa.Table:
        if b.num_rows > RERANK_LIMIT:
            raise ValueError(f"{b.num_rows} passages for one question; at most {RERANK_LIMIT}")
        logits = with_retry(lambda: provider.rerank(b["question"][0].as_py(), [p or "" for p in b["passage"].to_pylist()])) if b.num_rows else []
        return pa.table({"qid": b["qid"], "id": b["id"], "logit": pa.array(np.asarray(logits, dtype=float))})

    kind = candidates.schema["id"].dataType.simpleString()
    return candidates.groupBy("qid").applyInArrow(rerank, f"qid string, id {kind}, logit double")


def answered(prompts: DataFrame, provider: Chat, models: list[str], valid: Callable[[str], bool], seconds: float = 90.0, workers: int = 4) -> DataFrame:
    """``(id, answer)`` of ``prompts(id, prompt)``: the first model's valid answer within ``seconds``, else null. ``workers`` tasks ask at once."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for p in b["prompt"]:
                one = lambda m, p=p: with_retry(lambda: provider.chat(m, [{"role": "user", "content": p}]))
                got = within(seconds, lambda one=one: first_valid(models, one, valid))
                answers.append(got[0] if got else None)
            yield pd.DataFrame({"id": b["id"], "answer": answers})

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").repartition(workers).mapInPandas(ask, "id string, answer string")


class HashEmbedder:
    """A stand-in without a model: words hashed to signed dimensions. Alike for queries and passages."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.seen: dict[str, int] = {}  # a word's dimension, plus ``dim`` where its sign is negative

    def embed(self, texts: list[str], input_type: str) -> list[list[float]]:
        out = []
        for t in texts:
            found = re.findall(r"\w+", t.lower())
            if len(self.seen) > 500_000:
                self.seen.clear()
            for w in (w for w in set(found) if w not in self.seen):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                self.seen[w] = h % self.dim + (0 if h >> 63 else self.dim)
            n = np.bincount(np.array([self.seen[w] for w in found], np.int64), minlength=2 * self.dim)
            out.append((n[: self.dim] - n[self.dim :]).astype(float).tolist())
        return out


def stands_alone(word: str, text: str, inner: frozenset[str] = frozenset("abcdefghijklmnopqrstuvwxyz0123456789'")) -> bool:
    """Whether ``word`` is one of the longest runs of letters a to z, digits and apostrophes in ``text``, which begins and ends with a blank."""
    i = text.find(word)
    while i >= 0 and (text[i - 1] in inner or text[i + len(word)] in inner):
        i = text.find(word, i + 1)
    return i >= 0


class OverlapReranker:
    """A stand-in without a model: the share of the query's longer words that a passage has."""

    def rerank(self, query: str, passages: list[str]) -> list[float]:
        q = {w for w in re.findall(r"[a-z0-9']+", query.lower()) if len(w) > 3}
        # A word is looked for in the text itself and counts where it stands alone: that is faster than taking all words.
        return [sum(stands_alone(w, p) for w in q) / len(q) if q else 0.0 for p in (f" {p.lower()} " for p in passages)]
