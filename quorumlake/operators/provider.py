"""Calls to an external model, behind a provider that can be put in; the default answers offline, the same every time.

Calls run in partitions; a failed one gives NULL and its error, and is tried again a few times within the task.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import token_count
from ..tables import cut

Provider = Callable[[str], str]
Embedder = Callable[[str], list[float]]


def offline(prompt: str) -> str:
    """A deterministic stand-in for a model: a JSON answer that depends on the prompt alone."""
    return '{"label": "' + hashlib.sha256(prompt.encode()).hexdigest()[:8] + '"}'


def offline_embedding(text: str, dim: int = 16) -> list[float]:
    """A deterministic stand-in for an embedding."""
    raw = hashlib.sha256(text.encode()).digest()
    return [raw[i % len(raw)] / 127.5 - 1 for i in range(dim)]


def joined(deltas: Iterator[str]) -> str:
    """A streamed answer as one text: its deltas put together."""
    return "".join(deltas)


def stream_deltas(lines: Iterator[str]) -> Iterator[str]:
    """The content deltas of server-sent events ('data: {json}' lines), up to the end mark."""
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            return
        choice = (json.loads(body).get("choices") or [{}])[0]
        if text := (choice.get("delta") or {}).get("content"):
            yield text
        if choice.get("finish_reason"):
            return


def http_provider(url: str, model: str, key: str | None = None, stream: bool = False, temperature: float = 0.0, top_p: float = 1.0, timeout: float = 300.0) -> Provider:
    """A provider that asks a chat completion service: one POST for each prompt, the whole or the streamed answer. Failures are
    raised, so that called() tries again and keeps the error.
    """

    def ask(prompt: str) -> str:
        body = {"model": model, "messages": [{"role": "user", "content": prompt}], "stream": stream, "temperature": temperature, "top_p": top_p}
        with _post(url, body, key, timeout) as r:
            if stream:
                return joined(stream_deltas(x.decode() for x in r))
            return json.load(r)["choices"][0]["message"]["content"]

    return ask


def http_embedder(url: str, model: str, key: str | None = None, timeout: float = 300.0) -> Embedder:
    """An embedder that asks an embedding service; failures are raised."""

    def ask(text: str) -> list[float]:
        with _post(url, {"model": model, "input": [text]}, key, timeout) as r:
            return json.load(r)["data"][0]["embedding"]

    return ask


def _post(url: str, body: dict, key: str | None, timeout: float):  # noqa: ANN202
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    return urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout)


def tracked(df: DataFrame, step: str, prompt: str = "prompt", provider: Provider = offline, **how) -> tuple[DataFrame, DataFrame]:  # noqa: ANN003
    """called(), and the record (step, prompt, answer) of the calls, for token_report(). The answers are kept, so that nothing is
    asked twice.
    """
    out = cut(called(df, prompt, provider, **how))
    return out, out.select(F.lit(step).alias("step"), F.col(prompt).alias("prompt"), "answer")


def called(df: DataFrame, prompt: str = "prompt", provider: Provider = offline, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """df with answer and error: the provider's text for each prompt; after `tries` failures NULL and the last error."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers, errors = [], []
            for p in f[prompt]:
                answer, error = None, None
                for n in range(tries):
                    try:
                        answer, error = provider(p), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < tries:
                            time.sleep(wait)
                answers.append(answer)
                errors.append(error)
            yield f.assign(answer=answers, error=errors)

    return df.mapInPandas(run, schema)


def embedded(texts: DataFrame, store: DataFrame, embedder: Embedder = offline_embedding, key: str = "query", tries: int = 3, wait: float = 1.0) -> DataFrame:
    """The store with an embedding for every text: distinct lower-cased texts it lacks are sent once each; what fails `tries`
    times stays out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for t in f[key]:
                got = None
                for n in range(tries):
                    try:
                        got = embedder(t)
                        break
                    except Exception:  # noqa: BLE001
                        if n + 1 < tries:
                            time.sleep(wait)
                out.append(got)
            yield pd.DataFrame({key: f[key], "embedding": out})

    missing = texts.where(F.col(key).isNotNull()).select(F.lower(key).alias(key)).distinct().join(store.select(key), key, "left_anti")
    new = missing.mapInPandas(run, f"{key} string, embedding array<double>").where("embedding is not null")
    return store.select(key, "embedding").unionByName(new)


def token_report(calls: DataFrame, step: str = "step", prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Tokens in and out and calls per step, and in all (step 'total')."""
    t = calls.select(step, token_count(F.col(prompt)).alias("i"), token_count(F.col(answer)).alias("o"))
    return t.rollup(step).agg(F.sum("i").alias("input"), F.sum("o").alias("output"), F.count(F.lit(1)).alias("calls")).select(F.coalesce(step, F.lit("total")).alias(step), "input", "output", "calls")
