"""Embedding providers, and a column function that calls one in Arrow batches.

A provider is any object with `documents(list[str])` and `query(str)` that gives vectors; it may
have `batch_texts`, the texts of one call. The HTTP ones take a transport, so that nothing here needs a network.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts and characters of one request.
BATCH_TEXTS = 50
BATCH_CHARS = 240_000
#: Statuses after which a request is tried again.
RETRIED = {408, 429, 500, 502, 503, 504}


class Provider(Protocol):
    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class HttpError(Exception):
    """A provider's answer other than success; `kind` says what it means."""

    def __init__(self, status: int, body: str = ""):
        super().__init__(f"status {status}: {body[:200]}")
        self.status = status

    @property
    def kind(self) -> str:
        known = {400: "bad request", 401: "not authorised", 429: "too many requests"}
        return known.get(self.status, "server error" if self.status >= 500 else "error")


Transport = Callable[[str, dict, dict], dict]


def http_post(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=60) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        raise HttpError(e.code, e.read().decode(errors="replace")) from e
    except urllib.error.URLError as e:  # refused, unreachable, no such host
        raise ConnectionError(str(e.reason)) from e


def with_retries(call: Callable[[], dict], attempts: int = 4, base_seconds: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """call(), again after base * 2**n seconds on passing errors and time-outs."""
    for n in range(attempts):
        try:
            return call()
        except (HttpError, TimeoutError, ConnectionError) as e:
            if n == attempts - 1 or isinstance(e, HttpError) and e.status not in RETRIED:
                raise
            sleep(base_seconds * 2**n)
    raise AssertionError


@dataclass
class HashEmbedder:
    """Deterministic vectors without a model: signed sums of hashed words, of unit length."""

    dimension: int = 64

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dimension)
        for w in text.lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "little") % self.dimension] += 1 if h[4] & 1 else -1
        size = np.linalg.norm(v)
        return (v / size if size else v).astype(np.float32).tolist()

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def query(self, text: str) -> list[float]:
        return self._one(text)


@dataclass
class OpenAiStyle:
    """POST {base}/v1/embeddings with model and input; queries may be wrapped in an instruction."""

    base: str
    model: str
    key: str = ""
    instruction: str = ""
    transport: Transport = http_post
    attempts: int = 4

    def _call(self, texts: list[str]) -> list[list[float]]:
        head = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        got = with_retries(lambda: self.transport(f"{self.base.rstrip('/')}/v1/embeddings", head, {"model": self.model, "input": texts}), self.attempts)
        return [d["embedding"] for d in got["data"]]

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._call(texts)

    def query(self, text: str) -> list[float]:
        return self._call([f"Instruct: {self.instruction}\nQuery: {text}" if self.instruction else text])[0]


@dataclass
class VoyageStyle:
    """Requests that name the input's kind, and the vectors' dimension and type; 1000 texts at most."""

    base: str
    model: str
    key: str = ""
    dimension: int = 2048
    transport: Transport = http_post
    extra: dict = field(default_factory=lambda: {"output_dtype": "float", "truncation": True})
    attempts: int = 4

    def _call(self, texts: list[str], kind: str) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), 1000):
            body = {"model": self.model, "input": texts[i : i + 1000], "input_type": kind, "output_dimension": self.dimension} | self.extra
            got = with_retries(lambda body=body: self.transport(f"{self.base.rstrip('/')}/v1/embeddings", {"Authorization": f"Bearer {self.key}"}, body), self.attempts)
            out += [d["embedding"] for d in sorted(got["data"], key=lambda d: d.get("index", 0))]
        return out

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._call(texts, "document")

    def query(self, text: str) -> list[float]:
        return self._call([text], "query")[0]


def packed(texts: list[str], most: int = BATCH_TEXTS, chars: int = BATCH_CHARS) -> Iterator[list[str]]:
    """Greedy batches in order; a text longer than a batch goes alone."""
    batch, size = [], 0
    for t in texts:
        if batch and (len(batch) >= most or size + len(t) > chars):
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def embed(text: Column, provider: Provider, dimension: int) -> Column:
    """Vectors of a text column; null where the provider failed for the batch or gave another
    dimension, so failures can be set aside and don't count as done."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            for batch in packed(part.fillna("").tolist(), getattr(provider, "batch_texts", BATCH_TEXTS)):
                try:
                    out += [v if len(v) == dimension else None for v in provider.documents(batch)]
                except (HttpError, TimeoutError, ConnectionError):
                    out += [None] * len(batch)
            yield pd.Series(out, index=part.index)

    return run(text)


def to_bytes(vector: list[float]) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(vector, "<f4").tobytes()


def from_bytes(data: Column, half: bool = False) -> Column:
    """Packed little-endian floats of 32 (or 16) bits as an array."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f2" if half else "<f4").astype(np.float32))

    return run(data)


def rounded_to_half(vector: Column) -> Column:
    """Components rounded to 16-bit floats."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return run(vector)
