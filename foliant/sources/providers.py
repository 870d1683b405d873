"""What a deployment plugs in: recognition, embeddings, reranking, a language model; with offline stand-ins."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class Rejected(Exception):
    """The service refuses the request itself; trying again won't help."""


def with_retries(call: Callable, tries: int = 3, waits: Iterable[float] = (1, 2), sleep: Callable[[float], None] = time.sleep):
    """call(), again after failures that may pass."""
    waits = iter(waits)
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Rejected:
            raise
        except Exception:
            if not left:
                raise
            sleep(next(waits, 0))


class Breaker:
    """Leaves a failing service alone for a while."""

    def __init__(self, seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.until = seconds, clock, -math.inf

    def call(self, f: Callable):
        if self.clock() < self.until:
            return None
        try:
            return f()
        except Exception:
            self.until = self.clock() + self.seconds
            return None


class HashEmbedder:
    """Unit vectors by hashed words; for tests and offline use."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.size
            for w in t.lower().split() or [""]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


def embedded(units: DataFrame, embedder: Embedder, batch: int = 16, failing: bool = False) -> DataFrame:
    """units: id (of any type), text -> id, v, in batches of the service's size. failing: a batch that fails has an error, cut to 500 characters, instead of stopping the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part, error = f.iloc[i : i + batch], None
                try:
                    vectors = with_retries(lambda: embedder.embed(part["text"].tolist()))
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:
                    if not failing:
                        raise
                    vectors, error = [None] * len(part), str(e)[:500]
                yield pd.DataFrame({"id": part["id"].tolist(), "v": vectors, **({"error": [error] * len(part)} if failing else {})})

    return units.select("id", "text").mapInPandas(run, f"id {units.schema['id'].dataType.simpleString()}, v array<float>{', error string' if failing else ''}")


def stream_events(lines: Iterable[str]) -> Iterator[tuple[str, int, int]]:
    """Server-sent events of a chat: (text so far, characters of text, characters of thought) after each."""
    text, thought = "", 0
    for line in lines:
        if not line.startswith("data:"):
            continue
        body = line[5:].strip()
        if body == "[DONE]":
            return
        delta = (json.loads(body).get("choices") or [{}])[0].get("delta") or {}
        text += delta.get("content") or ""
        thought += len(delta.get("reasoning_content") or "")
        yield text, len(text), thought
