"""Embedders, as functions from chunks to vectors.

The hash embedder stays in the JVM and keeps integer bucket counts, so that equal texts
have a cosine of exactly 1 and ties are ties.  Models and services run as Arrow iterators,
one instance for a Python worker.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.functions import text as X

KEY = ("doc_id", "granularity", "index")


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def hash_features(chunks: DataFrame, dim: int = 1024) -> DataFrame:
    """The non-zero buckets (bucket, v) of each chunk's signed token counts."""
    t = chunks.select(*KEY, F.explode(X.tokens("text")).alias("token"))
    # equal tokens of a chunk are counted before they are hashed and shuffled
    h = F.crc32(F.encode("token", "UTF-8"))
    signed = F.when(F.shiftright(h, 16).bitwiseAND(F.lit(1)) == 1, F.lit(1)).otherwise(F.lit(-1))
    return t.groupBy(*KEY, (h % dim).cast("int").alias("bucket")).agg(F.sum(signed).alias("v")).where("v <> 0")


def dense(chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Chunks with an embedding column by a model or service; make runs once for a worker."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = make()
        for b in batches:
            yield pd.Series(e.embed(b.tolist()) if len(b) else [], dtype="object")

    return chunks.withColumn("embedding", run("text"))


class SentenceModel:
    """A sentence-transformers model, loaded at first use, vectors of length 1."""

    def __init__(self, model: str = "all-MiniLM-L6-v2") -> None:
        self.name, self._id, self._model = f"local:{model}", model, None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self._model is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise RuntimeError("the local embedder needs the package sentence-transformers") from e
            self._model = SentenceTransformer(self._id)
        return [list(map(float, v)) for v in self._model.encode(texts, normalize_embeddings=True)]


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as r:
        return json.load(r)


class HttpEmbedder:
    """Batches of texts to a service; the answer's order is kept.  Keys come from the worker's environment only."""

    BATCH, TIMEOUT = 128, 60.0

    def __init__(self, name: str, url: str, key_variable: str, model: str, post: Callable = post_json) -> None:
        if not os.environ.get(key_variable):
            raise RuntimeError(f"{name} needs {key_variable} in the environment")
        self.name, self._url, self._variable, self._model, self._post = f"{name}:{model}", url, key_variable, model, post

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.BATCH):
            body = {"model": self._model, "input": texts[i : i + self.BATCH]}
            got = self._post(self._url, body, {"authorization": f"Bearer {os.environ[self._variable]}"}, self.TIMEOUT)
            out += [d["embedding"] for d in got["data"]]
        return out


#: fixed values: services, their keys' variables and default models
SERVICES = {
    "openai": ("https://api.openai.com/v1/embeddings", "OPENAI_API_KEY", "text-embedding-3-small"),
    "voyage": ("https://api.voyageai.com/v1/embeddings", "VOYAGE_API_KEY", "voyage-3"),
}


def embedder(backend: str, model: str | None = None) -> Callable[[], Embedder] | None:
    """E5: a maker of the backend's embedder; None: hash, which needs no Python."""
    if backend == "hash":
        return None
    if backend == "local":
        return lambda: SentenceModel(model or "all-MiniLM-L6-v2")
    if backend in SERVICES:
        url, variable, default = SERVICES[backend]
        HttpEmbedder(backend, url, variable, model or default)  # a missing key is reported here, not by a task
        return lambda: HttpEmbedder(backend, url, variable, model or default)
    raise ValueError(f"unknown embed backend: {backend!r}")


def embedder_name(backend: str, model: str | None, dim: int = 1024) -> str:
    default = {"local": "all-MiniLM-L6-v2", **{k: v[2] for k, v in SERVICES.items()}}
    return f"hash:{dim}" if backend == "hash" else f"{backend}:{model or default.get(backend, '')}"
