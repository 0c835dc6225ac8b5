"""Embedding providers."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.functions.vectors import DIMENSION, hash_embedding

ENDPOINT = "https://api.openai.com/v1/embeddings"
DEFAULT_MODEL = "text-embedding-3-small"
TIMEOUT_S = 45
#: Texts a request; a document's chunks need not be in one.
REQUEST_TEXTS = 256


class Provider(Protocol):
    name: str
    dimension: int

    def embed(self, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        """df with the array<float> vector of text_col."""

    def embed_one(self, spark, text: str) -> list[float]:
        """The vector of one query."""


class HashProvider:
    """Deterministic vectors from SHA-256, by built-in expressions."""

    name = "hash-local"

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension if dimension > 0 else DIMENSION

    def embed(self, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        return df.withColumn(out_col, hash_embedding(F.col(text_col), self.dimension))

    def embed_one(self, spark, text: str) -> list[float]:
        return hash_vector(text, self.dimension)


def hash_vector(text: str, dimension: int = DIMENSION) -> list[float]:
    """hash_embedding of a Python string, in the same single-precision steps."""
    import hashlib

    digest = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)
    v = np.resize(digest.astype(np.float32) / np.float32(255) * np.float32(2) - np.float32(1), dimension)
    return unit(v).tolist()


def unit(v: np.ndarray) -> np.ndarray:
    """v of length 1; squares in single precision, summed in double, in order. All zeros stay."""
    total = 0.0
    for x in (v * v).tolist():
        total += x
    return v if total == 0 else v * np.float32(1 / np.sqrt(total))


class EmbeddingServiceError(RuntimeError):
    pass


def post_json(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, bytes]:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.status, response.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


class OpenAIProvider:
    """Vectors of an embeddings service over HTTP; `post` may be replaced, for tests or another transport."""

    dimension = 0

    def __init__(self, api_key: str, model: str = DEFAULT_MODEL, post: Callable[[str, dict[str, str], bytes, float], tuple[int, bytes]] = post_json):
        self.api_key, self.model, self.post = api_key, model, post
        self.name = f"openai:{model}"

    def request(self, texts: list[str]) -> list[list[float]]:
        """One call. Vectors are placed by their index; one that is out of range is ignored, a missing one is an error."""
        if not texts:
            return []
        body = json.dumps({"model": self.model, "input": texts}).encode()
        status, raw = self.post(ENDPOINT, {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"}, body, TIMEOUT_S)
        try:
            answer = json.loads(raw)
        except ValueError as error:
            raise EmbeddingServiceError(f"decode openai embeddings response: {error}") from error
        if status >= 300:
            raise EmbeddingServiceError(f"openai embeddings error: {(answer.get('error') or {}).get('message') or status}")
        out: list[list[float] | None] = [None] * len(texts)
        for item in answer.get("data") or []:
            if 0 <= item.get("index", 0) < len(texts):
                out[item.get("index", 0)] = unit(np.array(item["embedding"], np.float32)).tolist()
        for i, v in enumerate(out):
            if v is None:
                raise EmbeddingServiceError(f"openai embeddings response missing vector at index {i}")
        return out

    def embed(self, df: DataFrame, text_col: str, out_col: str = "vector") -> DataFrame:
        columns = [c for c in df.columns if c != out_col]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), REQUEST_TEXTS):
                    part = batch.iloc[at : at + REQUEST_TEXTS]
                    yield part.assign(**{out_col: self.request(part[text_col].tolist())})

        df = df.select(*columns)
        return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out_col}` array<float>")

    def embed_one(self, spark, text: str) -> list[float]:
        return self.request([text])[0]


@dataclass(frozen=True)
class Chosen:
    provider: Provider
    source: str


def from_environment(env: dict[str, str] | None = None) -> Chosen:
    """The service if OPENAI_API_KEY is set, with the model of OPENAI_EMBED_MODEL; else hash vectors."""
    env = os.environ if env is None else env
    key = strip(env.get("OPENAI_API_KEY", ""))
    if not key:
        return Chosen(HashProvider(DIMENSION), "hash-fallback")
    return Chosen(OpenAIProvider(key, strip(env.get("OPENAI_EMBED_MODEL", "")) or DEFAULT_MODEL), "openai")
