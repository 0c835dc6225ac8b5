"""Embedding providers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.embedding import EmbeddingServiceError, HashProvider, OpenAIProvider, from_environment, hash_vector, unit
from lodestone.functions.vectors import cosine, hash_embedding, l2_normalize


def answer(status, payload):
    return lambda url, headers, body, timeout: (status, json.dumps(payload).encode())


def test_choice_by_environment():
    assert from_environment({}).source == "hash-fallback" and from_environment({"OPENAI_API_KEY": "  "}).provider.dimension == 256
    chosen = from_environment({"OPENAI_API_KEY": "k", "OPENAI_EMBED_MODEL": " m "})
    assert chosen.source == "openai" and chosen.provider.name == "openai:m"
    assert from_environment({"OPENAI_API_KEY": "k"}).provider.name == "openai:text-embedding-3-small"


def test_expressions_equal_single_precision_python(spark):
    texts = ["alpha", "alpha", "beta", "", "é😀"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    for d in (8, 32, 40, 256):
        got = [r[0] for r in rows.select(hash_embedding(F.col("t"), d)).collect()]
        assert got == [hash_vector(t, d) for t in texts]
        assert got[0] == got[1] != got[2] and len(got[0]) == d
    assert HashProvider(0).dimension == 256


def test_zero_vectors_stay(spark):
    row = spark.range(1).select(l2_normalize(F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))).first()
    assert list(row) == [[0.0, 0.0], 0.0, 0.0] and unit(np.zeros(2, np.float32)).tolist() == [0, 0]


def test_service_places_vectors_by_index(spark):
    p = OpenAIProvider("k", post=answer(200, {"data": [{"index": 1, "embedding": [0, 2]}, {"index": 0, "embedding": [3, 0]}, {"index": 9, "embedding": [1, 1]}]}))
    assert p.request(["a", "b"]) == [[1, 0], [0, 1]] and p.request([]) == []


def test_service_errors():
    with pytest.raises(EmbeddingServiceError, match="bad key"):
        OpenAIProvider("k", post=answer(400, {"error": {"message": "bad key"}})).request(["a"])
    with pytest.raises(EmbeddingServiceError, match="missing vector at index 1"):
        OpenAIProvider("k", post=answer(200, {"data": [{"index": 0, "embedding": [1]}]})).request(["a", "b"])
    with pytest.raises(EmbeddingServiceError, match="decode"):
        OpenAIProvider("k", post=lambda *a: (200, b"<html>")).request(["a"])


def test_service_over_a_column(spark):
    def post(url, headers, body, timeout):
        texts = json.loads(body)["input"]
        return 200, json.dumps({"data": [{"index": i, "embedding": [len(t), 0.0]} for i, t in enumerate(texts)]}).encode()

    rows = OpenAIProvider("k", post=post).embed(spark.createDataFrame([("a", "x"), ("b", "yy")], "id string, t string"), "t").collect()
    assert sorted((r["id"], list(r["vector"])) for r in rows) == [("a", [1.0, 0.0]), ("b", [1.0, 0.0])]
