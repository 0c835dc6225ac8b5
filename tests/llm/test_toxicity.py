"""Operator 3."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import toxicity as T

WORDS = [f"w{i}" for i in range(300)]
BAD = ["vile", "scum", "rot", "filth"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(WORDS, k=rng.randint(20, 80))
        if toxic:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus(800, 1)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return T.train(docs, labels)


def test_features_are_words_ngrams_and_skipgrams_of_one_text():
    row, x = T.features(pa.array(["a b c d", "", None, "A, b"]))
    count = np.bincount(row, minlength=4)
    assert count.tolist() == [4 + 3 + 2 + 2 + 1, 0, 0, 2 + 1]
    assert set(x[row == 3]) <= set(x[row == 0])


def test_fit_equals_the_formulas_one_coordinate_at_a_time():
    rng = np.random.default_rng(3)
    examples = [(np.unique(rng.integers(0, 30, 8)), int(rng.random() < 0.5)) for _ in range(60)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    z, n, w = [0.0] * 31, [0.0] * 31, [0.0] * 31
    for _ in range(2):
        for x, y in examples:
            at = [*x.tolist(), 30]
            for i in at:
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-sum(w[i] for i in at))) - y
            for i in at:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
    want = {i: -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2) for i in range(31) if abs(z[i]) > l1}
    index, weight = T.fit(examples, 30, 2, alpha, beta, l1, l2)
    assert set(index.tolist()) == set(want)
    assert np.allclose(weight, [want[i] for i in index.tolist()], atol=1e-4)


def test_fitting_holds_the_texts_and_not_their_features():
    rows = corpus(8000, 7)
    batches = [pa.record_batch([pa.array(range(i, i + 500)), pa.array([y for _, _, y in rows[i : i + 500]], pa.int32()), pa.array([x for _, x, _ in rows[i : i + 500]])], ["o", "y", "x"]) for i in range(0, 8000, 500)]
    peak = []
    for n in (1, 4, 16):  # the first sets up what stays
        tracemalloc.start()
        got = T.fit(T.Examples(iter(batches[:n]), 18), 1 << 18)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    held = [(np.unique(T.features(pa.array([x]), 18)[1]).astype(np.int32), y) for _, x, y in rows]
    assert peak[2] - peak[1] < 0.5 * sum(x.nbytes for x, _ in held[2000:])
    want = T.fit(held, 1 << 18)
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_held_out_accuracy(spark, model):
    rows = corpus(400, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = T.score(df, model).collect()
    assert np.mean([r["is_toxic"] == bool(r["y"]) for r in got]) > 0.97
    assert len(model[0]) < 2000  # L1 leaves few


def test_planted_labels_of_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    labels = labels.withColumn("held", F.xxhash64("doc_id", F.lit(5)) % 4 == 0)
    got = T.score(docs, T.train(docs, labels.filter("not held"))).join(labels.filter("held"), "doc_id").groupBy("toxic", "is_toxic").count().collect()
    n = {(r["toxic"], r["is_toxic"]): r["count"] for r in got}
    assert n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)) > 0.8  # with 3,000 examples; with 12,000 it is 0.99
    assert n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0)) > 0.99


def test_odd_rows(spark, model):
    long = "vile scum filth rot " * 200_000
    rows = [(1, None, "x", 0.5), (2, "", "x", 0.5), (3, "!!! ...", None, None), (4, long, "x", 1.0), (4, long, "x", 1.0), (None, "vile scum", "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_toxic string, toxicity double")
    got = T.score(df, model).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"doc_id", "text", "toxicity", "is_toxic"}
    by = {(r["doc_id"], r["text"] is None): r for r in got}
    assert by[1, True]["toxicity"] is None and by[1, True]["is_toxic"] is False
    assert by[2, False]["toxicity"] == by[3, False]["toxicity"] and not by[2, False]["is_toxic"]
    assert [r["toxicity"] for r in got if r["doc_id"] == 4] == [by[4, False]["toxicity"]] * 2 and by[4, False]["is_toxic"]
    assert T.score(df.limit(0), model).count() == 0
    assert T.score(df, model, drop=("text",)).columns == ["doc_id", "toxicity", "is_toxic"]


def test_without_both_classes_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([(1, 1)], []):
        weights = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [(r["toxicity"], r["is_toxic"]) for r in T.score(docs, weights).collect()] == [(0.5, False)] * 2 or len(weights[0]) == 0


def test_training_is_bounded_and_repeatable(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").repartition(5)
    a, b = T.train(docs, labels, train_rows=100), T.train(docs.repartition(3), labels, train_rows=100)
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
