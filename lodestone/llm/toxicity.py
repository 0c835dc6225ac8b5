"""Operator 3: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import read
from .textvec import distinct, mix64, slices, words

BITS = 24
#: At most so many labelled rows are fitted, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.0
THRESHOLD = 0.25
#: (distance to the next word, ...) of each feature: words, n-grams of 2 and 3, skip-grams over one and two words.
GRAMS = ((), (1,), (1, 2), (2,), (3,))
#: Bytes of text whose features are held at a time.
_SLICE = 300_000


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every n-gram and skip-gram, with repetitions, type by type."""
    row, h = words(texts)
    rows, found = [], []
    for kind, gaps in enumerate(GRAMS):
        reach = max(gaps, default=0)
        n = len(h) - reach
        if n <= 0:
            continue
        x = h[:n] * np.uint64(2 * kind + 1)
        for g in gaps:
            x = x * np.uint64(0x100000001B3) + h[g : g + n]
        inside = row[:n] == row[reach:]
        rows.append(row[:n][inside])
        found.append((mix64(x[inside], kind) >> np.uint64(64 - bits)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Examples:
    """(distinct features, 0 or 1) of each row of batches (order, 0 or 1, text), as often as they are asked for; only the texts are held, for their features take several times as much."""

    def __init__(self, batches, bits: int = BITS):
        self.batches, self.bits = [b for b in batches if b.num_rows], bits

    def both(self) -> bool:
        return len({y for b in self.batches for y in pc.unique(b.column(1)).to_pylist()}) == 2

    def __iter__(self):
        for batch in self.batches:
            y = batch.column(1).to_pylist()
            for start, texts in slices(batch.column(2), _SLICE):
                row, x = features(texts, self.bits)
                pair = distinct(row << self.bits | x)
                cut = np.searchsorted(pair >> self.bits, np.arange(len(texts) + 1))
                pair &= (1 << self.bits) - 1
                yield from ((pair[cut[i] : cut[i + 1]], y[start + i]) for i in range(len(texts)))


def fit(examples, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over examples [(distinct features, 0 or 1)], gone through once an epoch: (indices, weights) that L1 left; index `size` is the bias."""
    z, n = np.zeros(size + 1, np.float32), np.zeros(size + 1, np.float32)
    for _ in range(epochs):
        for x, y in examples:
            i = np.r_[x, size]
            zi, ni = z[i].astype(float), n[i].astype(float)
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[i] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * w
            n[i] = ni + g * g
    i = np.flatnonzero((z > l1) | (z < -l1))
    zi = z[i].astype(float)
    return i, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i].astype(float))) / alpha + l2)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights fitted on at most train_rows labelled documents, in one task (FTRL is sequential).

    An id labelled more than once counts once, as toxic if any label says so; null ids, labels and texts
    are left out. Without both classes there are no weights.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = chosen.withColumn("__order", F.xxhash64(id_col)).orderBy("__order", id_col).limit(train_rows)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).filter("__text is not null").join(F.broadcast(chosen), id_col)  # bounded by train_rows
    rows = rows.select("__order", "__y", "__text").repartition(1).sortWithinPartitions("__order", F.xxhash64("__text"))

    def run(batches):
        examples = Examples(batches, bits)
        if examples.both():
            i, w = fit(examples, 1 << bits)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w)], ["i", "w"])

    found = rows.mapInArrow(run, "i long, w double").toPandas()
    return found["i"].to_numpy(), found["w"].to_numpy()


def score(df: DataFrame, weights: tuple[np.ndarray, np.ndarray], text_col: str = "text", bits: int = BITS, threshold: float = THRESHOLD, score_col: str = "toxicity", flag_col: str = "is_toxic", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the probability that its text is toxic, and whether that reaches the threshold.

    Each distinct feature of a text counts once, so the length of the text doesn't matter. Runs inside the
    partitions, with no shuffle; the sparse weights travel with the task. A null text has a null score and
    isn't toxic; an empty one has the score of the bias alone. Without weights all scores are 0. Columns
    named as an output are replaced; those in `drop` aren't returned.
    """
    df = df.drop(*(c for c in df.columns if c in (score_col, flag_col)))
    kept = [c for c in df.columns if c not in drop]
    at, out = df.columns.index(text_col), [df.columns.index(c) for c in kept]
    order = np.argsort(weights[0])
    index, weight = np.asarray(weights[0], np.int64)[order], np.asarray(weights[1], float)[order]
    bias = float(weight[-1]) if len(index) and index[-1] == 1 << bits else 0.0

    def run(batches):
        known = np.zeros((1 << bits) + 1, bool)
        known[index] = True
        for batch in batches:
            total = np.full(batch.num_rows, bias)
            for start, texts in slices(batch.column(at), _SLICE):
                row, x = features(texts, bits)
                hit = known[x]
                pair = distinct(row[hit] << bits | x[hit])
                w = weight[np.searchsorted(index, pair & ((1 << bits) - 1))]
                total[start : start + len(texts)] += np.bincount(pair >> bits, w, len(texts))
            p = 1 / (1 + np.exp(-np.clip(total, -700, 700))) if len(index) else np.zeros(batch.num_rows)
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(p, mask=null), pa.array((p >= threshold) & ~null & bool(len(index)))], [*kept, score_col, flag_col])

    return df.mapInArrow(run, df.select(*kept).schema.add(score_col, "double").add(flag_col, "boolean"))


def toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, read(spark, sf_dir, "labels")), drop=("text",))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go. The model is fitted on `docs` and the labels. Null and empty texts stay, as score has them."""
    weights = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, weights).filter(~F.col("is_toxic")).select(*docs.columns)
