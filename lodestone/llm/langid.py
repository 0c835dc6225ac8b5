"""Operator 7: language identification with hyperdimensional profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import read
from .textvec import runs, slices

DIMENSIONS = 1024
#: At most so many labelled documents make the prototypes, those with the smallest hash of their id.
TRAIN_ROWS = 8_000
SEED = 7
SYMBOLS = 64
BLOCK_ROWS = 256


def symbols() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, 1-26 for a-z, 27-63 for other letters (several share one)."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha() and not 0xD800 <= c < 0xE000:
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return table


def letters(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """A random vector of +1 and -1 for each symbol."""
    return np.random.default_rng(seed).integers(0, 2, (SYMBOLS, dimensions)).astype(np.int8) * 2 - 1


def bind(grams: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the first letter's vector permuted twice, the second's once, multiplied by the third's."""
    a, b, c = grams // SYMBOLS**2, grams // SYMBOLS % SYMBOLS, grams % SYMBOLS
    return np.roll(letter, 2, 1)[a] * np.roll(letter, 1, 1)[b] * letter[c]


def trigrams(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram, count), sorted; a text begins after a non-letter, runs of non-letters count as one, and trigrams without a letter don't count."""
    joined = "".join("\x00" + (t or "") for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    row = np.cumsum(code == 0) - 1  # a NUL inside a text is made a space below
    if len(row) and row[-1] != len(texts) - 1:
        joined = "".join("\x00" + (t or "").replace("\x00", " ") for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        row = np.cumsum(code == 0) - 1
    s = table[code].astype(np.int64)
    keep = np.r_[True, (s[1:] > 0) | (s[:-1] > 0) | (row[1:] != row[:-1])] if len(s) else np.zeros(0, bool)
    s, row = s[keep], row[keep]
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    gram = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    ok = (row[:-2] == row[2:]) & (gram > 0)
    key = np.sort(row[:-2][ok] * SYMBOLS**3 + gram[ok])
    first = runs(key)
    return key[first] // SYMBOLS**3, key[first] % SYMBOLS**3, np.diff(np.r_[first, len(key)])


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages and their prototypes, of length 1: bundles of all trigram vectors of the training documents.

    Rows with a null language or text are no examples. The counts that reach the driver are bounded by
    languages times symbols**3.
    """
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    ids = labelled.filter("__lang is not null and __text is not null and __id is not null").select("__id").withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(train_rows)
    examples = labelled.filter("__lang is not null and __text is not null").join(F.broadcast(ids.select("__id").distinct()), "__id", "left_semi")  # bounded by train_rows

    def count(batches):
        table = symbols()
        for batch in batches:
            text, lang = (batch.column(batch.schema.get_field_index(c)) for c in ("__text", "__lang"))
            for start, part in slices(text):
                row, gram, n = trigrams(part.to_pylist(), table)
                code = lang.slice(start, len(part)).dictionary_encode()
                key = code.indices.to_numpy()[row].astype(np.int64) * SYMBOLS**3 + gram
                key, at = np.unique(key, return_inverse=True)
                which = pa.array(key // SYMBOLS**3, pa.int32())
                yield pa.RecordBatch.from_arrays([code.dictionary.take(which), pa.array(key % SYMBOLS**3), pa.array(np.bincount(at, n, len(key)).astype(np.int64))], ["lang", "gram", "n"])

    found = examples.select("__text", "__lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs, letter = sorted(found["lang"].unique()), letters(dimensions)
    out = np.zeros((len(langs), dimensions), np.float32)
    for k, lang in enumerate(langs):
        part = found[found["lang"] == lang].sort_values("gram")
        for at in range(0, len(part), 4096):
            out[k] += part["n"].to_numpy()[at : at + 4096].astype(np.float32) @ bind(part["gram"].to_numpy()[at : at + 4096], letter).astype(np.float32)
        out[k] /= np.linalg.norm(out[k]) or 1
    return langs, out


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out_col: str = "pred_lang", cosine_col: str = "cosine", margin_col: str = "margin", drop: tuple[str, ...] = ()) -> DataFrame:
    """df with the language whose prototype is nearest, its cosine, and the lead over the second (null if there is none).

    Runs inside the partitions, with no shuffle; the prototypes travel with the task. A text that is null,
    empty or has no trigram with a letter gets null and a cosine of 0. Ties go to the language first in
    order. Texts count whole, however long. Columns named as an output are replaced.
    """
    langs, proto = model
    df = df.drop(*(c for c in df.columns if c in (out_col, cosine_col, margin_col)))
    kept = [c for c in df.columns if c not in drop]
    at, out = df.columns.index(text_col), [df.columns.index(c) for c in kept]
    dimensions = proto.shape[1]

    def run(batches):
        table, letter = symbols(), letters(dimensions)
        place = np.full(SYMBOLS**3, -1, np.int32)
        vectors = np.zeros((0, dimensions), np.float32)
        known = 0
        for batch in batches:
            cosines = np.zeros((batch.num_rows, max(1, len(langs))), np.float32)
            some = np.zeros(batch.num_rows, bool)
            for start, part in slices(batch.column(at)):
                row, gram, n = trigrams(part.to_pylist(), table)
                new = np.unique(gram[place[gram] < 0])
                if len(new):
                    if known + len(new) > len(vectors):
                        vectors = np.concatenate([vectors, np.zeros((max(len(new), len(vectors), 4096), dimensions), np.float32)])
                    vectors[known : known + len(new)] = bind(new, letter)
                    place[new] = np.arange(known, known + len(new))
                    known += len(new)
                for low in range(0, len(part), BLOCK_ROWS):
                    i, j = np.searchsorted(row, [low, low + BLOCK_ROWS])
                    if i == j or not langs:
                        continue
                    used, col = np.unique(place[gram[i:j]], return_inverse=True)
                    rows = min(BLOCK_ROWS, len(part) - low)
                    counts = np.zeros((rows, len(used)), np.float32)
                    counts[row[i:j] - low, col] = n[i:j]
                    bundle = counts @ vectors[used]
                    norm = np.linalg.norm(bundle, axis=1)
                    ok = norm > 0
                    where = start + low + np.flatnonzero(ok)
                    cosines[where] = bundle[ok] @ proto.T / norm[ok, None]
                    some[where] = True
            best = cosines.argmax(1)
            top = np.sort(cosines, 1)
            names = pa.array(np.array([*langs, ""], object)[best], pa.string(), mask=~some)
            lead = pa.array((top[:, -1] - top[:, -2]).astype(float), mask=~some) if len(langs) > 1 else pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), names, pa.array(np.where(some, top[:, -1], 0).astype(float)), lead], [*kept, out_col, cosine_col, margin_col])

    return df.mapInArrow(run, df.select(*kept).schema.add(out_col, "string").add(cosine_col, "double").add(margin_col, "double"))


def langid(spark, sf_dir: str) -> DataFrame:
    """Every document's language, by prototypes of the labelled ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs, profiles(docs), drop=("text",))
