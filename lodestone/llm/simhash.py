"""Operator 4: SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has WORDS sub-fingerprints of 32 bits. Each of these emits all variants within
half its radius: itself and every value one bit away, 33 in all. Two sub-fingerprints of the same place
within RADIUS = 2 bits have a variant in common, where they meet in one shuffle. Colliding pairs are made
distinct and verified by the Hamming distance of the whole fingerprints.

That joins most of what is alike cheaply, large groups too, but guarantees a meeting up to 17 differing
bits only. So the components it leaves are then compared exactly (see hamming.py): no pair is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .collide import near_components
from .graph import components
from .hamming import between
from .session import forget, mark, maybe_broadcast, read, unused, written
from .textvec import mix64, runs, slices, words

#: Sub-fingerprints of 32 bits; an even number, as two make a long.
WORDS = 6
#: A pair is alike if at most so many of the 32 * WORDS bits differ.
MAX_BITS = 30
CHECK_BITS = 28
CHECK_LIMIT = 10
_MASKS = [0, *(1 << k for k in range(32))]


def fingerprints(texts: pa.Array, parts: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts uint32, number of words): SimHash over the words, each weighted by the root of its count."""
    row, h = words(texts)
    n = np.bincount(row, minlength=len(texts))
    out = np.zeros((len(texts), parts * 32), np.float32)
    if len(h):
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        first = runs(row) if len(h) == 1 else np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
        weight = np.sqrt(np.diff(np.r_[first, len(h)])).astype(np.float32)
        row, h = row[first], h[first]
        for low in range(0, parts, 2):
            bits = np.unpackbits(mix64(h, 100 + low).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            bits -= 0.5
            bits *= weight[:, None]
            cut = runs(row)
            out[row[cut], low * 32 : low * 32 + 64] = np.add.reduceat(bits, cut, axis=0)[:, : min(64, (parts - low) * 32)]
    packed = np.packbits(out > 0, axis=1, bitorder="little").view(np.uint32)
    return packed, n


def _scan(df: DataFrame, text_col: str, kept: list[str]) -> DataFrame:
    """kept columns and long columns f0, f1, ...: the fingerprint, all 0 without a word."""
    names = [f"f{k}" for k in range(WORDS // 2)]
    at, out = df.columns.index(text_col), [df.columns.index(c) for c in kept]

    def run(batches):
        for batch in batches:
            prints = np.zeros((batch.num_rows, WORDS), np.uint32)
            for start, texts in slices(batch.column(at)):
                prints[start : start + len(texts)] = fingerprints(texts)[0]
            longs = prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), *(pa.array(longs[:, k]) for k in range(WORDS // 2))], [*kept, *names])

    schema = df.select(*kept).schema
    for name in names:
        schema = schema.add(name, "long")
    return df.mapInArrow(run, schema)


def _distance() -> F.Column:
    return sum((F.bit_count(F.col(f"f{k}_a").bitwiseXOR(F.col(f"f{k}_b"))) for k in range(1, WORDS // 2)), F.bit_count(F.col("f0_a").bitwiseXOR(F.col("f0_b"))))


def groups(df: DataFrame, text_col: str, kept: list[str], max_bits: int = MAX_BITS) -> DataFrame:
    """kept columns of every row of df, and `comp`, equal for rows of one near-duplicate group."""
    names = [f"f{k}" for k in range(WORDS // 2)]
    rows = written(_scan(df, text_col, kept), "fingerprints")
    uid = F.xxhash64(*names)
    distinct = written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).withColumn("id", uid), "distinct")
    some = distinct.filter(" or ".join(f"{x} <> 0" for x in names))
    half = [F.shiftrightunsigned(F.col(f"f{k // 2}"), 32 * (k % 2)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(WORDS)]
    place = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), half[k].alias("w"), half[(k + 1) % WORDS].bitwiseAND(F.lit((1 << CHECK_BITS) - 1)).alias("check")) for k in range(WORDS))))
    balls = some.select("id", place.alias("p")).select("id", "p.*", F.explode(F.array(*(F.lit(m).cast("long") for m in _MASKS))).alias("mask"))
    packed = F.shiftleft(F.shiftleft(F.col("k"), 32).bitwiseOR(F.col("w").bitwiseXOR(F.col("mask"))), CHECK_BITS).bitwiseOR(F.col("check"))
    balls = balls.select(packed.alias("packed"), "id")

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = (some.select(F.col("id").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in names)) for s in "ab")
        return pairs.join(a, "a").join(b, "b").filter(_distance() <= max_bits).select("a", "b")

    before = mark()
    comp = written(near_components(balls, CHECK_BITS, CHECK_LIMIT, verify), "components")
    forget(before)
    parts = some.join(comp, F.col("id") == F.col("node"), "left").select(F.coalesce("comp", "id").alias("comp"), *names)
    more = components(written(between(written(parts, "parts"), names, max_bits), "links"))
    more = more.select(F.col("node").alias("part"), F.col("comp").alias("whole"))
    found = rows.withColumn("__id", uid).join(comp, F.col("__id") == F.col("node"), "left").withColumn("__part", F.coalesce("comp", "__id"))
    return found.join(more, F.col("__part") == F.col("part"), "left").select(*kept, F.coalesce("whole", "__part").alias("comp"))


def _by_id(id_col: str) -> F.Column:
    """Orders rows by id, null last."""
    return F.struct(F.col(id_col).isNull().alias("null"), F.col(id_col).alias("id"), F.col("__text").alias("text"))


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, group_id, is_kept) for each row of df: group_id is the smallest id of its group, whose row stays.

    Words are compared, not case, punctuation or white space. Texts that are null, empty or have no word
    are alike, and one of them stays. A null id comes after all others. Of rows that share the smallest
    id the one with the smallest hash of its text stays, and of rows alike in id and text one. Extra
    columns aren't looked at, whatever their names. Texts count whole, however long.
    """
    rows = df.select(F.col(id_col), F.col(text_col).alias("__body")).withColumn("__text", F.xxhash64("__body"))
    before = mark()
    found = written(groups(rows, "__body", [id_col, "__text"], max_bits), "groups")
    forget(before)
    lead = found.groupBy("comp").agg(F.min(_by_id(id_col)).alias("lead"), F.count(F.lit(1)).alias("n"))
    joined = found.join(lead, "comp").withColumn("__is", _by_id(id_col).eqNullSafe(F.col("lead")))
    ties = found.groupBy(id_col, "__text").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    out = joined.select(F.col(id_col), "__text", F.col("lead.id").alias("group_id"), F.col("__is").alias("is_kept"))
    if ties.isEmpty():
        return out.select(id_col, "group_id", "is_kept")
    key = [F.col(id_col).eqNullSafe(F.col("__i")), F.col("__text") == F.col("__t")]
    marked = out.join(ties.select(F.col(id_col).alias("__i"), F.col("__text").alias("__t"), "times"), key[0] & key[1], "left")
    first = F.row_number().over(Window.partitionBy(id_col, "__text").orderBy("group_id")) == 1
    once = marked.filter("times is null").select(id_col, "group_id", "is_kept")
    return once.union(marked.filter("times is not null").withColumn("__first", first).select(id_col, "group_id", (F.col("is_kept") & F.col("__first")).alias("is_kept")))


def simhash_neardup(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate group."""
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that near_dedup doesn't keep; all columns, as they are.

    Nulls, empty and long texts, ties and repeated rows are as in near_dedup; no rows give no rows. Columns
    may have any names.
    """
    gone_id, gone_text, rank = (unused(docs, c) for c in ("gone_id", "gone_text", "rank"))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__body")).withColumn("__text", F.xxhash64("__body"))
    before = mark()
    found = written(groups(rows, "__body", [id_col, "__text"]), "groups")
    forget(before)
    lead = found.groupBy("comp").agg(F.min(_by_id(id_col)).alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = found.join(maybe_broadcast(lead, 500_000), "comp").withColumn("__is", _by_id(id_col).eqNullSafe(F.col("lead")))
    gone = again.filter(~F.col("__is")).select(F.col(id_col).alias(gone_id), F.col("__text").alias(gone_text)).distinct()
    kept = docs.join(maybe_broadcast(gone, 500_000), F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_text)), "left_anti")
    ties = written(again.filter("__is").groupBy(id_col, "__text").count().filter("count > 1").select(F.col(id_col).alias(gone_id), F.col("__text").alias(gone_text)), "ties")
    if ties.isEmpty():
        return kept
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(text_col) == F.col(gone_text))
    ties = maybe_broadcast(ties, 500_000)
    first = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.xxhash64(*docs.columns))
    one = kept.join(ties, same, "left_semi").withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).select(*docs.columns)
    return kept.join(ties, same, "left_anti").unionByName(one)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group stays; odd rows are as in drop_copies."""
    return drop_copies(docs)
