"""Candidate edges among rows that fall into the same bucket, and their verified components.

A row is (packed long, id long): the bucket in the high bits of `packed`, and in the low bits a
check value, a part of the signature, whose Hamming distance screens pairs before they are sent
anywhere; further columns of longs, the sketch, may widen it. In a bucket of up to LOCAL_BUCKET rows the pairs that pass form groups; a group of up to
SMALL_BUCKET rows gives all its pairs, of which each id is verified with its smallest partner first and
then only what still lies in different components. A larger group, or bucket, gives a star about its
smallest id first; when the verified edges have been contracted, only pairs of it that lie in different
components are still of interest, and all of those are verified then. So nothing is capped, yet a group
of n mutual copies costs about n verifications and not n squared.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, label
from .session import written
from .textvec import mix64, runs

SMALL_BUCKET = 8
LOCAL_BUCKET = 512


#: Pairs that are compared at a time.
_CHUNK = 1_000_000


def _near(x: np.ndarray, y: np.ndarray, limit: int | np.ndarray, class_bits: int) -> np.ndarray:
    """Whether check values, longs or rows of longs, differ in at most `limit` bits, and their classes, in the lowest class_bits of the first, by one at most.

    limit may be an array: it then holds the limit of each class, and the larger class counts.
    """
    if x.ndim == 1 and y.ndim == 1:
        x, y = x[:, None], y[:, None]
    low = np.int64((1 << class_bits) - 1)
    differ = np.bitwise_count((x[..., 0] ^ y[..., 0]) >> np.int64(class_bits)).astype(np.int64)
    for k in range(1, x.shape[-1]):
        differ += np.bitwise_count((x[..., k] ^ y[..., k]).view(np.uint64))  # of a negative number it would count those of its absolute value
    if not class_bits:
        return differ <= limit
    p, q = x[..., 0] & low, y[..., 0] & low
    return (differ <= (limit if np.isscalar(limit) else limit[np.maximum(p, q)])) & (np.abs(p - q) <= 1)


def _pairs(first: np.ndarray, size: np.ndarray):
    """Yields indices of all pairs i < j inside each run [first, first + size), some at a time."""
    for k in np.unique(size):
        f = first[size == k]
        i, j = np.triu_indices(int(k), 1)
        step = max(1, _CHUNK // len(i))
        for at in range(0, len(f), step):
            part = f[at : at + step, None]
            yield (part + i).ravel(), (part + j).ravel()


def screen(shift: int, limit: int | np.ndarray, small_bucket: int = SMALL_BUCKET, class_bits: int = 0, sketch: int = 0):
    """mapInArrow over whole buckets: rows (a, b) are pairs; rows (group, a, check and sketch) are members of large groups."""
    low, names = np.int64((1 << shift) - 1), ["bucket", "a", "b", *(f"w{k}" for k in range(sketch))]

    def run(batches):
        parts = [[x.column(k).to_numpy() for k in range(2 + sketch)] for x in batches if x.num_rows]
        if not parts:
            return
        packed, ids, *wide = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, packed >> np.int64(shift)))
        packed, ids = packed[order], ids[order]
        bucket, check = packed >> np.int64(shift), np.stack([packed & low, *(c[order] for c in wide)], axis=1)
        first = runs(bucket)
        size = np.diff(np.r_[first, len(bucket)])
        local = (size > 1) & (size <= LOCAL_BUCKET)
        pairs, member = [np.zeros((2, 0), np.int64)], [np.zeros((3 + sketch, 0), np.int64)]

        def star(group: np.ndarray, at: np.ndarray) -> None:
            """Groups of positions that are to be looked at again: each with its group's smallest id first."""
            o = np.lexsort((ids[at], group))
            group, at = group[o], at[o]
            f = runs(group)
            lead = np.repeat(at[f], np.diff(np.r_[f, len(at)]))
            pairs.append(np.stack([ids[lead], ids[at]])[:, (ids[lead] != ids[at]) & _near(check[lead], check[at], limit, class_bits)])
            name = mix64(bucket[at].view(np.uint64)) ^ ids[lead].view(np.uint64)
            member.append(np.stack([name.view(np.int64), ids[at], *check[at].T]))

        for i, j in _pairs(first[local], size[local]):
            near = _near(check[i], check[j], limit, class_bits) & (ids[i] != ids[j])
            i, j = i[near], j[near]
            node, comp = label(i, j)
            many = np.bincount(comp, minlength=1)[comp] > small_bucket if len(node) else np.zeros(0, bool)
            large = np.isin(i, node[many])
            pairs.append(np.stack([ids[i[~large]], ids[j[~large]]]))
            if many.any():
                star(comp[many], node[many])
        big = np.flatnonzero(np.repeat(size > LOCAL_BUCKET, size))
        if len(big):
            star(bucket[big], big)
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        for at in range(0, len(a), 100_000):
            x, y = a[at : at + 100_000], b[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(y), *[pa.nulls(len(x), pa.int64())] * sketch], names)
        rows = np.concatenate(member, axis=1)
        for at in range(0, rows.shape[1], 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in rows], names)

    return run


def cross(limit: int | np.ndarray, class_bits: int = 0, sketch: int = 0):
    """mapInArrow over whole large buckets (bucket, a, comp, check and sketch): pairs that lie in different components."""

    def run(batches):
        parts = [[x.column(i).to_numpy() for i in range(4 + sketch)] for x in batches if x.num_rows]
        if not parts:
            return
        bucket, ids, comp, *check = (np.concatenate(c) for c in zip(*parts))
        check = np.stack(check, axis=1)
        order = np.lexsort((ids, comp, bucket))
        bucket, ids, check, comp = bucket[order], ids[order], check[order], comp[order]
        first = runs(bucket)
        for f, n in zip(first, np.diff(np.r_[first, len(bucket)])):
            c = comp[f : f + n]
            if c[0] == c[-1]:
                continue
            x, h = ids[f : f + n], check[f : f + n]
            for k, start in enumerate(s := runs(c)):
                end = s[k + 1] if k + 1 < len(s) else n
                if end == n:
                    break
                for i in range(start, end):
                    j = end + np.flatnonzero(_near(h[end:], h[i], limit, class_bits))
                    if len(j):
                        lo, hi = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
                        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    return run


def near_components(rows: DataFrame, shift: int, limit: int | np.ndarray, verify: Callable[[DataFrame], DataFrame] | None = None, small_bucket: int = SMALL_BUCKET, make_verify: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None, class_bits: int = 0, sketch: list[str] = ()) -> DataFrame:
    """(node, comp) of ids joined by verified edges between rows of one bucket. verify keeps of pairs (a, b) those alike.

    sketch names the columns of rows, after packed and id, that check values have besides.
    make_verify, if given, makes verify from the distinct ids that can be in a pair, as a table (id).
    """
    bucket, wide = F.shiftright("packed", shift), [f"w{k}" for k in range(len(sketch))]
    found = written(rows.select("packed", "id", *sketch).repartition(bucket).mapInArrow(screen(shift, limit, small_bucket, class_bits, len(sketch)), "bucket long, a long, b long" + "".join(f", {w} long" for w in wide)), "collisions")
    pairs = found.filter("bucket is null").select("a", "b").distinct()
    if make_verify:
        verify = make_verify(written(found.select(F.explode(F.when(F.col("bucket").isNull(), F.array("a", "b")).otherwise(F.array("a"))).alias("id")).distinct(), "ids"))
    # each id with its smallest partner first; of all other pairs only those between components are of interest then
    pairs = written(pairs, "pairs")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    good = written(verify(first).select("a", "b"), "edges")
    comp = written(components(good), "components")
    good = good.union(written(verify(_between(pairs.join(first, ["a", "b"], "left_anti"), comp)).select("a", "b"), "edges"))
    large = found.filter("bucket is not null")
    if large.isEmpty():
        return components(good)
    comp = components(good)
    member = large.join(comp, large["a"] == comp["node"], "left").select("bucket", "a", F.coalesce("comp", "a").alias("comp"), F.col("b").alias("check"), *wide)
    rest = member.repartition("bucket").mapInArrow(cross(limit, class_bits, len(sketch)), "a long, b long").distinct()
    more = written(verify(rest).select("a", "b"), "edges")
    return components(good.union(more))


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components; an id without one is its own."""
    for end in "ab":
        side = comp.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"comp_{end}", F.coalesce(f"comp_{end}", end))
    return pairs.filter("comp_a <> comp_b").select("a", "b")
