"""Operator 8: sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import read
from .textvec import mix64

SHARDS = 64
VIRTUAL_NODES = 128
#: A shard holds at most ceil((1 + EPSILON) * rows / shards) rows.
EPSILON = 0.05
_CELL_BITS = 14


def ring(shards: int, virtual_nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions (signed 64-bit) and the shard of each. A shard's nodes don't depend on the number of shards."""
    s, v = np.divmod(np.arange(shards * virtual_nodes, dtype=np.uint64), np.uint64(virtual_nodes))
    at = mix64(mix64(s, 11) + v, 12).view(np.int64)
    order = np.lexsort((s, at))
    return at[order], s[order].astype(np.int64)


def plan(counts: np.ndarray, owner: np.ndarray, shards: int, capacity: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard): who takes which rows of each arc, ranked by position.

    Shards first fill with rows of their own arcs, in ring order; then what overflows, again in ring
    order, continues clockwise to the next shards with room. Without overflow an arc is one interval.
    """
    room = [capacity] * shards
    taken = []
    for a, n in enumerate(counts.tolist()):
        k = min(n, room[owner[a]])
        room[owner[a]] -= k
        taken.append(k)
    out, arcs = [], len(counts)
    for a, n in enumerate(counts.tolist()):
        if taken[a]:
            out.append((a, 0, taken[a], int(owner[a])))
        at, b = taken[a], a
        while at < n:
            b = (b + 1) % arcs
            k = min(n - at, room[owner[b]])
            if k:
                out.append((a, at, at + k, int(owner[b])))
                room[owner[b]] -= k
                at += k
    return out


def shard(df: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, epsilon: float = EPSILON, shard_col: str = "shard", home_col: str = "home_shard") -> DataFrame:
    """df with the shard of each row, and its home: the shard that it would have with unbounded loads.

    One aggregation counts the rows of each arc (their number is shards * virtual_nodes, whatever the
    data), the driver plans who takes which, and only rows of arcs that overflow are sorted. A null key is
    a key like any other. Rows with equal keys share a place on the ring, and can only be parted where a
    shard is full; rows alike in all columns are interchangeable. No rows give no rows. Columns named as
    an output are replaced, and all others pass untouched.
    """
    spark = df.sparkSession
    df = df.drop(*(c for c in df.columns if c in (shard_col, home_col) and c != key_col))
    columns = df.columns
    at, owner = ring(shards, virtual_nodes)
    cell = (at >> (64 - _CELL_BITS)) + (1 << (_CELL_BITS - 1))
    base = np.searchsorted(cell, np.arange(1 << _CELL_BITS))
    nodes = [(int(c), int(base[c]), [int(x) for x in at[cell == c]]) for c in range(1 << _CELL_BITS)]
    cells = F.broadcast(spark.createDataFrame(nodes, "__cell int, __base int, __nodes array<bigint>"))  # bounded by the ring
    key = F.xxhash64(F.lit("ring"), F.coalesce(F.col(key_col).cast("string"), F.lit("\x00null")))
    # the table's own columns travel as one, so that no helper can clash with them
    placed = df.select(F.struct(*columns).alias("row"), key.alias("__at")).withColumn("__cell", (F.shiftright("__at", 64 - _CELL_BITS) + (1 << (_CELL_BITS - 1))).cast("int")).join(cells, "__cell")
    placed = placed.withColumn("__arc", F.expr(f"cast((__base + size(filter(__nodes, p -> p < __at))) % {len(at)} as int)")).drop("__cell", "__base", "__nodes")
    counted = placed.groupBy("__arc").count().collect()  # one row an arc at most
    counts = np.zeros(len(at), np.int64)
    for arc, n in counted:
        counts[arc] = n
    capacity = math.ceil((1 + epsilon) * int(counts.sum()) / shards)
    intervals = plan(counts, owner, shards, capacity)
    times = Counter(a for a, *_ in intervals)
    split = {a for a, n in times.items() if n > 1}
    whole = [(a, s, int(owner[a])) for a, _, _, s in intervals if a not in split]
    parts = [(a, first, end, s, int(owner[a])) for a, first, end, s in intervals if a in split]
    whole_df = F.broadcast(spark.createDataFrame(whole, "__arc int, shard int, home int"))
    parts_df = F.broadcast(spark.createDataFrame(parts, "__arc int, __first long, __end long, shard int, home int"))
    out = placed.join(whole_df, "__arc").select("row", "shard", "home")
    arcs = F.broadcast(spark.createDataFrame([(a,) for a in sorted(split)], "__arc int"))
    order = Window.partitionBy("__arc").orderBy("__at", F.xxhash64("row"), *(F.col("row")[c] for c, t in df.dtypes if "map<" not in t))
    ranked = placed.join(arcs, "__arc").withColumn("__rank", F.row_number().over(order) - 1)
    over = ranked.join(parts_df, "__arc").filter("__rank >= __first and __rank < __end").select("row", "shard", "home")
    return out.unionByName(over).select(*(F.col("row")[c].alias(c) for c in columns), F.col("shard").alias(shard_col), F.col("home").alias(home_col))


def sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's shard."""
    return shard(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
