"""Connected components of an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import SMALL_ROWS, shared_dir, small


def label(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the edges a-b, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _one_task(batches):
    parts = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if parts:
        node, comp = label(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "comp"])


def components(edges: DataFrame, one_task_rows: int = SMALL_ROWS) -> DataFrame:
    """(node, comp) for every node of edges(a long, b long); comp is the component's smallest node.

    Up to `one_task_rows` edges one task does it in memory; beyond, rounds of large-star and
    small-star joins (Kiveris et al., 2014) do, each round checkpointed. The result is the same.
    Edges with a null end are ignored; no edges give no rows; repeated edges and loops are allowed.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    if small(edges, one_task_rows):
        return edges.coalesce(1).mapInArrow(_one_task, "node long, comp long")
    shared_dir(edges.sparkSession)

    def both(e):
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    loops = edges.filter("a = b").select("a").distinct()
    e = edges.filter("a <> b").distinct().checkpoint()
    while True:
        n = both(e).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both(e).filter("b > a").join(n, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(low, "a")
        new = star.select(F.col("b").alias("a"), F.col("m").alias("b")).union(star.select("a", F.col("m").alias("b")))
        new = new.filter("a <> b").distinct().checkpoint()
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    leaf = e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    root = e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    found = leaf.union(root)
    alone = loops.withColumnRenamed("a", "node").join(found, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return found.union(alone)
