"""Connected components and candidate pairs, which operators 1, 2 and 4 share."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collide, graph


def slow(edges):
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


@pytest.mark.parametrize("one_task_rows", [10**6, 0])
def test_components(spark, one_task_rows):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(-40, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(25)] + [(7, 7), (900, 900), (1, 2), (1, 2), (2**62, -(2**62))]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(df, one_task_rows).collect()}
    assert got == slow(edges)
    assert graph.components(df.limit(0), one_task_rows).count() == 0


@pytest.mark.parametrize("small_bucket,local_bucket", [(1, 512), (8, 512), (2, 20), (100, 512)])
def test_all_pairs_of_a_bucket_count_whatever_its_size(spark, monkeypatch, small_bucket, local_bucket):
    """Groups by exact comparison inside buckets, against a loop over all pairs."""
    monkeypatch.setattr(collide, "LOCAL_BUCKET", local_bucket)
    rng = np.random.default_rng(small_bucket)
    n, shift = 400, 20
    bucket, check, ids = rng.integers(0, 12, n), rng.integers(0, 1 << shift, n), rng.permutation(10 * n)[:n]
    value = dict(zip(ids.tolist(), rng.integers(0, 60, n).tolist()))
    rows = spark.createDataFrame([(int(b) << shift | int(c), int(i)) for b, c, i in zip(bucket, check, ids)], "packed long, id long")
    table = spark.createDataFrame(list(value.items()), "id long, v int")

    def verify(pairs):
        a, b = (table.select(F.col("id").alias(s), F.col("v").alias(f"v{s}")) for s in "ab")
        return pairs.join(a, "a").join(b, "b").filter("va = vb").select("a", "b")

    got = {r["node"]: r["comp"] for r in collide.near_components(rows, shift, 9, verify, small_bucket).collect()}
    edges = [(int(ids[i]), int(ids[j])) for i in range(n) for j in range(i) if bucket[i] == bucket[j] and bin(check[i] ^ check[j]).count("1") <= 9 and value[int(ids[i])] == value[int(ids[j])]]
    assert {k: v for k, v in got.items()} == slow(edges)


def test_classes_are_one_apart_at_most():
    x, y = np.array([0b1010_0011, 0b1010_0011, 0b1011_0101]), np.array([0b1010_0100, 0b1010_0101, 0b1010_0100])
    assert collide._near(x, y, 0, 4).tolist() == [True, False, False] and collide._near(x, y, 1, 4).tolist() == [True, False, True]


def test_no_rows():
    assert list(collide.screen(8, 2)(iter([]))) == [] and list(collide.cross(2)(iter([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, list("abcd"))]))) == []
