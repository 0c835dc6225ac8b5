"""Operator 1."""

import numpy as np
import pytest

from lodestone.llm import embdedup as E

from ..oracle import same

COLUMNS = "vec_id long, embedding array<float>"


def brute(x, threshold):
    """The smallest index of each row's connected group."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= threshold
    group = np.arange(len(x))
    while True:
        new = np.array([group[near[i]].min() for i in range(len(x))])
        if np.array_equal(new, group):
            return group
        group = np.minimum(group, new)


def clustered(n, d, seed):
    """Vectors in clusters of many sizes, some chained, on axes of falling variance."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d)) * np.linspace(3, 0.1, d)
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 0.25], (n, 1)) * np.linspace(1, 0.05, d)
    return x.astype(np.float32)


def groups(df, **kw):
    return {r["vec_id"]: (r["group_id"], r["is_kept"]) for r in E.near_dedup(df, **kw).collect()}


@pytest.mark.parametrize("n,d,tile,threshold", [(400, 24, 2048, 0.95), (900, 24, 64, 0.95), (600, 3, 50, 0.99), (500, 1, 100, 0.9), (700, 70, 97, 0.8)])
def test_brute_force(spark, n, d, tile, threshold):
    x = clustered(n, d, n + d)
    if d == 1:
        x[x == 0] = 1
    got = groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], COLUMNS), threshold=threshold, tile_rows=tile)
    want = brute(x.astype(float), threshold)
    assert {i: g for i, (g, _) in got.items()} == dict(enumerate(want.tolist()))
    assert all(kept == (g == i) for i, (g, kept) in got.items())


def test_whole_table_equals_sql(spark, sf_dir):
    same(E.embedding_neardup(spark, sf_dir), E.EMBEDDING_SQL, sf_dir)


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(4)
    a, b = clustered(300, 40, 1), clustered(200, 40, 1)
    b[:100] = a[:100] + rng.normal(size=(100, 40)).astype(np.float32) * 0.01
    a, b = (v / np.linalg.norm(v, axis=1)[:, None] for v in (a, b))
    for t in (0.5, 0.9, 0.99):
        i, j = E.alike(a, b, t, False)
        assert set(zip(*np.nonzero(a.astype(float) @ b.T.astype(float) >= t))) <= set(zip(i, j))
        i, j = E.alike(a, a, t, True)
        assert (i < j).all()


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [float("nan"), 1.0], "a"), (5, [float("inf"), 1.0], "a"), (6, [1.0, None], "a"), (7, [1.0, 0.0, 0.0], "a"),
        (9, [1.0, 0.0], "a"), (8, [2.0, 0.0], "b"), (8, [0.0, 1.0], "b"), (10, [0.0, 5.0], None), (None, [1.0, 0.0], "c"), (11, [-1.0, -1.0], "c"), (9, [1.0, 0.0], "a"),
    ]
    df = spark.createDataFrame(rows, COLUMNS + ", group_id string")
    got = sorted(((r["vec_id"], r["group_id"], r["is_kept"]) for r in E.near_dedup(df).collect()), key=str)
    alone = [(i, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 11)]
    assert got == sorted([*alone, (8, 8, True), (8, 8, True), (9, 8, False), (9, 8, False), (10, 8, False), (None, None, True)], key=str)
    assert E.near_dedup(df.limit(0)).count() == 0


def test_vectors_of_every_length_are_compared(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0]), (3, [1.0, 0.01, 0.0, 0.0]), (4, [1.0] * 8), (5, [1.0] * 8), (6, [1.0] * 7 + [-1.0]), (7, [2.0] * 8), (8, [1.0])]
    got = {r["vec_id"]: r["group_id"] for r in E.near_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 4, 8: 8}


def test_other_columns_pass(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5, "x"), (2, [1.0, 0.0], None, "y")], COLUMNS + ", node int, tile string").withColumnsRenamed({"tile": "__comp"})
    got = E.near_dedup(df)
    assert got.columns == ["vec_id", "node", "__comp", "group_id", "is_kept"] and sorted(map(tuple, got.collect())) == [(1, 5, "x", 1, True), (2, None, "y", 1, False)]


def test_thousands_of_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist()) for i in range(3000)] + [(9000 + i, base.tolist()) for i in range(500)]
    got = groups(spark.createDataFrame(rows, COLUMNS), tile_rows=256)
    assert {g for g, _ in got.values()} == {0} and sum(k for _, k in got.values()) == 1
