"""Operator 4."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestone.llm import hamming as H
from lodestone.llm import simhash as S
from lodestone.llm.graph import label

COLUMNS = "doc_id long, text string"


def dedup(spark, rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["group_id"], r["is_kept"]) for r in S.near_dedup(spark.createDataFrame(rows, COLUMNS)).collect()), key=str)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)]


def changed(rng, text, n):
    text = list(text)
    for _ in range(n):
        text[rng.randrange(len(text))] = "changed" + str(rng.randrange(10**6))
    return text


def test_brute_force_over_the_test_table(spark):
    """All pairs of fingerprints within MAX_BITS, joined into groups, against the operator's groups: recall by pairs is at least 0.9, and no group is too wide."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    prints, _ = S.fingerprints(table["text"].combine_chunks())
    ids = table["doc_id"].to_numpy()
    some = np.flatnonzero(prints.any(1))
    a, b = [], []
    for i in some:
        d = np.bitwise_count(prints[some] ^ prints[i]).sum(1)
        j = some[(d <= S.MAX_BITS) & (some > i)]
        a.append(np.full(len(j), i)), b.append(j)
    a, b = ids[np.concatenate(a)], ids[np.concatenate(b)]
    node, comp = label(a, b)
    whole = dict(zip(node.tolist(), comp.tolist()))
    got = {r["doc_id"]: r for r in S.simhash_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(ids)
    assert np.mean([got[x]["group_id"] == got[y]["group_id"] for x, y in zip(a.tolist(), b.tolist())]) >= 0.9
    for i, r in got.items():
        if i in whole:
            assert r["group_id"] >= whole[i] and whole[r["group_id"]] == whole[i]
        assert r["is_kept"] == (r["group_id"] == i)


def test_variants_meet_in_the_middle():
    """Two sub-fingerprints two bits apart share a variant of their balls of radius one."""
    rng = random.Random(0)
    for _ in range(200):
        x = rng.getrandbits(32)
        y = x ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32))
        assert {x ^ m for m in S._MASKS} & {y ^ m for m in S._MASKS}


def test_fingerprints_equal_a_plain_count():
    texts = ["a b a c", "", None, "Ünï a"]
    got, n = S.fingerprints(pa.array(texts))
    assert n.tolist() == [4, 0, 0, 2] and not got[1].any() and not got[2].any()
    _, h = S.words(pa.array(["a", "b", "c"]))
    total = np.zeros(192)
    for k, w in zip(h, (2**0.5, 1, 1)):
        bits = np.concatenate([np.unpackbits(S.mix64(np.array([k]), 100 + low).view(np.uint8), bitorder="little") for low in (0, 2, 4)])
        total += w * (bits - 0.5)
    assert np.array_equal(np.unpackbits(got[0].view(np.uint8), bitorder="little"), total > 0)


def test_copies_and_near_copies(spark):
    rng = random.Random(3)
    a, b = words(rng, 200), words(rng, 200)
    rows = [(5, " ".join(a)), (2, " ".join(changed(rng, a, 5))), (9, " ".join(a).upper() + "!"), (7, " ".join(b))]
    assert dedup(spark, rows) == sorted([(False, 2, 2, True), (False, 5, 2, False), (False, 9, 2, False), (False, 7, 7, True)], key=str)


@pytest.mark.parametrize("copies", [12, 900])
def test_large_groups(spark, copies):
    rng = random.Random(copies)
    a, other = words(rng, 300), words(rng, 300)
    rows = [(i, " ".join(changed(rng, a, 2))) for i in range(copies)] + [(10**6, " ".join(other))]
    got = {r["doc_id"]: r for r in S.near_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(got[i]["group_id"] == 0 and got[i]["is_kept"] == (i == 0) for i in range(copies)) and got[10**6]["is_kept"]


def test_odd_rows(spark):
    long = " ".join(words(random.Random(8), 150_000))
    rows = [(3, None), (4, ""), (5, " \n ... "), (6, long), (8, long), (None, long), (8, long)]
    got = dedup(spark, rows)
    assert [r for r in got if r[1] in (3, 4, 5)] == [(False, 3, 3, True), (False, 4, 3, False), (False, 5, 3, False)]
    assert sum(r[3] for r in got if r[1] in (0, 6, 8)) == 1 and (False, 6, 6, True) in got and len(got) == 7
    assert dedup(spark, []) == []


def test_repeated_rows_leave_one(spark):
    assert [r[3] for r in dedup(spark, [(1, "a b"), (1, "a b"), (1, "a b")])] == [False, False, True]
    assert sum(r[3] for r in dedup(spark, [(1, "x y z"), (1, "q r s")])) == 2  # one id, two texts: two documents
    assert sum(r[3] for r in dedup(spark, [(None, "a b"), (None, "a b")])) == 1


def test_stage_keeps_one_row_of_each_group_and_all_columns(spark):
    rng = random.Random(9)
    a = words(rng, 100)
    rows = [(2, " ".join(a), 1, 2, 3), (1, " ".join(changed(rng, a, 2)), 4, 5, 6), (3, "alone", 7, 8, 9), (3, "alone", 7, 8, 9), (4, None, None, None, None), (5, "", 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp long, __i long, gone_text int")
    got = S.drop_copies(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4]
    assert S.drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("most,tile,many", [(30, 10**6, 1024), (30, 90, 2), (30, 200, 1024), (0, 10**6, 1024), (7, 10**6, 0), (200, 10**6, 1024)])
def test_hamming_equals_all_pairs(spark, monkeypatch, most, tile, many):
    """Links between components against a loop over all pairs, in one tile and in several, with large buckets and links that are joined at once."""
    for name, value in (("TILE", tile), ("_MANY", many), ("_CHUNK", 500), ("_LINKS", 3)):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(most)
    n = 300
    bits = rng.integers(0, 2, (n, 192), np.uint8)
    for i in range(60, n):  # 24 to 35 bits from an earlier row
        bits[i] = bits[rng.integers(0, i)]
        bits[i, rng.permutation(192)[: rng.integers(24, 36)]] ^= 1
    bits[40:60, :100] = 0
    prints = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    comp = rng.integers(0, 200, n)
    a, b = [], []
    for i in range(n):
        j = np.flatnonzero((bits[i] != bits[:i]).sum(1) <= most)
        a.append(comp[j]), b.append(np.full(len(j), comp[i]))
    a, b = np.concatenate(a), np.concatenate(b)
    rows = spark.createDataFrame([(int(c), *map(int, p)) for c, p in zip(comp, prints)], "comp long, f0 long, f1 long, f2 long")
    got = [(r["a"], r["b"]) for r in H.between(rows, ["f0", "f1", "f2"], most).collect()]
    whole = dict(zip(*(x.tolist() for x in label(a[a != b], b[a != b]))))
    assert dict(zip(*(x.tolist() for x in label(*np.array(got, np.int64).reshape(-1, 2).T)))) == whole


def test_no_pair_within_the_threshold_is_left_out(spark):
    """Groups of the test table are those of all pairs of fingerprints within MAX_BITS, without a miss."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    prints, _ = S.fingerprints(table["text"].combine_chunks())
    ids = table["doc_id"].to_numpy()
    some = np.flatnonzero(prints.any(1))
    far = np.bitwise_count(prints[some][:, None] ^ prints[some]).sum(2)
    node, comp = label(*(ids[some[k]] for k in np.nonzero(far <= S.MAX_BITS)))
    got = {r["doc_id"]: r["group_id"] for r in S.simhash_neardup(spark, "/root/testdata/sf0.01").collect()}
    assert {i: got[i] for i in node.tolist()} == dict(zip(node.tolist(), comp.tolist()))
