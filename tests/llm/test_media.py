"""Operator 5."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import media as M


def data(n, seed):
    return random.Random(seed).randbytes(n)


def slow_cuts(payload, low=M.MIN_BYTES, bits=M.MASK_BITS, high=M.MAX_BYTES):
    """The rolling hash, byte by byte."""
    out, start, h = [], 0, 0
    marks = []
    for i, b in enumerate(payload):
        h = ((h << 1) + int(M.GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - bits) == 0:
            marks.append(i + 1)
    while len(payload) - start > low:
        end = min([m for m in marks if m >= start + low][:1] + [len(payload), start + high])
        out.append(end)
        start = end
    return [*out, len(payload)] if start < len(payload) else out


@pytest.mark.parametrize("n", [0, 1, 31, 256, 257, 5000, 60_000])
def test_cuts_equal_a_byte_by_byte_loop(n):
    payload = data(n, n)
    got = M.cuts(np.frombuffer(payload, np.uint8))
    assert got == slow_cuts(payload) and (not n or got[-1] == n)
    sizes = np.diff([0, *got])
    assert all(M.MIN_BYTES <= s <= M.MAX_BYTES for s in sizes[:-1])


def test_an_insertion_moves_few_cuts():
    a = data(200_000, 1)
    b = a[:70_000] + b"inserted" + a[70_000:]
    parts = [{bytes(x[s:e]) for s, e in zip([0, *M.cuts(np.frombuffer(x, np.uint8))], M.cuts(np.frombuffer(x, np.uint8)))} for x in (a, b)]
    assert len(parts[0] & parts[1]) > 0.95 * len(parts[0])


@pytest.fixture(scope="module")
def shared():
    common = data(20_000, 5)
    return {3: data(3000, 6) + common + data(1000, 7), 1: data(900, 8) + common, 2: common, 4: common + common, 5: b"", 6: None, 7: b"x", 9: data(2_000_000, 9)}


def test_lists_owners_and_reconstruction(spark, shared):
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, "x", 1) for k, v in shared.items()], "page_id long, html binary, owner string, pos int")
    got = {r["page_id"]: r for r in M.media_chunks(df).collect()}
    assert set(got) == set(shared)
    owner = {}
    for k in sorted(shared):
        v, r = shared[k], got[k]
        if v is None:
            assert [r[c] for c in ("n_bytes", "digest", "n_chunks", "chunks", "owned_bytes", "verified")] == [None] * 6
            continue
        ends = slow_cuts(v) if len(v) < 100_000 else M.cuts(np.frombuffer(v, np.uint8))
        parts = [v[s:e] for s, e in zip([0, *ends], ends)]
        digests = [hashlib.sha256(p).hexdigest() for p in parts]
        assert r["chunks"] == digests and r["n_chunks"] == len(parts) and r["n_bytes"] == len(v) and r["digest"] == hashlib.sha256(v).hexdigest() and r["verified"]
        owned = 0
        for p, d in zip(parts, digests):
            if d not in owner:
                owner[d] = k
                owned += len(p)
        assert r["owned_bytes"] == owned


def test_bytes_come_from_the_owner(spark, shared):
    """With the owner's payload changed the borrower's reconstruction fails its check."""
    rows = [(k, bytearray(shared[k])) for k in (1, 2, 3)]
    df = spark.createDataFrame(rows, "id long, payload binary")
    chunked = M.chunk(df, "id", "payload").cache()
    moved = M.places(chunked).cache()
    whole = {r["id"]: r for r in M.rebuild(df, chunked, moved, "id", "payload").collect()}
    assert all(r["verified"] and bytes(r["rebuilt"]) == shared[k] for k, r in whole.items())
    spoiled = bytearray(shared[1])
    spoiled[10_000] ^= 1
    df2 = spark.createDataFrame([(1, spoiled), *rows[1:]], "id long, payload binary")
    assert {r["id"]: r["verified"] for r in M.rebuild(df2, chunked, moved, "id", "payload").collect()} == {1: False, 2: False, 3: False}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "c"), (2, "ü" * 5000)], "page_id long, html string")
    got = M.media_chunks(df).collect()
    want = [(1, b"a"), (1, b"b"), (2, "ü".encode() * 5000), (None, b"c")]
    assert sorted((str(r["page_id"]), r["digest"]) for r in got) == sorted((str(i), hashlib.sha256(x).hexdigest()) for i, x in want) and all(r["verified"] for r in got)
    assert M.media_chunks(df.limit(0)).count() == 0


def test_whole_table_is_verified(spark, sf_dir):
    rows = M.media(spark, sf_dir).select("verified", "n_bytes").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and all(r["verified"] or r["n_bytes"] is None for r in rows)
