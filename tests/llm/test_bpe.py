"""Operator 6."""

import random

import pytest

from lodestone.llm import bpe as B


@pytest.fixture(scope="module")
def enc():
    return B.encoding()


def merged(raw, ranks):
    """Byte-pair encoding of one pre-token as defined: the lowest-ranked neighbours are joined until none is left."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        best = min((ranks.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))) if len(parts) > 1 else (10**9, 0)
        if best[0] == 10**9:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_tokens_equal_the_definition(enc):
    import base64

    import regex

    with open(B.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    for text in ("Hello  world, it's 2024!", "été über 東京 😀\n\n  x", "  ", "a\t\tb"):
        assert B.encode_text(enc, text) == [t for p in regex.findall(B.PATTERN, text) for t in merged(p.encode(), ranks)]


def test_pieces_change_nothing(enc):
    rng = random.Random(3)
    parts = ["word", " ", "  ", "\n", "123", "don't", "'ll", "é", "東京", "😀", "!!", "...", "\t", " ", "x" * 50, "7" * 30, "-", "_", "\r\n", "'s"]
    for n in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        assert "".join(B.pieces(text, 7)) == text
        assert B.encode_text(enc, text, 7) == enc.encode_ordinary(text), repr(text)


def test_long_runs_without_a_boundary_stay_whole(enc):
    assert B.pieces("x" * 50_000, 100) == ["x" * 50_000]
    text = "y" * 100_000 + " and more"
    assert enc.decode_bytes(B.encode_text(enc, text)) == text.encode()


def test_odd_rows(spark, enc):
    long = "some words, 42 of them; été\n" * 60_000
    rows = [(1, None, "t", 1), (2, "", "t", 1), (3, long, None, None), (4, "<|endoftext|>", "t", 1), (4, "<|endoftext|>", "t", 1), (None, " \n ", "t", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, other int")
    got = B.encode(df)
    assert got.columns == ["doc_id", "text", "other", "tokens", "n_tokens", "round_trip"]
    rows2 = got.collect()
    by = {r["doc_id"]: r for r in rows2}
    assert len(rows2) == 6 and by[1]["tokens"] is None and by[1]["n_tokens"] is None and by[1]["round_trip"] is None
    assert by[2]["tokens"] == [] and by[2]["n_tokens"] == 0 and by[2]["round_trip"]
    assert by[3]["tokens"] == enc.encode_ordinary(long) and by[3]["round_trip"]
    assert by[4]["n_tokens"] > 1 and by[4]["round_trip"]
    back = {r["doc_id"]: r["decoded"] for r in B.decode(got).collect()}
    assert back[1] is None and bytes(back[2]) == b"" and bytes(back[3]) == long.encode() and bytes(back[4]) == b"<|endoftext|>"
    assert B.encode(df.limit(0)).count() == 0 and B.decode(got.limit(0)).count() == 0


def test_decoding_unknown_and_cut_tokens(spark, enc):
    cut = enc.encode_ordinary("😀")[:1]
    df = spark.createDataFrame([(1, cut), (2, [10**7]), (3, [-1]), (4, [1, None])], "id int, tokens array<int>")
    got = {r["id"]: r["decoded"] for r in B.decode(df).collect()}
    assert "😀".encode().startswith(bytes(got[1])) and got[2] is None and got[3] is None and got[4] is None


def test_round_trip_of_the_whole_table(spark, sf_dir):
    rows = B.bpe(spark, sf_dir).select("round_trip").collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and all(r[0] is not False for r in rows)


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n", "\u3000"])
def test_long_runs_of_white_space(space):
    enc = B.encoding()
    for tail in ("", "x", " x", "\tx"):
        text = "ab, " + space * 20_000 + tail
        assert B.encode_text(enc, text) == enc.encode_ordinary(text)
    long = "a" + space * 1_500_000 + "b"
    assert enc.decode_bytes(B.encode_text(enc, long)) == long.encode()
