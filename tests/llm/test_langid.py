"""Operator 7."""

import random

import numpy as np

from lodestone.llm import langid as G


def plain(text, table, letter):
    """A text's bundle: every trigram's letters permuted by their place and multiplied."""
    symbols = [0, *(int(table[ord(c)]) for c in text)]
    s = [x for i, x in enumerate(symbols) if i == 0 or x > 0 or symbols[i - 1] > 0]
    out = np.zeros(letter.shape[1])
    for a, b, c in zip(s, s[1:], s[2:]):
        if a or b or c:
            out += np.roll(letter[a].astype(int), 2) * np.roll(letter[b].astype(int), 1) * letter[c]
    return out


def test_bundles_equal_a_plain_loop(spark):
    texts = ["Hello, the world!", "été 12 über", "", None, "a\x00b c", "..", "日本語の文"]
    table, letter = G.symbols(), G.letters()
    row, gram, n = G.trigrams(texts, table)
    for i, t in enumerate(texts):
        mine = n[row == i] @ G.bind(gram[row == i], letter).astype(float) if (row == i).any() else np.zeros(G.DIMENSIONS)
        assert np.array_equal(mine, plain((t or "").replace("\x00", " "), table, letter))


def test_cosines_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices(alphabet, k=5)) for _ in range(60)) for alphabet in ("abcdefg", "nopqrst") for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "xy"[i // 30]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    langs, proto = G.profiles(docs)
    table, letter = G.symbols(), G.letters()
    assert langs == ["x", "y"]
    for k in (0, 1):
        want = sum(plain(t, table, letter) for t in texts[30 * k : 30 * k + 30])
        assert np.allclose(proto[k], want / np.linalg.norm(want), atol=1e-5)
    for r in G.identify(docs, (langs, proto)).collect():
        v = plain(r["text"], table, letter)
        cos = proto @ v / np.linalg.norm(v)
        assert r["pred_lang"] == r["lang"] == langs[int(cos.argmax())] and abs(r["cosine"] - cos.max()) < 1e-5 and abs(r["margin"] - abs(cos[0] - cos[1])) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = G.profiles(docs.filter("doc_id % 2 = 0"))
    rows = G.identify(docs.filter("doc_id % 2 = 1 and length(text) > 100"), model).collect()
    assert np.mean([r["lang"] == r["pred_lang"] for r in rows]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the one and the other", "en"), (2, "der eine und der andere", "de"), (3, None, "fr"), (4, "xx yy", None), (None, "zz ww", "it")], "doc_id long, text string, lang string")
    model = G.profiles(docs)
    assert model[0] == ["de", "en"]
    rows = [(1, None, "a", 0), (2, "", "a", 0), (3, "123 ...", "a", 0), (4, "the other and the one " * 100_000, None, None), (5, "der", "a", 0), (5, "der", "a", 0)]
    got = G.identify(spark.createDataFrame(rows, "doc_id long, text string, pred_lang string, cosine int"), model)
    assert got.columns == ["doc_id", "text", "pred_lang", "cosine", "margin"]
    found = [(r["doc_id"], r["pred_lang"]) for r in got.collect()]
    assert sorted(found) == [(1, None), (2, None), (3, None), (4, "en"), (5, "de"), (5, "de")]
    assert {r["cosine"] for r in got.collect() if r["pred_lang"] is None} == {0}
    assert G.identify(docs.limit(0), model).count() == 0
    nothing = G.profiles(docs.limit(0))
    assert [r["pred_lang"] for r in G.identify(docs, nothing).collect()] == [None] * 5


def test_one_language_has_no_margin(spark):
    docs = spark.createDataFrame([(1, "abc def", "q")], "doc_id long, text string, lang string")
    (r,) = G.identify(docs, G.profiles(docs)).collect()
    assert r["pred_lang"] == "q" and r["margin"] is None and abs(r["cosine"] - 1) < 1e-6
