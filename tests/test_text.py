"""Cleaning, sections, windows and hashes as column expressions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T

PLAIN = T._PLAIN_SPACE


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def model_clean(s):
    if s.startswith("---\n"):
        k = s.find("\n---\n", 4)
        if k >= 0:
            s = s[k + 5 :]
    return s.replace("\r\n", "\n").strip(PLAIN)


def model_sections(s):
    out, now = [], []
    for line in s.split("\n"):
        if line.strip(PLAIN).startswith("#") and now:
            out.append("\n".join(now))
            now = []
        now.append(line)
    out.append("\n".join(now))
    return [x for x in (o.strip(PLAIN) for o in out) if x]


def model_chunks(s, size, overlap):
    out = []
    for sec in model_sections(s):
        at = 0
        while True:
            out.append(sec[at : at + size].strip(PLAIN))
            if at + size >= len(sec):
                break
            at += size - overlap
    return [x for x in out if x]


def test_front_matter(spark):
    given = ["---\na: b\n---\nbody", "---\n---\nbody", "---\n---\nx\n---\ny", "---\r\na\r\n---\r\nbody", "body\n---\n", "", None]
    assert evaluate(spark, given, T.clean) == ["body", "---\n---\nbody", "y", "---\na\n---\nbody", "body\n---", "", None]


def test_trim_takes_unicode_space_only(spark):
    given = ["　 a b  \n", "\x1ca", "​a", "\t\x0b\x0c\r\n", "a\n"]
    assert evaluate(spark, given, T.trim) == ["a b", "\x1ca", "​a", "", "a"]


def test_any_line_that_begins_with_a_hash_opens_a_section(spark):
    text = "preamble\n# one\nx\n  #tag\n```\n#!sh\n```\n\n##\n\n"
    assert evaluate(spark, [text], T.sections) == [["preamble", "# one\nx", "#tag\n```", "#!sh\n```", "##"]]


@pytest.mark.parametrize("length,count", [(0, 0), (1, 1), (1200, 1), (1201, 2), (2200, 2), (2201, 3), (3200, 3)])
def test_window_counts(spark, length, count):
    assert len(evaluate(spark, ["x" * length], T.chunks)[0]) == count


def test_windows_count_code_points(spark):
    assert evaluate(spark, ["😀é😀é😀"], lambda c: T.chunks(c, 3, 1)) == [["😀é😀", "😀é😀"]]


@pytest.mark.parametrize("size,overlap,expected", [(0, 5, (1200, 5)), (40, -3, (40, 0)), (40, 40, (40, 20)), (40, 90, (40, 20)), (1, 1, (1, 0))])
def test_window_bounds(size, overlap, expected):
    assert T.window_bounds(size, overlap) == expected


def test_random_texts_equal_a_plain_model(spark):
    rng = random.Random(5)
    parts = ["a", "b ", "# ", "#", "\n", "\r\n", "---\n", " ", "　", "😀", "é", "word ", "\n---\n", "\t", "  "]
    given = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(1500)]
    given += ["---\n" + g for g in given[:200]]
    assert evaluate(spark, given, T.clean) == [model_clean(g) for g in given]
    assert evaluate(spark, given, lambda c: T.chunks(T.clean(c), 30, 7)) == [model_chunks(model_clean(g), 30, 7) for g in given]


def test_identities(spark):
    assert evaluate(spark, ["p"], lambda c: T.chunk_id(c, F.lit(7))) == ["p:000007"]
    assert evaluate(spark, ["p"], lambda c: T.chunk_id(c, F.lit(1234567))) == ["p:1234567"]
    assert evaluate(spark, ["é"], T.content_hash) == [hashlib.sha256("é".encode()).hexdigest()]


def test_summaries_are_cut_by_bytes():
    assert T.summarize("a\nb", 240) == "a b"
    assert T.summarize("x" * 300, 240) == "x" * 237 + "..."
    assert T.summarize("é" * 200, 240).endswith("�...")
    assert not re.search("\n", T.summarize("a\n" * 300, 240))


def test_trim_is_linear(spark):
    import time

    rows = ["a" + " " * 1_000_000 + "b", " 　" * 500_000 + "x" + "\t\n" * 500_000]
    began = time.perf_counter()
    assert evaluate(spark, rows, T.trim) == [rows[0], "x"] and time.perf_counter() - began < 20
