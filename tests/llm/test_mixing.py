"""Operator 9."""

import math
import random
from collections import Counter

import pytest

from lodestone.llm import mixing as M

from ..oracle import same


def key(seed, i, w):
    import hashlib

    u = (int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / w if w > 0 else math.inf


def slow(rows, targets, default, budget=1.0, seed=M.SEED):
    """Copies of each row (id, source, tokens, weight), source by source."""
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r)
    total, shares = sum(r[2] or 0 for r in rows), {s: targets.get(s, default) for s in by}
    out = Counter()
    for s, members in by.items():
        if not shares[s]:
            continue
        own = sum(r[2] or 0 for r in members)
        share = math.floor(total * budget * shares[s] / sum(shares.values()))
        epochs, rest = divmod(share, own) if own else (0, share)
        used = 0
        for r in sorted(members, key=lambda r: (key(seed, r[0], 1.0 if r[3] is None else r[3]), r[0] if r[0] is not None else -1)):
            used += r[2] or 0
            n = epochs + (used <= rest)
            if n:
                out[r] += n
    return out


@pytest.mark.parametrize("budget", [0.3, 1.0, 2.7])
def test_brute_force(spark, budget):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randint(0, 50), rng.choice([0.5, 1.0, 2.0, None, 0.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double")
    targets = {"a": 5.0, "b": 0.0}
    got = Counter({tuple(r[:4]): r["copies"] for r in M.mix(df, targets=targets, budget=budget).collect()})
    assert got == slow(rows, targets, 1.0, budget)


def test_whole_table_equals_sql(spark, sf_dir):
    same(M.mixing(spark, sf_dir), M.MIXING_SQL, sf_dir)


def test_shares_meet_the_targets(spark):
    rows = [(i, "ab"[i % 2], 10, 1.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double")
    got = M.mix(df, targets={"a": 3.0, "b": 1.0}).collect()
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["copies"] * 10
    assert tokens == {"a": 15_000, "b": 5_000}
    assert {r["copies"] for r in got if r["source"] == "a"} == {1, 2}  # complete epochs, then a part


def test_heavier_documents_are_chosen_more_often(spark):
    rows = [(i, "a", 1, 2.0 if i % 2 else 0.5) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double")
    got = M.mix(df, targets={"a": 1.0}, budget=0.2).collect()
    odd = sum(r["doc_id"] % 2 for r in got)
    assert len(got) == 800 and odd > 2.8 * (len(got) - odd)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 9), (2, "", 5, -1.0, 9), (None, "z", 0, 1.0, 9), (3, "z", 7, 1.0, 9), (3, "z", 7, 1.0, 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, weight double, copies int")
    got = M.mix(df, targets={})
    assert got.columns == ["doc_id", "source", "n_tokens", "weight", "copies"]
    by = Counter()
    for r in got.collect():
        by[r["doc_id"], r["source"]] += r["copies"]
    # 19 tokens, 9 for each source: "" has 5 tokens, one epoch and no more but the row without tokens; "z" has 14
    assert by == {(1, None): 2, (2, ""): 1, (None, "z"): 1, (3, "z"): 1}
    assert M.mix(df.limit(0)).count() == 0
    for bad in ({"a": -1.0}, {"a": None}):
        with pytest.raises(ValueError):
            M.mix(df, targets=bad)


def test_token_count(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " a  b\n\tc "), (4, "x" * 100_000), (5, "w " * 100_000)], "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(M.token_count("text")).collect()] == [0, 0, 3, 1, 100_000]


def test_stage_repeats_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three", "en", "src0" if i % 4 == 0 else "other", 13) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = M.stage(spark, docs, str(tmp_path))
    n = Counter((r["source"], r["doc_id"]) for r in got.collect())
    assert got.columns == docs.columns
    assert sum(v for (s, _), v in n.items() if s == "src0") == 320 and sum(v for (s, _), v in n.items() if s == "other") == 80


def test_helpers_clash_with_no_column(spark):
    names = ["__key", "__source", "__tokens", "__range", "epochs", "rest", "row", "sum", "copies_"]
    df = spark.createDataFrame([(i, "a", 5, 1.0, *[77] * len(names)) for i in range(4)], "doc_id long, source string, n_tokens int, weight double, " + ", ".join(f"{n} int" for n in names))
    got = M.mix(df, budget=1.5).collect()
    assert len(got) == 4 and all(r[n] == 77 for r in got for n in names) and sum(r["copies"] for r in got) == 6
