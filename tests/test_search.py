"""BM25, cosine, filters, fusion, paging and expansion over small indexes."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.engine import QueryError, Request, search
from lodestone.operators import fusion
from lodestone.operators.candidates import search_lexical, search_vector
from lodestone.operators.filters import Filters

from .seeds import PROVIDER, frames


@pytest.fixture(scope="module")
def seed(spark):
    return frames(spark)


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(str(i), 0, "t", "banana" if i < 5 else "grape orange") for i in range(1, 9)]
    dates = {"1": "2026-01-10T00:00:00Z", "2": "", "3": "2026-01-10T23:59:59.5Z", "4": "2026-01-11T00:00:00Z"}
    return frames(spark, rows, dates, {"2": "OPS"})


def ids(df):
    return [r["chunk_id"] for r in df.orderBy(F.desc("score"), "page_id", "chunk_index").collect()]


def found(seed, text, **filters):
    return ids(search_lexical(seed, text, Filters(**filters)))


def test_weighted(seed):
    r = search(seed, Request("banana", "hybrid", "weighted", 0.95), PROVIDER)
    assert r.results[0].chunk_id == "p2:000000" and r.results[0].fusion == "weighted"


def test_rrf_descends(seed):
    r = search(seed, Request("banana", "hybrid", "rrf", rrf_k=60), PROVIDER)
    scores = [x.fused for x in r.results]
    assert len(scores) >= 2 and scores == sorted(scores, reverse=True) and {x.fusion for x in r.results} == {"rrf"}
    assert math.isclose(scores[0], 1 / 61 + [1 / (60 + k) for k, x in enumerate(sorted(r.results, key=lambda x: -x.vector), 1) if x.chunk_id == r.results[0].chunk_id][0])


def test_top_k(seed):
    assert len(search(seed, Request("banana", "lexical", top_k=1), PROVIDER).results) == 1


def test_expansion(seed):
    (hit,) = search(seed, Request("middleterm", "lexical", expand=1), PROVIDER).results
    assert (hit.chunk_id, hit.context_start, hit.context_end, hit.context_count) == ("p3:000001", 0, 2, 3)
    assert hit.base_chunk_text == "middleterm center" and hit.chunk_text == "left neighbor\n\nmiddleterm center\n\nright neighbor"


def test_page_of_results_keeps_global_ranks(seed):
    r = search(seed, Request("neighbor", "lexical", offset=1, limit=1, top_k=10), PROVIDER)
    # equal scores: both are stretched to 1 and stay
    assert r.total == 2 and [x.rank for x in r.results] == [2]


def test_offset_beyond_top_k_finds_nothing(seed):
    r = search(seed, Request("neighbor", "lexical", offset=20, limit=10), PROVIDER)
    assert r.results == [] and r.total == 2


def test_worst_of_several_is_dropped(spark):
    rows = spark.createDataFrame([("a", 10.0, 0), ("b", 0.0, 1)], "chunk_id string, score double, chunk_index int")
    for c in fusion.SHARED:
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(""))
    assert [r["chunk_id"] for r in fusion.fuse(rows, None, "lexical").collect()] == ["a"]


@pytest.mark.parametrize("mode", ["", "both", "LEXICAL"])
def test_unknown_mode_finds_nothing(seed, mode):
    assert search(seed, Request("banana", mode), PROVIDER).results == []


def test_blank_query_finds_nothing(seed):
    r = search(seed, Request(" 　\n", "hybrid"), PROVIDER)
    assert r.results == [] and r.total == 0


def test_syntax_errors_fail_lexical_but_not_vector(seed):
    for mode in ("lexical", "hybrid"):
        with pytest.raises(QueryError, match="syntax error"):
            search(seed, Request("what is x?", mode), PROVIDER)
    assert search(seed, Request("what is x?", "vector", top_k=3), PROVIDER).total == 3


def test_defaults_replace_what_is_out_of_range():
    r = Request(" x ", alpha=7, rrf_k=-1, top_k=0, offset=-4, limit=0, candidate_k=0).normalized()
    assert (r.text, r.alpha, r.rrf_k, r.top_k, r.offset, r.limit, r.candidate_k) == ("x", 0.7, 60, 10, 0, 10, 50)
    assert Request("x").normalized().alpha == 0


def test_boolean_forms(seed):
    assert found(seed, "left neighbor") == ["p3:000000"]
    assert set(found(seed, "apple OR banana")) == {"p1:000000", "p2:000000"}
    assert found(seed, "neighbor NOT left") == ["p3:000002"]
    assert found(seed, "apple or banana") == []
    assert found(seed, '"banana yellow"') == ["p2:000000"] and found(seed, '"yellow banana"') == []
    assert found(seed, "ban*") == ["p2:000000"]
    assert found(seed, "^left") == ["p3:000000"] and found(seed, "^neighbor") == []
    assert found(seed, "NEAR(apple pear, 1)") == ["p1:000000"] and found(seed, "NEAR(apple pear, 0)") == []
    assert found(seed, "title : banana") == ["p2:000000"] and found(seed, "page_id : p1") == ["p1:000000"]
    assert len(found(seed, "eng")) == 5
    assert found(seed, "") == []


def test_bm25_by_hand(seed):
    (row,) = search_lexical(seed, "yellow").collect()
    lengths = [6, 6, 5, 5, 5]  # tokens of text, title, page and space
    n, avg = len(lengths), sum(lengths) / len(lengths)
    idf = math.log((n - 1 + 0.5) / 1.5)
    assert math.isclose(row["score"], idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / avg)), rel_tol=1e-12)
    (twice,) = search_lexical(seed, "yellow yellow").collect()
    assert math.isclose(twice["score"], 2 * row["score"], rel_tol=1e-12)


def test_frequent_terms_have_the_least_weight(seed):
    scores = [r["score"] for r in search_lexical(seed, "eng").collect()]
    assert all(0 < s < 1e-5 for s in scores)


def test_filters(dated):
    assert found(dated, "banana", space_key=" OPS ") == ["2:000000"]
    assert found(dated, "banana", space_key="ops") == []
    assert found(dated, "banana", page_id="4") == ["4:000000"]
    assert found(dated, "banana", to_date="2026-01-10") == ["1:000000", "2:000000", "3:000000"]  # a missing date passes
    assert found(dated, "banana", from_date="2026-01-10") == ["1:000000", "3:000000", "4:000000"]
    assert found(dated, "banana", from_date="2026-01-11", to_date="2026-01-11", space_key="ENG") == ["4:000000"]
    assert {r["page_id"] for r in search_vector(dated, [1.0] * 8, Filters(space_key="OPS")).collect()} == {"2"}


def test_filters_apply_before_the_limit_and_ties_go_by_page(dated):
    assert found(dated, "banana", candidate=2) == ["1:000000", "2:000000"]
    assert found(dated, "banana", candidate=2, from_date="2026-01-10") == ["1:000000", "3:000000"]


def test_vectors_of_another_length_score_nothing(seed):
    rows = search_vector(seed, [1.0, 0.0]).collect()
    assert len(rows) == 5 and all(r["score"] == 0 for r in rows)
    assert search_vector(seed, []).collect() == []


def test_chunk_window(seed):
    assert [r["chunk_index"] for r in fusion.chunk_window(seed.chunks, "p3", 0, 1).collect()] == [0, 1]
    assert [r["chunk_index"] for r in fusion.chunk_window(seed.chunks, "p3", 1, -2).collect()] == [1]
    with pytest.raises(ValueError):
        fusion.chunk_window(seed.chunks, " ", 0, 1)
