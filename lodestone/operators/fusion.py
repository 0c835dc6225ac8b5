"""Normalisation, fusion, ranking, paging and expansion of candidates. All of it is over a few hundred rows at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARED = ("document_id", "page_id", "title", "local_path", "space_key", "source_url", "chunk_text", "chunk_index")


def _all():
    """A window of all rows, which are one channel's candidates."""
    return Window.partitionBy(F.lit(0))


def normalize_scores(candidates: DataFrame, score: str = "score", out: str = "norm") -> DataFrame:
    """candidates with `out`, the score stretched to 0..1; all 1 if they are equal."""
    low, high = F.min(score).over(_all()), F.max(score).over(_all())
    return candidates.withColumn(out, F.when(high == low, 1.0).otherwise((F.col(score) - low) / F.when(high != low, high - low)))


def rank_lexical() -> list[Column]:
    return [F.desc("score"), F.col("page_id"), F.col("chunk_index")]


def rank_vector() -> list[Column]:
    return [F.desc("score"), F.col("chunk_id")]


def fuse(lexical: DataFrame | None, vector: DataFrame | None, mode: str, fusion: str = "weighted", alpha: float = 0.7, rrf_k: int = 60) -> DataFrame | None:
    """One row a chunk with lexical, vector and fused scores and the fusion's name; those not above 0 are dropped.

    A channel that lacks a chunk gives it 0. In mode lexical or vector the channel's own score counts.
    """

    def side(df: DataFrame, s: str, order: list[Column]) -> DataFrame:
        df = normalize_scores(df).withColumn("rank", F.row_number().over(_all().orderBy(*order)))
        return df.select("chunk_id", F.col("norm").alias(s), F.col("rank").alias(f"rank_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in SHARED))

    if lexical is None and vector is None:
        return None
    if vector is None:
        both = side(lexical, "lexical", rank_lexical()).withColumns({"vector": F.lit(0.0), "rank_vector": F.lit(None).cast("int")})
        shared = [F.col(f"lexical_{c}").alias(c) for c in SHARED]
    elif lexical is None:
        both = side(vector, "vector", rank_vector()).withColumns({"lexical": F.lit(0.0), "rank_lexical": F.lit(None).cast("int")})
        shared = [F.col(f"vector_{c}").alias(c) for c in SHARED]
    else:
        both = side(lexical, "lexical", rank_lexical()).join(side(vector, "vector", rank_vector()), "chunk_id", "full_outer")
        shared = [F.coalesce(f"lexical_{c}", f"vector_{c}").alias(c) for c in SHARED]
    lex, vec = F.coalesce("lexical", F.lit(0.0)), F.coalesce("vector", F.lit(0.0))
    if mode in ("lexical", "vector"):
        fused, name = (lex if mode == "lexical" else vec), mode
    elif fusion == "rrf":
        fused, name = F.coalesce(1.0 / (rrf_k + F.col("rank_lexical")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("rank_vector")), F.lit(0.0)), "rrf"
    else:
        fused, name = F.lit(float(alpha)) * lex + F.lit(1 - float(alpha)) * vec, "weighted"
    return both.select("chunk_id", *shared, lex.alias("lexical"), vec.alias("vector"), fused.alias("fused"), F.lit(name).alias("fusion")).filter("fused > 0")


def rank(fused: DataFrame, top_k: int) -> DataFrame:
    """The top_k rows by fused score, then chunk id, with rank (from 1) and total (how many they are)."""
    top = fused.orderBy(F.desc("fused"), "chunk_id").limit(top_k)
    return top.withColumn("rank", F.row_number().over(_all().orderBy(F.desc("fused"), "chunk_id"))).withColumn("total", F.count(F.lit(1)).over(_all()).cast("int"))


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def chunk_window(chunks: DataFrame, document_id: str, index: int, expand: int) -> DataFrame:
    """(chunk_index, text) of the chunks of a document within `expand` of index, in order."""
    if not document_id.strip():
        raise ValueError("document id is required")
    e = max(expand, 0)
    near = (F.col("document_id") == document_id) & F.col("chunk_index").between(max(index - e, 0), index + e)
    return chunks.filter(near).select("chunk_index", "text").orderBy("chunk_index")


def expand(hits: DataFrame, chunks: DataFrame, by: int, trim) -> DataFrame:
    """hits with chunk_text of the whole window around each, the text alone in base_chunk_text, and the window's bounds.

    One band join on the hit's document for all hits; hits are a page of results, so they are broadcast.
    """
    near = chunks.select(F.col("document_id").alias("d"), F.col("chunk_index").alias("i"), "text")
    key = F.broadcast(hits.select("chunk_id", "document_id", "chunk_index"))
    band = near.join(key, (F.col("d") == F.col("document_id")) & F.col("i").between(F.greatest(F.col("chunk_index") - by, F.lit(0)), F.col("chunk_index") + by))
    window = band.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("w"))
    joined = F.array_join(F.transform("w.text", trim), "\n\n")
    window = window.select("chunk_id", joined.alias("wide"), F.array_min("w.i").alias("context_start"), F.array_max("w.i").alias("context_end"), F.size("w").alias("context_count"))
    out = hits.join(window, "chunk_id", "left")
    return out.withColumn("base_chunk_text", F.when(F.col("wide").isNotNull(), F.col("chunk_text"))).withColumn("chunk_text", F.coalesce("wide", "chunk_text")).drop("wide")
