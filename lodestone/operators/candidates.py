"""The two retrieval channels: filtered top candidates by BM25 and by cosine."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.functions.vectors import cosine

from . import lexical
from .filters import Filters

DEFAULT_CANDIDATES = 50
_DOCUMENT = ("document_id", "page_id", "title", "local_path", "space_key", "source_url", "last_modified_at")


@dataclass(frozen=True)
class Frames:
    """The tables of one index; `stats` is lexical.corpus_stats of `lengths`."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def _places(frames: Frames, filters: Filters) -> DataFrame:
    """(chunk_id, page_id, chunk_index) of the chunks whose document passes."""
    docs = filters.apply(frames.documents).select(F.col("id").alias("document_id"), "page_id")
    return frames.chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index").join(docs, "document_id").drop("document_id")


def _described(frames: Frames, top: DataFrame) -> DataFrame:
    """top(chunk_id, score) with what the chunk and its document say. top has few rows, by a limit, so it is broadcast."""
    chunks = frames.chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", F.col("text").alias("chunk_text"))
    hit = chunks.join(F.broadcast(top), "chunk_id")
    docs = frames.documents.select(F.col("id").alias("document_id"), *_DOCUMENT[1:])
    return docs.join(F.broadcast(hit), "document_id").select("chunk_id", *_DOCUMENT, "chunk_index", "chunk_text", "score")


def search_lexical(frames: Frames, text: str, filters: Filters = Filters()) -> DataFrame:
    """The best candidates by BM25 among chunks that pass; ties in order of page and chunk. Blank text has none.

    Filters apply before the limit, while the statistics are those of all chunks.
    """
    query = strip(text)
    scored = lexical.score(frames.postings, frames.lengths, frames.stats, query)
    k = filters.candidate if filters.candidate > 0 else DEFAULT_CANDIDATES
    top = scored.join(_places(frames, filters), "chunk_id").orderBy(F.desc("score"), "page_id", "chunk_index").limit(k)
    return _described(frames, top.select("chunk_id", "score"))


def search_vector(frames: Frames, query: Sequence[float], filters: Filters = Filters()) -> DataFrame:
    """The best candidates by cosine among chunks that pass; ties by chunk id. An empty query has none.

    Vectors of any model count; one of another length scores 0.
    """
    rows = frames.embeddings.filter((F.col("dimension") > 0) & (F.size("vector") == F.col("dimension")))
    if filters.condition() is not None:
        rows = rows.join(_places(frames, filters).select("chunk_id"), "chunk_id", "left_semi")
    if not len(query):
        rows = rows.filter(F.lit(False))
    k = filters.candidate if filters.candidate > 0 else DEFAULT_CANDIDATES
    single = array("f", query) or array("f", [0.0])  # in single precision, as vectors are
    square = reduce(lambda s, x: s + x * x, single, 0.0)
    top = rows.select("chunk_id", cosine(F.col("vector"), F.lit(single.tolist()), square).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    return _described(frames, top)
