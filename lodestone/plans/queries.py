"""The engine's registered queries: each operator applied to whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import embedding, engine
from lodestone.functions import text as T
from lodestone.functions.vectors import cosine, hash_embedding
from lodestone.operators import fusion, lexical, maintain
from lodestone.operators.candidates import Frames, search_lexical, search_vector
from lodestone.operators.filters import Filters
from lodestone.schemas import TABLES
from lodestone.scratch import written
from lodestone.sources import corpus

from .oracles import FUSED_QUERY, K, QUERIES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as pages of a corpus."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d = F.col("doc_id")
    stamp = F.concat(F.lit("2025-"), two(d % 12 + 1), F.lit("-"), two(d % 28 + 1), F.lit("T"), two(d % 24), F.lit(":00:00Z"))
    return read(spark, sf_dir, "documents").select(d.cast("string").alias("page_id"), F.concat(F.lit("doc "), d).alias("title"), F.concat(d, F.lit(".md")).alias("local_path"), F.col("lang").alias("space_key"), F.col("source").alias("source_url"), stamp.alias("last_modified_at"), F.col("text").alias("body"))


_built: dict[tuple[str, str], Frames] = {}


def frames(spark: SparkSession, sf_dir: str) -> Frames:
    """The index of the documents table, built once a session and folder as an indexing run builds it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        documents = written(corpus.load_documents(pages(spark, sf_dir)), "pages")
        empty = {t: spark.createDataFrame([], s) for t, s in TABLES.items()}
        tables, _, chunks = engine.update_tables(empty, documents, embedding.HashProvider(), "2025-01-01T00:00:00Z", lambda df: written(df, "new"))
        tables["postings"] = lexical.laid_out(tables["postings"], chunks.count())
        t = {n: df if n == "chunks" else written(df, n) for n, df in tables.items()}  # the chunks are written already
        _built[key] = Frames(t["documents"], t["chunks"], t["embeddings"], t["postings"], t["lengths"], written(lexical.corpus_stats(t["lengths"]), "stats"))
    return _built[key]


def clean_content_hash(spark, sf_dir):
    clean = T.clean(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", T.content_hash(clean).alias("content_hash"), F.length(clean).cast("long").alias("n_clean"))


def conversation_pages(spark, sf_dir) -> DataFrame:
    turn = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    body = F.array_join(F.transform(turn, lambda t: F.concat(F.lit("## turn "), t["turn"], F.lit(" "), t["role"], F.lit("\n\n"), t["text"])), "\n\n")
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(body.alias("body"))


def sections_from_headings(spark, sf_dir):
    rows = conversation_pages(spark, sf_dir).select("conv_id", F.posexplode(T.sections(T.clean(F.col("body")))).alias("section", "text"))
    return rows.select("conv_id", F.col("section").cast("long").alias("section"), T.content_hash(F.col("text")).alias("section_hash"))


def chunk_windows(spark, sf_dir):
    rows = corpus.explode_chunks(corpus.load_documents(pages(spark, sf_dir)))
    return rows.select("id", "document_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_hash", F.length("text").cast("long").alias("n_chars"))


def term_frequencies(spark, sf_dir):
    p = frames(spark, sf_dir).postings.filter("col = 'text'")
    return p.groupBy("term").agg(F.sum(F.size("positions")).cast("long").alias("n"))


def document_frequencies(spark, sf_dir):
    return lexical.document_frequencies(frames(spark, sf_dir).postings).select("term", "n_chunks", "n_occurrences")


def corpus_stats(spark, sf_dir):
    return frames(spark, sf_dir).stats.select("n_rows", F.round("avg_tokens", 9).alias("avg_tokens"))


def _top(found: DataFrame) -> DataFrame:
    return found.select("chunk_id", "page_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round("score", 6).alias("score"))


def _bm25(text: str, filters: Filters):
    return lambda spark, sf_dir: _top(search_lexical(frames(spark, sf_dir), text, filters))


def cosine_topk(spark, sf_dir, label: int | None = None):
    rows = read(spark, sf_dir, "embeddings")
    first = F.broadcast(rows.orderBy("vec_id").select(F.col("embedding").alias("q")).limit(1))  # one row
    rows = rows if label is None else rows.filter(F.col("label") == label)
    scored = rows.crossJoin(first).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(K)


def hash_embeddings(spark, sf_dir):
    v = read(spark, sf_dir, "documents").select("doc_id", hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", *(F.round(F.col("v")[i].cast("double"), 5).alias(f"v{i}") for i in (0, 31, 100, 255)), F.size("v").cast("long").alias("dimension"))


def _request(**changes) -> engine.Request:
    return engine.Request(**{"text": FUSED_QUERY, "mode": "hybrid", "fusion": "weighted", "alpha": 0.7, "top_k": 20, "candidate_k": K} | changes).normalized()


def _ranked(spark, sf_dir, **changes) -> DataFrame:
    r = _request(**changes)
    return engine.plan(frames(spark, sf_dir), r, embedding.hash_vector(r.text))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select("chunk_id", "page_id", F.col("rank").cast("long").alias("rank"), F.round("lexical", 4).alias("lexical"), F.round("vector", 4).alias("vector"), F.round("fused", 4).alias("fused"), "fusion")


def _fused(**changes):
    return lambda spark, sf_dir: _shown(_ranked(spark, sf_dir, **changes))


def minmax_lexical(spark, sf_dir):
    found = search_lexical(frames(spark, sf_dir), FUSED_QUERY, Filters(candidate=K))
    return fusion.normalize_scores(found).select("chunk_id", F.round("norm", 6).alias("norm"))


def vector_channel(spark, sf_dir):
    found = search_vector(frames(spark, sf_dir), embedding.hash_vector(FUSED_QUERY), Filters(candidate=K))
    return found.select("chunk_id", F.round("score", 5).alias("score"))


def paged_results(spark, sf_dir):
    return _shown(fusion.page(_ranked(spark, sf_dir), 5, 10))


def expanded_context(spark, sf_dir):
    f = frames(spark, sf_dir)
    hits = fusion.expand(fusion.page(_ranked(spark, sf_dir), 0, 10), f.chunks, 1, T.trim)
    return hits.select("chunk_id", F.col("rank").cast("long").alias("rank"), T.content_hash(F.col("chunk_text")).alias("text_hash"), *(F.col(c).cast("long").alias(c) for c in ("context_start", "context_end", "context_count")))


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(new, old) documents: the Spanish are new, the German gone, the French changed, all others as they were."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", "text")
    old = docs.filter("lang <> 'es'").select("id", "lang", T.content_hash(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return docs.filter("lang <> 'de'").select("id", "lang", T.content_hash(F.col("text")).alias("content_hash")), old


def incremental_diff(spark, sf_dir):
    return maintain.document_status(*_versions(spark, sf_dir))


def stale_delete(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    stays, gone = maintain.delete_not_in(old, new.select("id"))
    return stays.select("id", F.lit(False).alias("deleted")).union(gone.select("id", F.lit(True)))


def merged_documents(spark, sf_dir):
    new, old = _versions(spark, sf_dir)
    return maintain.merge_documents(new, old, maintain.document_status(new, old)).select("id", "content_hash")


def embedding_upsert(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.size("embedding").alias("dimension"), F.col("embedding").alias("vector"), "label")
    new = rows.filter("label = 3").withColumn("vector", F.transform("vector", lambda x: -x))
    out = maintain.upsert_embeddings(rows.filter("label <> 4"), new)
    return out.select("chunk_id", F.col("dimension").cast("long").alias("dimension"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


def index_stats(spark, sf_dir):
    f = frames(spark, sf_dir)
    one = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in (("documents", f.documents), ("chunks", f.chunks), ("embeddings", f.embeddings))]
    return one[0].crossJoin(one[1]).crossJoin(one[2])  # one row each


REGISTERED = {
    "clean_content_hash": clean_content_hash, "sections_from_headings": sections_from_headings, "chunk_windows": chunk_windows, "term_frequencies": term_frequencies, "document_frequencies": document_frequencies,
    "corpus_stats": corpus_stats, **{name: _bm25(text, filters) for name, (text, filters) in QUERIES.items()},
    "cosine_topk": cosine_topk, "cosine_topk_filtered": lambda s, d: cosine_topk(s, d, 3), "hash_embedding": hash_embeddings, "minmax_lexical": minmax_lexical, "vector_channel": vector_channel,
    "fuse_weighted": _fused(), "fuse_rrf": _fused(fusion="rrf"), "mode_lexical": _fused(mode="lexical"), "mode_vector": _fused(mode="vector"), "paged_results": paged_results, "expanded_context": expanded_context,
    "incremental_diff": incremental_diff, "stale_delete": stale_delete, "merged_documents": merged_documents, "embedding_upsert": embedding_upsert, "index_stats": index_stats,
}
