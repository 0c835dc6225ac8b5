"""Indexing, querying and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import embedding
from lodestone.functions import text as T
from lodestone.operators import fusion, lexical, maintain
from lodestone.operators.candidates import Frames, search_lexical, search_vector
from lodestone.operators.filters import Filters
from lodestone.plans.grammar import QuerySyntaxError
from lodestone.schemas import TABLES
from lodestone.sources import corpus
from lodestone.sources.store import IndexStore, Stats, StoreError, now


class IndexError_(RuntimeError):
    """Indexing failed; the index is as it was, but for the run's record."""


class QueryError(RuntimeError):
    pass


@dataclass(frozen=True)
class Request:
    """A query. Values out of range are replaced by defaults; an alpha that isn't given is 0, and an unknown mode finds nothing."""

    text: str = ""
    mode: str = ""
    fusion: str = ""
    alpha: float = 0.0
    rrf_k: int = 0
    top_k: int = 0
    offset: int = 0
    limit: int = 0
    candidate_k: int = 0
    expand: int = 0
    filters: Filters = field(default_factory=Filters)

    def normalized(self) -> Request:
        top = self.top_k if self.top_k > 0 else 10
        candidates = self.candidate_k if self.candidate_k > 0 else 50
        return replace(
            self, text=T.strip(self.text), top_k=top, offset=max(self.offset, 0), limit=self.limit if self.limit > 0 else top, candidate_k=candidates,
            alpha=self.alpha if 0 <= self.alpha <= 1 else 0.7, rrf_k=self.rrf_k if self.rrf_k > 0 else 60, filters=replace(self.filters, candidate=candidates),
        )


@dataclass(frozen=True)
class Result:
    rank: int
    chunk_id: str
    document_id: str
    page_id: str
    title: str
    local_path: str
    space_key: str
    source_url: str
    chunk_text: str
    chunk_index: int
    lexical: float
    vector: float
    fused: float
    fusion: str
    base_chunk_text: str = ""
    context_start: int = 0
    context_end: int = 0
    context_count: int = 0


@dataclass(frozen=True)
class Response:
    results: list[Result]
    total: int


def plan(frames: Frames, request: Request, query_vector: Sequence[float] | None) -> DataFrame | None:
    """The ranked list, with `rank` and `total`, of a normalized request; None if neither channel runs."""
    r = request
    lex = search_lexical(frames, r.text, r.filters) if r.mode in ("lexical", "hybrid") else None
    vec = search_vector(frames, query_vector or [], r.filters) if r.mode in ("vector", "hybrid") else None
    fused = fusion.fuse(lex, vec, r.mode, r.fusion, r.alpha, r.rrf_k)
    return None if fused is None else fusion.rank(fused, r.top_k)


def search(frames: Frames, request: Request, provider: embedding.Provider | None = None) -> Response:
    """Runs a query over the tables of an index."""
    r = request.normalized()
    if not r.text:
        return Response([], 0)
    provider = provider or embedding.HashProvider()
    spark = frames.chunks.sparkSession
    try:
        vector = provider.embed_one(spark, r.text) if r.mode in ("vector", "hybrid") else None
        ranked = plan(frames, r, vector)
    except QuerySyntaxError as error:
        raise QueryError(f"lexical search: {error}") from error
    except embedding.EmbeddingServiceError as error:
        raise QueryError(f"query embedding: {error}") from error
    if ranked is None:
        return Response([], 0)
    rows = ranked.collect()  # at most top_k
    total = len(rows)
    kept = sorted((x for x in rows if r.offset < x["rank"] <= r.offset + r.limit), key=lambda x: x["rank"])
    if kept and r.expand > 0:
        hits = spark.createDataFrame(kept, ranked.schema)
        kept = sorted(fusion.expand(hits, frames.chunks, r.expand, T.trim).collect(), key=lambda x: x["rank"])
    names = set(Result.__dataclass_fields__)
    return Response([Result(**{k: v for k, v in x.asDict().items() if k in names and v is not None}) for x in kept], total)


def query(spark: SparkSession, path: str, request: Request, provider: embedding.Provider | None = None) -> Response:
    """Runs a query on the index at path, with the provider of the environment unless one is given."""
    if not T.strip(path):
        raise QueryError("query requires a non-empty --db path")
    store = IndexStore(spark, path)
    if not request.normalized().text:
        return Response([], 0)
    return search(store.frames(), request, provider or embedding.from_environment().provider)


def stats(spark: SparkSession, path: str) -> Stats:
    return IndexStore(spark, path).stats()


@dataclass(frozen=True)
class IndexResponse:
    status: str
    incremental: bool
    rebuild: bool
    db_path: str
    embedding_name: str
    embedding_source: str
    embedding_writes: int
    input_folder: str
    metadata_path: str
    page_count: int
    checked_files: int
    inserted: int
    updated: int
    skipped: int
    deleted: int
    chunk_writes: int
    run_id: str
    db_stats: Stats


STATUS = "phase4-ready"


def update_tables(frames: dict[str, DataFrame], documents: DataFrame, provider: embedding.Provider, at: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(new tables, status by document, new chunks) for documents as load_documents gives them.

    Only changed documents are chunked, embedded and tokenised; rows of the unchanged are copied. keep may
    write or cache the new chunks, which most tables are made of. What a chunk's document says goes with it,
    and without old documents all are new, so a first run joins nothing.
    """
    first = frames["documents"].isEmpty()
    status = maintain.document_status(documents, frames["documents"])
    new_docs = documents.drop("chunks").withColumn("updated_at", F.lit(at)).select(*frames["documents"].columns)
    if first:
        changed, docs = documents.filter("id is not null"), new_docs.filter("id is not null")
    else:
        changed = documents.join(maintain.with_status(status, "inserted", "updated"), "id", "left_semi")
        docs = maintain.merge_documents(new_docs, frames["documents"], status)
    rows = keep(corpus.explode_chunks(changed, "title", "page_id", "space_key").withColumn("updated_at", F.lit(at)))
    new_chunks = rows.select(*frames["chunks"].columns)
    kept = maintain.keep_children(frames["chunks"], "document_id", status)
    kept_ids = kept.select(F.col("id").alias("chunk_id"))
    vectors = provider.embed(new_chunks.select(F.col("id").alias("chunk_id"), "text"), "text")
    vectors = vectors.select("chunk_id", F.lit(provider.name).alias("model"), F.size("vector").alias("dimension"), "vector", F.lit(at).alias("updated_at"))
    rows = rows.select(F.col("id").alias("chunk_id"), *lexical.COLUMNS)

    def both(name: str, new: DataFrame) -> DataFrame:
        old = frames[name]
        if first:
            return new.select(*old.columns)
        return old.join(kept_ids, "chunk_id", "left_semi").select(*old.columns).unionByName(new.select(*old.columns))

    tables = {
        "documents": docs, "chunks": new_chunks if first else kept.unionByName(new_chunks), "embeddings": both("embeddings", vectors),
        "postings": both("postings", lexical.postings(rows)), "lengths": both("lengths", lexical.lengths(rows)),
    }
    return tables, status, new_chunks


def index(spark: SparkSession, folder: str, path: str, rebuild: bool = False, provider: embedding.Provider | None = None, chunk_size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> IndexResponse:
    """Brings the index at path up to date with a folder of pages; rebuild starts it anew."""
    if not T.strip(folder):
        raise IndexError_("index requires a non-empty folder")
    if not T.strip(path):
        raise IndexError_("index requires a non-empty --db path")
    try:
        checked = corpus.preflight(folder)
    except corpus.PreflightError as error:
        raise IndexError_(f"index preflight failed: {error}") from error
    store = IndexStore(spark, path)
    if rebuild:
        store.claim()
    store.create()
    run = store.begin_run("rebuild" if rebuild else "incremental")
    chosen = embedding.Chosen(provider, "custom") if provider else embedding.from_environment()
    try:
        documents = corpus.load_documents(corpus.read_pages(spark, folder), chunk_size, overlap)
        # a rebuild starts from empty tables; the old index stays until the new one is whole
        frames = {t: spark.createDataFrame([], TABLES[t]) if rebuild else store.table(t) for t in ("documents", "chunks", "embeddings", "postings", "lengths")}
        documents = documents.persist()
        try:
            tables, status, new_chunks = update_tables(frames, documents, chosen.provider, now())
            counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
            chunk_writes = new_chunks.count()
            store.commit(tables)
            if rebuild:
                store.forget_runs(run)
        finally:
            documents.unpersist()
    except StoreError:
        raise
    except Exception as error:
        raise IndexError_(f"index failed: {error}") from error
    store.complete_run(run)
    return IndexResponse(
        STATUS, not rebuild, rebuild, store.path, chosen.provider.name, chosen.source, chunk_writes, checked.folder, checked.metadata_path, checked.page_count, checked.checked,
        counts.get("inserted", 0), counts.get("updated", 0), counts.get("skipped", 0), counts.get("deleted", 0), chunk_writes, run, store.stats(),
    )
