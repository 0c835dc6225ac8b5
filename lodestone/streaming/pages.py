"""Pages that arrive as a stream, indexed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone import embedding, engine
from lodestone.functions import text as T
from lodestone.sources import corpus
from lodestone.sources.store import IndexStore, now

_KEPT = ("id", "page_id", "title", "local_path", "space_key", "source_url", "last_modified_at", "content_hash")


def upsert_pages(store: IndexStore, pages: DataFrame, provider: embedding.Provider | None = None, chunk_size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> None:
    """Inserts or updates pages (read_pages' columns) in an index; pages that aren't given stay.

    Of several rows of one page the one modified last counts, and of those the greatest body. A batch
    without rows changes nothing, and so does a batch that is indexed again.
    """
    if pages.isEmpty():
        return
    latest = pages.groupBy("page_id").agg(F.max_by(F.struct(*pages.columns), F.struct("last_modified_at", "body")).alias("p")).select("p.*")
    given = corpus.load_documents(latest, chunk_size, overlap)
    frames = {t: store.table(t) for t in ("documents", "chunks", "embeddings", "postings", "lengths")}
    others = frames["documents"].join(given.select("id"), "id", "left_anti").select(*_KEPT, F.array().cast("array<string>").alias("chunks"))
    documents = given.select(*_KEPT, "chunks").unionByName(others)
    tables, _, _ = engine.update_tables(frames, documents, provider or embedding.from_environment().provider, now())
    store.commit(tables)


def index_stream(pages: DataFrame, path: str, checkpoint: str, provider: embedding.Provider | None = None, **trigger) -> StreamingQuery:
    """Starts a query that keeps the index at path up to date with a stream of pages; trigger as in writeStream.trigger, availableNow by default."""
    store = IndexStore(pages.sparkSession, path)
    store.create()
    writer = pages.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return writer.foreachBatch(lambda batch, _: upsert_pages(store, batch, provider)).start()
