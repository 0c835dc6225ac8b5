"""Pages that arrive as a stream."""

from lodestone import engine
from lodestone.sources.store import IndexStore
from lodestone.streaming.pages import index_stream, upsert_pages

COLUMNS = "page_id string, title string, local_path string, space_key string, source_url string, last_modified_at string, body string"


def page(i, body, at="2026-01-01T00:00:00Z"):
    return (str(i), f"T{i}", f"{i}.md", "ENG", "", at, body)


def test_batches_insert_update_and_keep(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    batches = [[page(1, "apple"), page(2, "pear")], [page(2, "plum", "2026-01-02T00:00:00Z"), page(2, "old", "2026-01-01T12:00:00Z"), page(3, "")], [page(1, "apple")]]
    for rows in batches:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(source)
        index_stream(spark.readStream.schema(COLUMNS).parquet(source), path, str(tmp_path / "state")).awaitTermination()
    found = {q: [r.chunk_id for r in engine.query(spark, path, engine.Request(q, "lexical")).results] for q in ("apple", "pear", "plum", "old")}
    assert found == {"apple": ["1:000000"], "pear": [], "plum": ["2:000000"], "old": []}
    stats = IndexStore(spark, path).stats()
    assert (stats.documents, stats.chunks, stats.embeddings) == (3, 2, 2)


def test_empty_batch_changes_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.create()
    upsert_pages(store, spark.createDataFrame([], COLUMNS))
    assert store.stats().documents == 0
