"""Indexing folders, incremental maintenance, the store, and the public functions."""

import json
import os

import pytest

from lodestone import api, engine
from lodestone.operators import maintain
from lodestone.schemas import CHUNKS, conform
from lodestone.sources import corpus
from lodestone.sources.store import IndexStore, StoreError


def write(folder, pages):
    """pages: id -> (text, fields of the metadata)."""
    os.makedirs(folder, exist_ok=True)
    meta = {}
    for page, (text, fields) in pages.items():
        name = fields.get("local_path", f"page {page}+%20.md")
        meta[page] = {"local_path": name, "title": f" Title {page} ", "space_key": "ENG", "last_modified_at": "2026-01-01T00:00:00Z", "extra": 1} | fields
        if text is not None:
            with open(os.path.join(folder, name), "w", newline="") as f:
                f.write(text)
    with open(os.path.join(folder, "metadata.json"), "w") as f:
        json.dump({"pages": meta, "other": []}, f)
    return str(folder)


@pytest.fixture
def folder(tmp_path):
    return write(tmp_path / "in", {"1": ("# banana\n\nbanana one\n\n## two\n\nbanana two", {}), "2": ("---\r\na: b\r\n---\r\nkept", {}), "10": ("", {"title": None, "space_key": " OPS "})})


def test_preflight(tmp_path, folder):
    assert corpus.preflight(folder).page_count == 3
    empty = tmp_path / "empty"
    empty.mkdir()
    cases = [
        ("missing required file", str(empty)), ("does not exist", str(tmp_path / "none")), ("not a directory", os.path.join(folder, "metadata.json")), ("empty pages corpus", write(tmp_path / "a", {})),
        ("not found", write(tmp_path / "b", {"1": (None, {})})), ("local_path is empty", write(tmp_path / "c", {"1": (None, {"local_path": " "})})), ("points to a directory", write(tmp_path / "d", {"1": (None, {"local_path": "."})})),
    ]
    for message, path in cases:
        with pytest.raises(corpus.PreflightError, match=message):
            corpus.preflight(path)
    (empty / "metadata.json").write_text("{")
    with pytest.raises(corpus.PreflightError, match="parse"):
        corpus.preflight(str(empty))


def test_documents_of_a_folder(spark, folder):
    rows = {r["id"]: r for r in corpus.load_documents(corpus.read_pages(spark, folder)).collect()}
    assert rows["1"]["chunks"] == ["# banana\n\nbanana one", "## two\n\nbanana two"] and rows["1"]["title"] == "Title 1"
    assert rows["2"]["chunks"] == ["---\na: b\n---\nkept"]  # the block is looked for before line ends are changed
    assert rows["10"]["chunks"] == [] and rows["10"]["title"] == "" and rows["10"]["space_key"] == "OPS"


def counts(r):
    return r.inserted, r.updated, r.skipped, r.deleted, r.chunk_writes, r.embedding_writes


def test_incremental_runs(spark, tmp_path, folder):
    path = str(tmp_path / "deep" / "index")
    first = engine.index(spark, folder, path)
    assert counts(first) == (3, 0, 0, 0, 3, 3) and first.status == "phase4-ready" and first.incremental and len(first.run_id) == 16
    assert first.embedding_name == "hash-local" and first.embedding_source == "hash-fallback"
    # another title alone changes nothing; another text does
    write(folder, {"1": ("# banana\n\nbanana one\n\n## two\n\nbanana two", {"title": "New"}), "2": ("cherry", {}), "3": ("apple", {})})
    second = engine.index(spark, folder, path)
    assert counts(second) == (1, 1, 1, 1, 2, 2) and second.db_stats.runs == 2
    store = IndexStore(spark, path)
    assert {r["id"]: r["title"] for r in store.table("documents").collect()} == {"1": "Title 1", "2": "Title 2", "3": "Title 3"}
    assert sorted(r["id"] for r in store.table("chunks").collect()) == ["1:000000", "1:000001", "2:000000", "3:000000"]
    assert {r["chunk_id"] for r in store.table("postings").collect()} == {r["chunk_id"] for r in store.table("embeddings").collect()}
    r = engine.query(spark, path, engine.Request("cherry", "lexical"))
    assert [x.chunk_id for x in r.results] == ["2:000000"]
    # the statistics don't count what was deleted: a fresh index scores alike
    engine.index(spark, folder, str(tmp_path / "fresh"), rebuild=True)
    again = engine.query(spark, str(tmp_path / "fresh"), engine.Request("cherry", "lexical"))
    assert again.results[0].lexical == r.results[0].lexical
    third = engine.index(spark, folder, path, rebuild=True)
    assert counts(third) == (3, 0, 0, 0, 4, 4) and third.db_stats.runs == 1 and third.rebuild
    assert engine.stats(spark, path) == third.db_stats


def test_deleted_pages_come_back(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "index")
    for pages in ({"a": ("apple", {}), "b": ("pear", {})}, {"a": ("apple", {})}, {"a": ("apple", {}), "b": ("pear", {})}):
        engine.index(spark, write(folder, pages), path)
    assert [x.chunk_id for x in engine.query(spark, path, engine.Request("pear", "lexical")).results] == ["b:000000"]


class Broken:
    name, dimension = "broken", 4

    def embed(self, df, text_col, out_col="vector"):
        raise RuntimeError("no service")

    def embed_one(self, spark, text):
        return []


def test_failed_run_leaves_the_index_and_stays_in_the_record(spark, tmp_path, folder):
    path = str(tmp_path / "index")
    engine.index(spark, folder, path)
    write(folder, {"1": ("other", {})})
    with pytest.raises(engine.IndexError_, match="no service"):
        engine.index(spark, folder, path, provider=Broken())
    store = IndexStore(spark, path)
    assert store.table("chunks").count() == 3
    assert sorted((r["completed_at"] is None) for r in store.runs().collect()) == [False, True]
    assert engine.index(spark, folder, path).updated == 1  # and nothing is taken for embedded that isn't


def test_validation(spark, tmp_path, folder):
    for args, message in ((("", "x"), "folder"), ((folder, " "), "--db"), ((str(tmp_path / "none"), "x"), "does not exist")):
        with pytest.raises(engine.IndexError_, match=message):
            engine.index(spark, *args)
    with pytest.raises(StoreError, match="no index"):
        engine.query(spark, str(tmp_path / "none"), engine.Request("x", "lexical"))
    with pytest.raises(engine.QueryError):
        engine.query(spark, " ", engine.Request("x"))
    with pytest.raises(StoreError, match="no index"):
        engine.stats(spark, str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none")


def test_runs(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.create()
    run = store.begin_run("")
    (row,) = store.runs().collect()
    assert row["mode"] == "incremental" and row["completed_at"] is None
    store.complete_run(run)
    assert store.runs().first()["completed_at"]
    for bad in ("", "feedfeedfeedfeed"):
        with pytest.raises(StoreError):
            store.complete_run(bad)
    assert list(vars(store.stats()).values()) == [1, 1, 0, 0, 0]


def test_older_tables_get_missing_columns(spark):
    old = spark.createDataFrame([("c", "d", 0, "t", "h")], "id string, document_id string, chunk_index int, text string, chunk_hash string")
    assert conform(old, CHUNKS).first()["updated_at"] == ""


def test_embedding_upsert_validates(spark):
    kind = "chunk_id string, dimension int, vector array<float>"
    old = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [2.0])], kind)
    out = maintain.upsert_embeddings(old, spark.createDataFrame([("b", 2, [3.0, 4.0]), ("c", 1, [5.0]), (" ", 1, [6.0])], kind))
    assert sorted((r["chunk_id"], list(r["vector"])) for r in out.collect()) == [("a", [1]), ("b", [3, 4]), ("c", [5])]
    for bad in (("x", 0, []), ("x", 2, [1.0])):
        with pytest.raises(ValueError):
            maintain.upsert_embeddings(old, spark.createDataFrame([bad], kind))


def test_deleting_with_no_pages_deletes_all(spark):
    old = spark.createDataFrame([("a",), ("b",)], "id string")
    stays, gone = maintain.delete_not_in(old, old.limit(0))
    assert stays.count() == 0 and gone.count() == 2


def test_public_functions():
    assert api.OUTPUT_SCHEMA_VERSION == "1" and api.query is engine.query and api.index is engine.index


def test_a_rebuild_touches_nothing_else(spark, tmp_path, folder):
    before = {f: open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder)}
    with pytest.raises(StoreError, match="is no index"):
        engine.index(spark, folder, folder, rebuild=True)
    assert {f: open(os.path.join(folder, f), "rb").read() for f in os.listdir(folder)} == before
    path = str(tmp_path / "index")
    engine.index(spark, folder, path)
    with open(os.path.join(path, "note"), "w") as f:
        f.write("mine")
    engine.index(spark, folder, path, rebuild=True)
    assert open(os.path.join(path, "note")).read() == "mine"


def test_a_rebuild_that_fails_leaves_the_old_index(spark, tmp_path, folder):
    path = str(tmp_path / "index")
    engine.index(spark, folder, path)
    with pytest.raises(Exception):
        engine.index(spark, folder, path, rebuild=True, provider=Broken())
    assert engine.query(spark, path, engine.Request("banana", "lexical")).results and engine.stats(spark, path).chunks == 3


def test_blank_page_ids_are_refused(spark, tmp_path):
    with pytest.raises(engine.IndexError_, match="blank id"):
        engine.index(spark, write(tmp_path / "in", {" ": ("text", {})}), str(tmp_path / "index"))


def test_the_last_record_of_a_chunk_counts(spark):
    kind = "chunk_id string, dimension int, vector array<double>"
    out = maintain.upsert_embeddings(spark.createDataFrame([("a", 1, [0.0])], kind), spark.createDataFrame([("a", 1, [1.0]), ("a", 1, [2.0])], kind).coalesce(1))
    assert [tuple(r) for r in out.collect()] == [("a", 1, [2.0])]
