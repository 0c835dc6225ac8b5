"""Small indexes made of rows."""

from pyspark.sql import functions as F

from lodestone import embedding
from lodestone.functions import text as T
from lodestone.functions.vectors import hash_embedding
from lodestone.operators import lexical
from lodestone.operators.candidates import Frames

ROWS = [("p1", 0, "Alpha", "apple and pear"), ("p2", 0, "Banana", "banana banana yellow"), ("p3", 0, "Middle", "left neighbor"), ("p3", 1, "Middle", "middleterm center"), ("p3", 2, "Middle", "right neighbor")]


def frames(spark, rows=ROWS, dates=None, spaces=None, dimension=8):
    """Frames of (page, chunk index, title, text)."""
    dates, spaces = dates or {}, spaces or {}
    pages = {p: (p, p, t, f"{p}.md", spaces.get(p, "ENG"), "", dates.get(p, "2026-01-01T00:00:00Z"), "", "") for p, _, t, _ in rows}
    documents = spark.createDataFrame(list(pages.values()), "id string, page_id string, title string, local_path string, space_key string, source_url string, last_modified_at string, content_hash string, updated_at string")
    chunks = spark.createDataFrame([(p, i, x) for p, i, _, x in rows], "document_id string, chunk_index int, text string").withColumn("id", T.chunk_id(F.col("document_id"), F.col("chunk_index")))
    embeddings = chunks.select(F.col("id").alias("chunk_id"), F.lit("hash-local").alias("model"), F.lit(dimension).alias("dimension"), hash_embedding(F.col("text"), dimension).alias("vector"))
    searchable = lexical.searchable(chunks, documents)
    lengths = lexical.lengths(searchable)
    return Frames(documents, chunks, embeddings, lexical.postings(searchable).cache(), lengths.cache(), lexical.corpus_stats(lengths))


PROVIDER = embedding.HashProvider(8)
