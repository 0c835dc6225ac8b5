"""Incremental maintenance: what is new, changed, unchanged or gone, and the tables that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_status(new: DataFrame, old: DataFrame) -> DataFrame:
    """(id, status): inserted, updated, skipped or deleted, by id and content hash alone.

    A document with the same hash is skipped even if its title or dates differ.
    """
    a = new.select("id", F.col("content_hash").alias("a"))
    b = old.select("id", F.col("content_hash").alias("b"))
    status = F.when(F.col("b").isNull(), "inserted").when(F.col("a").isNull(), "deleted").when(F.col("a") == F.col("b"), "skipped").otherwise("updated")
    return a.join(b, "id", "full_outer").select("id", status.alias("status"))


def with_status(status: DataFrame, *which: str) -> DataFrame:
    return status.filter(F.col("status").isin(*which)).select("id")


def merge_documents(new: DataFrame, old: DataFrame, status: DataFrame) -> DataFrame:
    """Old rows of skipped documents, new rows of all others there are."""
    return old.join(with_status(status, "skipped"), "id", "left_semi").unionByName(new.join(with_status(status, "inserted", "updated"), "id", "left_semi"))


def keep_children(old: DataFrame, parent: str, status: DataFrame) -> DataFrame:
    """Rows of old whose document, in column `parent`, is skipped."""
    return old.join(with_status(status, "skipped").withColumnRenamed("id", parent), parent, "left_semi").select(*old.columns)


def delete_not_in(table: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays of table, the ids that go): an empty keep(id) deletes all."""
    return table.join(keep, "id", "left_semi"), table.join(keep, "id", "left_anti").select("id")


class EmbeddingError(ValueError):
    pass


def upsert_embeddings(old: DataFrame, records: DataFrame) -> DataFrame:
    """old with records inserted or replaced by chunk id. Of several records of one chunk the last counts. A blank chunk id is skipped; a dimension that isn't the vector's, or not above 0, is an error."""
    records = records.filter(F.trim("chunk_id") != "")
    bad = records.filter((F.col("dimension") <= 0) | (F.col("dimension") != F.size("vector"))).select("chunk_id", "dimension", F.size("vector").alias("n")).limit(1).collect()
    if bad:
        raise EmbeddingError(f"embedding for chunk {bad[0][0]}: dimension {bad[0][1]}, vector of {bad[0][2]}")
    numbered = records.select(F.struct(*records.columns).alias("record"), F.monotonically_increasing_id().alias("n"))
    records = numbered.groupBy("record.chunk_id").agg(F.max_by("record", "n").alias("record")).select("record.*")
    return old.join(records.select("chunk_id"), "chunk_id", "left_anti").select(*old.columns).unionByName(records.select(*old.columns))
