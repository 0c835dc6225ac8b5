"""A folder of Markdown pages described by metadata.json."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.functions import text as T

METADATA = "metadata.json"
_FIELDS = ("local_path", "title", "space_key", "source_url", "last_modified_at")


class PreflightError(ValueError):
    pass


@dataclass(frozen=True)
class Preflight:
    folder: str
    metadata_path: str
    page_count: int
    checked: int


def _pages(path: str) -> dict[str, dict[str, str]]:
    with open(path, "rb") as file:
        try:
            pages = json.loads(file.read().decode("utf-8", "replace")).get("pages") or {}
            return {k: {f: _string(v, f) for f in _FIELDS} for k, v in pages.items()}
        except (ValueError, AttributeError, TypeError) as error:
            raise PreflightError(f"parse metadata file {path}: {error}") from error


def _string(record: dict, field: str) -> str:
    value = (record or {}).get(field)
    if value is not None and not isinstance(value, str):
        raise TypeError(f"{field} is no string")
    return value or ""


def preflight(folder: str) -> Preflight:
    """Checks that the folder, its metadata and every page's file are there and can be opened."""
    root = os.path.abspath(T.strip(folder) or ".")
    if not os.path.exists(root):
        raise PreflightError(f"input folder does not exist: {root}")
    if not os.path.isdir(root):
        raise PreflightError(f"input path is not a directory: {root}")
    meta = os.path.join(root, METADATA)
    if not os.path.exists(meta):
        raise PreflightError(f"missing required file {meta}")
    pages = _pages(meta)
    if not pages:
        raise PreflightError(f"metadata file {meta} has empty pages corpus")
    for page, record in pages.items():
        name = f"metadata.pages[{page}].local_path"
        local = T.strip(record["local_path"])
        if not local:
            raise PreflightError(f"{name} is empty")
        path = os.path.join(root, local)
        if not os.path.exists(path):
            raise PreflightError(f"markdown file referenced by {name} not found: {path}")
        if os.path.isdir(path):
            raise PreflightError(f"{name} points to a directory, expected markdown file: {path}")
        try:
            open(path, "rb").close()
        except OSError as error:
            raise PreflightError(f"open markdown file {path}: {error}") from error
    return Preflight(root, meta, len(pages), len(pages))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, title, local_path, space_key, source_url, last_modified_at, body) of every page; body is the raw file.

    The files are listed and read by executors, whole and with their line ends as they are.
    """
    root = os.path.abspath(T.strip(folder) or ".")
    pages = _pages(os.path.join(root, METADATA))
    schema = StructType([StructField("page_id", StringType(), False), *(StructField(f, StringType(), False) for f in _FIELDS), StructField("path", StringType(), False)])
    rows = []
    named = {T.strip(page): r for page, r in pages.items()}
    if "" in named:
        raise ValueError(f"a page of {METADATA} has a blank id")
    for page, r in named.items():
        local = T.strip(r["local_path"])
        rows.append((page, local, T.strip(r["title"]), T.strip(r["space_key"]), T.strip(r["source_url"]), T.strip(r["last_modified_at"]), os.path.normpath(os.path.join(root, local))))
    meta = spark.createDataFrame(rows, schema)
    paths = sorted({r[-1] for r in rows})
    files = spark.read.text([_escaped(p) for p in paths], wholetext=True).select(F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "^file:/+", "/").alias("path"), F.col("value").alias("body"))
    empty = F.coalesce("body", F.lit(""))  # the reader has no row for an empty file
    return meta.join(files, "path", "left").select("page_id", "title", "local_path", "space_key", "source_url", "last_modified_at", empty.alias("body"))


def _escaped(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return "file://" + "".join("\\" + c if c in "*?[]{}\\" else c for c in path)


def load_documents(pages: DataFrame, chunk_size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """(id, page_id, title, local_path, space_key, source_url, last_modified_at, content_hash, chunks array<string>) of read_pages' rows.

    One projection: cleaning, hashing and chunking are built-in expressions over the page's own row.
    """
    clean = pages.withColumn("clean", T.clean(F.col("body")))
    return clean.select(
        F.col("page_id").alias("id"), "page_id", "title", "local_path", "space_key", "source_url", "last_modified_at",
        T.content_hash(F.col("clean")).alias("content_hash"), T.chunks(F.col("clean"), chunk_size, overlap).alias("chunks"),
    )


def explode_chunks(documents: DataFrame, *also: str) -> DataFrame:
    """(id, document_id, chunk_index, text, chunk_hash) of load_documents' rows, and other columns of the document that are named."""
    rows = documents.select("id", F.posexplode("chunks").alias("chunk_index", "text"), *also)
    return rows.select(T.chunk_id(F.col("id"), F.col("chunk_index")).alias("id"), F.col("id").alias("document_id"), "chunk_index", "text", T.content_hash(F.col("text")).alias("chunk_hash"), *also)
