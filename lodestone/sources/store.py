"""An index on disk: versioned Parquet snapshots and a manifest that names the current one.

    <index>/manifest.json          {"schemaVersion", "snapshot", "nRows", "avgTokens"}
    <index>/snapshots/<n>/<table>  documents, chunks, embeddings, postings (sorted by term), lengths
    <index>/runs/<seq>-<id>.json   one a run

A snapshot is complete before the manifest points to it, so a run that fails leaves the old index whole.
All paths go through Hadoop's file systems, so an index may be local or shared.
"""

from __future__ import annotations

import datetime
import json
import secrets
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.candidates import Frames
from lodestone.operators.lexical import laid_out
from lodestone.schemas import RUNS, SCHEMA_VERSION, TABLES, conform

_MANIFEST = "manifest.json"


class StoreError(RuntimeError):
    pass


class Files:
    """Small text files through Hadoop's file system API."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside path, then renames over it."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        draft = self.jvm.org.apache.hadoop.fs.Path(path + ".draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf) if p.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        array = self._gateway.new_array(option, 1)
        array[0] = option.OVERWRITE
        context.rename(draft, p, array)

    @property
    def _gateway(self):
        from pyspark import SparkContext

        return SparkContext._gateway

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def now() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass(frozen=True)
class Stats:
    schema_version: int = 0
    runs: int = 0
    documents: int = 0
    chunks: int = 0
    embeddings: int = 0


class IndexStore:
    def __init__(self, spark: SparkSession, path: str):
        path = strip(path)
        if not path:
            raise StoreError("database path is required")
        self.spark, self.path, self.files = spark, path.rstrip("/") or "/", Files(spark)

    def _manifest(self) -> dict | None:
        at = f"{self.path}/{_MANIFEST}"
        return json.loads(self.files.read(at)) if self.files.exists(at) else None

    def _required(self) -> dict:
        manifest = self._manifest()
        if manifest is None:
            raise StoreError(f"no index at {self.path}")
        return manifest

    def exists(self) -> bool:
        return self._manifest() is not None

    def create(self) -> None:
        """An empty index, where there is none."""
        if not self.exists():
            self.files.write(f"{self.path}/{_MANIFEST}", json.dumps({"schemaVersion": SCHEMA_VERSION, "snapshot": 0, "nRows": 0, "avgTokens": None}))

    def claim(self) -> None:
        """Refuses a folder that holds something else than an index."""
        if not self.exists() and set(self.files.list(self.path)) - {"snapshots", "runs"}:
            raise StoreError(f"{self.path} exists and is no index")

    def forget_runs(self, but: str) -> None:
        """Removes all runs but one."""
        for name in self.files.list(f"{self.path}/runs"):
            if not name.endswith(f"-{but}.json"):
                self.files.delete(f"{self.path}/runs/{name}")

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of the current snapshot; columns that an older one lacks are filled."""
        n = (manifest or self._required())["snapshot"]
        if not n:
            return self.spark.createDataFrame([], TABLES[name])
        return conform(self.spark.read.parquet(f"{self.path}/snapshots/{n}/{name}"), TABLES[name])

    def frames(self) -> Frames:
        m = self._required()
        stats = self.spark.range(1).select(F.lit(m["nRows"]).cast("long").alias("n_rows"), F.lit(m["avgTokens"]).cast("double").alias("avg_tokens"))
        return Frames(*(self.table(t, m) for t in ("documents", "chunks", "embeddings", "postings", "lengths")), stats)

    def commit(self, tables: dict[str, DataFrame]) -> None:
        """Writes the next snapshot, then points the manifest to it; the one before the current goes."""
        m = self._required()
        n = m["snapshot"] + 1
        base = f"{self.path}/snapshots/{n}"
        self.files.delete(base)
        for name, df in sorted(tables.items(), key=lambda x: x[0] == "postings"):
            df = conform(df, TABLES[name])
            if name == "postings":  # sorted by term, so a query's terms prune row groups
                df = laid_out(df, self.spark.read.parquet(f"{base}/lengths").count())
            elif name == "chunks":
                df = df.sortWithinPartitions("document_id", "chunk_index")
            df.write.parquet(f"{base}/{name}")
        total = self.spark.read.parquet(f"{base}/lengths").agg(F.count(F.lit(1)), F.avg("n_tokens")).first()
        self.files.write(f"{self.path}/{_MANIFEST}", json.dumps({"schemaVersion": SCHEMA_VERSION, "snapshot": n, "nRows": total[0], "avgTokens": total[1]}))
        for old in self.files.list(f"{self.path}/snapshots"):
            if old.isdigit() and int(old) < n - 1:
                self.files.delete(f"{self.path}/snapshots/{old}")

    # Runs are few and small: a file each, so a failed one stays without an end.

    def begin_run(self, mode: str = "") -> str:
        run = secrets.token_hex(8)
        seq = len(self.files.list(f"{self.path}/runs"))
        self.files.write(f"{self.path}/runs/{seq:06d}-{run}.json", json.dumps({"id": run, "started_at": now(), "completed_at": None, "mode": strip(mode) or "incremental"}))
        return run

    def complete_run(self, run: str) -> None:
        if not strip(run):
            raise StoreError("run id is required")
        for name in self.files.list(f"{self.path}/runs"):
            if name.endswith(f"-{run}.json"):
                at = f"{self.path}/runs/{name}"
                self.files.write(at, json.dumps(json.loads(self.files.read(at)) | {"completed_at": now()}))
                return
        raise StoreError(f"run {run} not found")

    def runs(self) -> DataFrame:
        rows = [json.loads(self.files.read(f"{self.path}/runs/{n}")) for n in self.files.list(f"{self.path}/runs") if n.endswith(".json")]
        return self.spark.createDataFrame([tuple(r[f.name] for f in RUNS) for r in rows], RUNS)

    def stats(self) -> Stats:
        m = self._required()
        counts = [self.table(t, m).count() for t in ("documents", "chunks", "embeddings")]
        return Stats(m["schemaVersion"], len([n for n in self.files.list(f"{self.path}/runs") if n.endswith(".json")]), *counts)
