"""The shared folder, written tables and size checks that the operators use."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows of a few numbers may be handled by one task or broadcast.
SMALL_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, True)
        path = f"file://{own}"
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder: cuts lineage and survives the loss of executors.

    The files stay for as long as the session may read them; clean() or the end of the
    driver's process removes them. What was shuffled for them goes at once, and not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{name}"
    kept = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, kept)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    except Exception:  # the session may be gone already
        pass


def mark() -> int:
    """A place in the order of written tables, for forget()."""
    return len(_written)


def forget(since: int, keep: int | list[DataFrame] = 1) -> None:
    """Removes the tables written since mark(), but for the last `keep`, or those that are named: nothing may read the others any more."""
    names = [df._written_at for df in keep] if isinstance(keep, list) else []
    end = len(_written) - (0 if isinstance(keep, list) else keep)
    kept = [(spark, path) for spark, path in _written[since:end] if path in names]
    for spark, path in _written[since:end]:
        if (spark, path) not in kept:
            _remove(spark, path)
    _written[since:end] = kept


def clean() -> None:
    """Removes every table that written() made."""
    while _written:
        _remove(*_written.pop())


atexit.register(clean)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether df has at most `rows` rows; reads no more than decides it."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if its number of rows, which is checked, allows it."""
    return F.broadcast(df) if small(df, rows) else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A name for a helper column that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
