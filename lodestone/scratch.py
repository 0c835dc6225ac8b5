"""The folder that all executors share, and tables written there for a while."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset, as in tests."""
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


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that clean() removes."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and written to the shared folder: cuts lineage and survives the loss of executors.

    The files stay for as long as the session may read them; clean() or the end of the
    driver's process removes them.
    """
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean() -> None:
    """Removes every table that written() made."""
    while _written:
        spark, path = _written.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
        except Exception:  # the session may be gone already
            continue


atexit.register(clean)
