"""Tables that cut lineage, in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session, or the one that was set with
``setCheckpointDir``. Only where both are unset, as in tests, a folder below the
system's temporary one is used.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch that goes to a Python worker while a table is written.
BATCH_BYTES = 8 << 20
_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/tessella"
    path = f"{base}/tessella-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, batches for Python workers are small, however long the texts are."""
    before = spark.conf.get(_SIZE)
    spark.conf.set(_SIZE, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_SIZE, before)


def stored(df: DataFrame, slim: bool = False) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    slim: rows of a few numbers, which go to four files for each core of the cluster at most.
    """
    path = folder(df.sparkSession)
    if slim:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path = path  # noqa: SLF001
    return out


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def so_far() -> int:
    """A mark for ``released``."""
    return len(_made)


def released(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes what was stored since the mark, but for the tables to keep: for when a result has been stored or saved itself."""
    kept = {getattr(df, "_tessella_path", None) for df in keep}
    for path in _made[since:]:
        if path not in kept:
            deleted(spark, path)
    _made[since:] = [p for p in _made[since:] if p in kept]


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tessella_path", None)
        if path:
            deleted(df.sparkSession, path)
