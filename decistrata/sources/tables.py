"""Reading tables and cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_folders: set[str] = set()
_open = threading.local()  # lists of the tables made within `temporary`, innermost last
_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests), a local folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="decistrata-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. All of an application lie in one folder, which goes when the
    application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark).rstrip('/')}/tables/{sc.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    path = f"{folder}/{uuid.uuid4().hex}"
    for made in getattr(_open, "tables", []):
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that this thread's operators write within the block when it ends. Use what depends on
    them inside: a DataFrame taken out of the block can't be read any more."""
    made: list[str] = []
    _open.tables = [*getattr(_open, "tables", []), made]
    try:
        yield
    finally:
        _open.tables = _open.tables[:-1]
        sc = spark.sparkContext
        for name in made:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    A lost executor then costs a read and no recomputation, and plans that use the result several
    times don't repeat it. Parquet is a tenth of what a checkpoint of rows would take.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    limit = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, "8000")  # the JVM leaves larger methods uncompiled, as those of wide aggregates would be
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_LIMIT, limit)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` as the broadcast side of a join if it is proven to have ``rows`` rows at most; else as it
    is, for a shuffled join. The proof reads ``rows`` + 1 rows and no more."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
