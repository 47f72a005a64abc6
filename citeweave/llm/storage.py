"""Shared storage for intermediate tables and written archives.

Everything an operator materialises goes below ``spark.checkpoint.dir``, the
one folder that driver and executors share.  Only Spark's own readers and
writers touch it, so any Hadoop file system will do, and a lost executor costs
a task retry, not data.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of one Arrow batch that goes to Python, so that a worker holds a few of them at any row size.
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder.

    Where neither is set, a run within one process gets a temporary folder and
    a run on a cluster an error.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="citeweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            context.setCheckpointDir("file://" + folder)
            current = context._jsc.sc().getCheckpointDir()
        root = current.get()
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_BYTES`` (or one row) in the jobs run meanwhile."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in shared storage; nothing is created."""
    return f"{shared_root(spark)}/citeweave/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of a narrow intermediate table that one task may hold or write.
TASK_ROWS = 1 << 18


def counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str, int]:
    """:func:`settle` for narrow tables, with the number of rows written and one task for each ``TASK_ROWS`` of at most ``rows``."""
    seen = Observation()
    if rows is not None:
        df = df.coalesce(min(partitions(df.sparkSession), 1 + rows // TASK_ROWS))
    out, path = settle(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, path, seen.get["rows"]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def open_file(path: str):
    """A file below shared storage for range reads in a task, by Arrow's file systems (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_records(df: DataFrame, record: str, path: str, end: str) -> None:
    """Write binary records to files, one after another in row order, each followed by ``end``.

    Spark's text sink writes a string's bytes as they are; casting binary to
    string does not change them.  The files go through Spark's commit protocol.
    """
    with small_batches(df.sparkSession):
        df.select(F.col(record).cast("string").alias("value")).write.option("lineSep", end).text(path)
