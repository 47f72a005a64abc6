"""Tables that are written once and read by several plans.

They go below ``spark.checkpoint.dir``, the folder that driver and executors
share, through Spark's own writers, so a lost executor costs task retries only.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table as it was written to shared storage, with its path."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/citeweave/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`written` wrote meanwhile; results must have been stored by then."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(spark, *_scratch.pop())


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly below a folder of any Hadoop file system; none if it is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []
