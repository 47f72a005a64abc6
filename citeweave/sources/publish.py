"""Tables that readers see whole: written aside, then named by one small file.

Below the table's folder lie versions, each in a folder of its own, and ``CURRENT``,
which names the version in force.  A version is written first; then ``CURRENT`` is
replaced by a rename, which a file system does at once.  A writer that dies before
leaves the former version, and what it wrote is removed by the next :func:`purge`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.tables import discard, list_folders

CURRENT = "CURRENT"


def _system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, target


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Let ``CURRENT`` name a version: written under another name, then renamed over the former."""
    jvm, conf, draft = _system(spark, f"{folder}/.{CURRENT}-{uuid.uuid4().hex}")
    system = draft.getFileSystem(conf)
    out = system.create(draft, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(draft, jvm.org.apache.hadoop.fs.Path(f"{folder}/{CURRENT}"), options)


def current(spark: SparkSession, folder: str) -> str | None:
    """The path of the version in force."""
    if CURRENT not in list_folders(spark, folder):
        return None
    (row,) = spark.read.text(f"{folder}/{CURRENT}", wholetext=True).collect()
    return f"{folder}/{row[0].strip()}"


def publish(spark: SparkSession, folder: str, write: Callable[[str], None]) -> str:
    """Call ``write`` with the path of a new version and put the version in force once it is written."""
    version = f"version-{uuid.uuid4().hex}"
    write(f"{folder}/{version}")
    _point(spark, folder, version)
    return f"{folder}/{version}"


def publish_table(df: DataFrame, folder: str) -> str:
    return publish(df.sparkSession, folder, lambda path: df.write.parquet(path))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The table in force; what is published later does not change it until it is purged."""
    path = current(spark, folder)
    if path is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return spark.read.parquet(path)


def purge(spark: SparkSession, folder: str) -> list[str]:
    """Remove all versions but the one in force, and drafts of its name."""
    held = (current(spark, folder) or "").rsplit("/", 1)[-1]
    gone = [n for n in list_folders(spark, folder) if n != held and (n.startswith("version-") or n.startswith(f".{CURRENT}-"))]
    discard(spark, *(f"{folder}/{n}" for n in gone))
    return gone


def upsert(df: DataFrame, folder: str, keys: list[str]) -> str:
    """Publish the table with the rows of all keys that occur in ``df`` replaced by them."""
    spark = df.sparkSession
    if current(spark, folder) is None:
        return publish_table(df, folder)
    kept = read(spark, folder).join(df.select(*keys).distinct(), keys, "left_anti")
    return publish_table(kept.unionByName(df, allowMissingColumns=True), folder)


def stage_runs(runs: DataFrame, folder: str, names: tuple[str, ...], aliases: dict[str, str] | None = None, restage: bool = False) -> str | None:
    """Publish runs as six-column text, one folder ``run=<name>`` for each; returns the version's path.

    What is staged already stays in force unless ``restage``; a new staging holds nothing of
    the former one.  ``aliases`` maps further names to runs; a run without rows has neither.
    """
    spark = runs.sparkSession
    held = current(spark, folder)
    if held is not None and not restage:
        return held
    known = runs.where(F.col("run").isin(*names))
    other = [(alias, name) for alias, name in (aliases or {}).items()]
    named = F.explode(F.array(F.col("run"), *[F.when(F.col("run") == name, F.lit(alias)) for alias, name in other]))
    every = known.withColumn("name", named).where("name is not null")
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "doc", "rank", "score", "name").alias("value")
    rows = every.repartition("name", "qid").sortWithinPartitions("name", "qid", "rank").select(line, F.col("name").alias("run"))
    return publish(spark, folder, lambda path: rows.write.partitionBy("run").text(path))


def staged_names(spark: SparkSession, folder: str) -> list[str]:
    """Runs of the staging in force."""
    held = current(spark, folder)
    return [n.removeprefix("run=") for n in list_folders(spark, held) if n.startswith("run=")] if held else []
