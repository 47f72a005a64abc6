"""Lines of text files with their places, read by as many tasks as the files have splits.

A line's place is the byte offset of the split it was read in and its turn there, which
orders the lines of a file without anybody reading all of it.  Numbers follow from counts
per split: a few rows per file, whose running sums shift the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, split, turn, value): turns rise within a split, splits by their offset in the file."""
    rows = spark.read.text(path)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        base_name(F.col("_metadata.file_name")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("turn"),
        "value",
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, line, value): lines of each file numbered from 0."""
    rows = placed_lines(spark, path)
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("lines"), F.min("turn").alias("first"))
    before = F.sum("lines").over(W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    shifts = splits.select("path", "split", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(shifts, ["path", "split"]).select("path", "file", (F.col("turn") + F.col("shift")).alias("line"), "value")
