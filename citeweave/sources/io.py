"""Readers and writers of the formats retrieval experiments use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citeweave.sources.lines import placed_lines

BROKEN = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, or raise if ``strict``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if strict:
        return reader.schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = StructType([*spark.createDataFrame([], schema).schema.fields, StructField(BROKEN, StringType())])
    rows = lines.select(F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("r")).select("r.*")
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, bound by header; absent values become empty; quoted line breaks are kept."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').na.fill("")


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A fixed header; columns beyond it are dropped, nested ones become JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    out = df.select(*[(F.to_json(c) if c in nested else F.col(c)).alias(c) for c in fields])
    out.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1), r"\.[A-Za-z0-9]+$", "").alias("file"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, p): the columns of each line and its place, by which the lines of a file can be ordered."""
    rows = placed_lines(spark, path)
    return rows.select("file", F.struct("path", "split", "turn").alias("line"), F.split(F.trim("value"), r"\s+").alias("p"))


def read_run(spark: SparkSession, path: str, strip_hyphens: bool = False, run_from_file: bool = False, columns: int = 6) -> DataFrame:
    """(run, qid, doc, rank, score) of run files; malformed lines are skipped, of a document's repeats the last line counts.

    ``columns`` of 6 takes lines of six columns; of 5 those of five and more, under
    the file's name.
    """
    p = F.col("p")
    doc = F.translate(p[2], "-", "") if strip_hyphens else p[2]
    fits = F.size("p") == 6 if columns == 6 else F.size("p") >= columns
    name = F.col("file") if run_from_file or columns < 6 else p[5]
    rows = _lines(spark, path).where(fits).select("file", "line", name.alias("run"), p[0].alias("qid"), doc.alias("doc"), F.expr("try_cast(p[3] as int)").alias("rank"), F.expr("try_cast(p[4] as double)").alias("score"))
    last = rows.where("score is not null").groupBy("run", "qid", "doc").agg(F.max(F.struct("file", "line", "rank", "score")).alias("r"))
    return last.select("run", "qid", "doc", "r.rank", "r.score")


def read_ranked_lists(spark: SparkSession, path: str) -> DataFrame:
    """(run, qid, doc, rank) of lines of three columns and more: the run is the file's name, the rank the place of the line."""
    from pyspark.sql import Window as W

    p = F.col("p")
    rows = _lines(spark, path).where(F.size("p") >= 3).select(F.col("file").alias("run"), p[0].alias("qid"), p[2].alias("doc"), "line")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("run", "qid").orderBy("line"))).drop("line")


def write_run(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "qid", F.lit("Q0"), "doc", "rank", "score", "run").alias("value")).write.mode("overwrite").text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("p")
    return _parts(spark, path).where(F.size("p") >= 4).select(p[0].alias("qid"), p[2].alias("doc"), F.expr("try_cast(p[3] as int)").alias("relevance")).where("relevance is not null")


def write_qrels(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws(" ", "qid", F.lit("0"), "doc", "relevance").alias("value")).write.mode("overwrite").text(path)


def write_rankings(df: DataFrame, path: str) -> None:
    """One JSON line for each query of each run, documents in order of rank."""
    lists = df.groupBy("run", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score"))).alias("ranking"))
    write_jsonl(lists, path)


def write_verdicts(df: DataFrame, path: str, decision: str = "decision") -> None:
    """All verdicts, and those of each decision, as JSON lines: ``all``, ``pass`` and ``drop`` below the path."""
    for name, rows in (("all", df), ("pass", df.where(F.col(decision) == "PASS")), ("drop", df.where(F.col(decision) == "DROP"))):
        write_jsonl(rows, f"{path}/{name}")


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """One folder for each value of the keys."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the folders whose keys occur in the rows, keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def passage_lookup(passages: DataFrame, aliases=("pid", "passage_uid", "passage_id", "id"), texts=("text", "passage", "content")) -> DataFrame:
    """(key, text) under every id a passage goes by; columns that are missing are ignored."""
    names = [c for c in aliases if c in passages.columns]
    bodies = [F.nullif(F.col(c), F.lit("")) for c in texts if c in passages.columns]
    rows = passages.select(F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in names])))).alias("key"), F.coalesce(*bodies, F.lit("")).alias("text"))
    return rows.groupBy("key").agg(F.min("text").alias("text"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    from citeweave.operators.html import decode

    return decode(spark.read.format("binaryFile").load(path).select("path", "content"))
