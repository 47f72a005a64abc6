"""A corpus pipeline of five operators, each on all that the one before kept.

Language identification, near-duplicate documents, repeated passages, benchmark
contamination, tokenisation.  Every stage's rows are written as Parquet and read
again, so a lost executor never costs more than tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm import bpe, decontaminate, jaccard_join, langid, suffix_dedup
from citeweave.llm.queries import tokenizer_path
from citeweave.llm.storage import discard, settle

#: No SQL can express the stages; tests compare run() with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identifiable language: null text, text without a letter, or a score below one half.

    Every row is judged by itself, so repeated rows stay or go together; all columns are kept.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group with five-word similarity of 0.8 or more.

    Documents without words and rows without an id stay; rows that repeat a kept id all stay.
    """
    return jaccard_join.keep_one_each(docs, size=5, num=80, den=100)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 100 bytes that also start earlier; drops documents of which nothing is left.

    Rows without an id stay as they are; a null text counts as empty and stays; n_chars is counted anew.
    """
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more are words of benchmark passages; null texts have none and stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them; a null text has no token."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", join_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; a stage's table goes when the next one has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            discard(spark, before)
        before = path
    return docs
