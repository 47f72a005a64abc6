import random
import re

import pytest
from pyspark.sql import functions as F

from citeweave.operators import kept_index, retrieval
from citeweave.operators.kept_index import KeptIndex, StaleIndex


def corpus(spark, n=600, seed=1, start=0):
    """Words of very different frequency; ``the`` is everywhere."""
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(40 * n)]
    rows = [(start + k, " ".join(["the"] * draw.randint(1, 5) + draw.sample(words, draw.randint(1, 30)))) for k in range(n)]
    return spark.createDataFrame(rows, "doc long, text string").repartition(4)


def asked(spark):
    rows = [(1, "the w1 w7 w40"), (2, "the the w2"), (3, "w900 w17 w3 w3"), (4, "nothing known"), (5, None), (6, "w2 w5 w9 w11 w13 w31 the")]
    return spark.createDataFrame(rows, "qid long, text string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("qid", "rank", "doc", "score").collect())


@pytest.fixture
def small_slices(monkeypatch):
    monkeypatch.setattr(kept_index, "SLICE", 16)
    monkeypatch.setattr(kept_index, "HEAD", 64)


@pytest.mark.parametrize("k", [1, 5, 700])
def test_search_equals_full_scoring(spark, tmp_path, small_slices, k):
    docs, queries = corpus(spark), asked(spark)
    index = kept_index.build(docs, f"{tmp_path}/index")
    assert rows_of(index.search(queries, k)) == rows_of(retrieval.bm25(docs, queries, k))


def test_appending_equals_building_at_once(spark, tmp_path, small_slices):
    first, second, queries = corpus(spark), corpus(spark, 300, 2, 1000), asked(spark)
    index = kept_index.build(first, f"{tmp_path}/index").append(second).append(corpus(spark, 5, 3, 5000))
    every = first.unionByName(second).unionByName(corpus(spark, 5, 3, 5000))
    assert index.fits(every) and not index.fits(first)
    assert rows_of(index.search(queries, 5)) == rows_of(retrieval.bm25(every, queries, 5))


def test_fewer_postings_are_read(spark, tmp_path, small_slices):
    docs = corpus(spark, 3000, 4)
    queries = spark.createDataFrame([(1, "the w40 w41"), (2, "the w50"), (3, "the w60")], "qid long, text string")
    index = kept_index.build(docs, f"{tmp_path}/index")
    weights = index.weights(queries)
    split = index.split_terms(weights, index.thresholds(weights, 5))
    of_all = weights.agg(F.sum("df")).first()[0]
    read = [blocks.agg(F.sum("n")).first()[0] for blocks in (index.head_blocks(weights), index.candidate_blocks(split))]
    assert read[0] < 3 * (64 + 32) and sum(read) < of_all / 2
    assert rows_of(index.search(queries, 5)) == rows_of(retrieval.bm25(docs, queries, 5))


def test_candidates_are_added_up_where_a_document_is(spark, tmp_path, small_slices):
    index = kept_index.build(corpus(spark), f"{tmp_path}/index")
    weights = index.weights(asked(spark))
    plan = index.found(index.split_terms(weights, index.thresholds(weights, 5)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(doc#", plan) and not re.search(r"hashpartitioning\(qid#\d+L?, doc#", plan)


def test_joins_of_large_tables_give_the_same(spark, tmp_path, small_slices, monkeypatch):
    docs, queries = corpus(spark), asked(spark)
    few = rows_of(retrieval.bm25(docs, queries, 5))
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert rows_of(retrieval.bm25(docs, queries, 5)) == few
    assert rows_of(kept_index.build(docs, f"{tmp_path}/index").search(queries, 5)) == few


def test_blocks_are_bounded(spark, tmp_path, small_slices):
    index = kept_index.build(corpus(spark, 3000, 5), f"{tmp_path}/index")
    blocks = index._of("blocks")
    assert blocks.where("term = 'the'").agg(F.sum("n")).first()[0] == 3000
    assert blocks.agg(F.max("n")).first()[0] < 3 * 16


def test_stale_and_unfinished_indexes(spark, tmp_path):
    docs, path = corpus(spark, 50), f"{tmp_path}/index"
    index = kept_index.kept(docs, path)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert kept_index.kept(docs.repartition(2), path).manifest == index.manifest
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    with pytest.raises(StaleIndex):
        kept_index.kept(docs.withColumn("text", F.concat("text", F.lit("!"))), path)
    with pytest.raises(FileExistsError):
        kept_index.build(docs, path)
    # an append that died before its manifest: blocks of the next generation lie there, the index is the former one
    kept_index._write(corpus(spark, 20, 6, 900), path, 1, "doc", "text")
    assert KeptIndex(spark, path).manifest == index.manifest
    assert rows_of(KeptIndex(spark, path).search(asked(spark), 3)) == rows_of(retrieval.bm25(docs, asked(spark), 3))
    with pytest.raises(FileNotFoundError):
        KeptIndex(spark, f"{tmp_path}/none")


def test_empty_collections(spark, tmp_path):
    empty = spark.createDataFrame([], "doc long, text string")
    index = kept_index.build(empty, f"{tmp_path}/index")
    assert index.search(asked(spark), 3).collect() == []
    assert index.append(corpus(spark, 30)).search(asked(spark).limit(0), 3).collect() == []
