import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeweave.operators import models, retrieval
from citeweave.operators.models import Model


def told(folder, name):
    """A loader that leaves a file for each time it runs."""

    def load():
        with open(f"{folder}/{name}-{os.getpid()}", "a") as f:
            f.write("x")
        return SCORERS[name]

    return load


def words(texts):
    return [t.lower().split("_") for t in texts]


def overlap(pairs):
    assert len(pairs) <= 3
    return [len(set(q.split()) & set(p.split())) / (1 + len(p.split())) for q, p in pairs]


def encoder(texts):
    return [[float(t.count(c)) for c in "abc"] for t in texts]


SCORERS = {"words": words, "overlap": overlap, "encoder": encoder}


def test_a_worker_loads_once(spark, tmp_path):
    rows = spark.range(400).select(F.col("id"), F.repeat(F.lit("a"), (F.col("id") % 9).cast("int")).alias("text")).repartition(12)
    model = Model("once", told(str(tmp_path), "encoder"), batch=7)
    out = models.embedded(models.embedded(rows, model), model, output="again").collect()
    assert all(r.vector == r.again == [float(r.id % 9), 0.0, 0.0] for r in out) and len(out) == 400
    assert list(tmp_path.iterdir()) and all(f.read_text() == "x" for f in tmp_path.iterdir())


def test_batches_are_of_similar_length():
    seen = []
    model = Model("lengths", lambda: lambda xs: seen.append([len(x) for x in xs]) or xs, batch=3)
    texts = ["a" * n for n in (5, 1, 9, 2, 7, 7, 3)]
    assert model.outputs(texts, len) == texts and seen == [[9, 7, 7], [5, 3, 2], [1]]
    with pytest.raises(ValueError):
        Model("short", lambda: lambda xs: xs[1:]).outputs(texts, len)


def test_reranked_union_with_a_model(spark, tmp_path):
    draw = np.random.default_rng(1)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(draw.choice(vocabulary, 6))
    passages = {d: text() for d in range(40)}
    queries = {q: text() for q in range(5)} | {7: None}
    runs = [(run, q, int(d), 1.0, k + 1) for run in ("x", "y") for q in queries for k, d in enumerate(draw.permutation(41)[:8])]
    table = spark.createDataFrame(runs, "run string, qid long, doc long, score double, rank int")
    out = retrieval.rerank_union(table, spark.createDataFrame([*queries.items()], "qid long, text string"), spark.createDataFrame([*passages.items()], "doc long, text string"), Model("ce", told(str(tmp_path), "overlap"), batch=3), union_k=6, k=4)
    want = []
    for q, asked in queries.items():
        candidates = {d for _, p, d, _, rank in runs if p == q and rank <= 6 and d in passages}
        scored = sorted((-overlap([(asked or str(q), passages[d])])[0], d) for d in candidates)[:4]
        want += [(q, d, n) for n, (_, d) in enumerate(scored, 1)]
    assert sorted((r.qid, r.doc, r.rank) for r in out.collect()) == sorted(want)


def test_tokenizer_of_the_lexical_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One_two"), (2, "two_three three"), (3, None)], "doc long, text string")
    asked = spark.createDataFrame([(9, "TWO"), (8, "three three")], "qid long, text string")
    out = retrieval.bm25(docs, asked, 5, tokenizer=Model("tok", told(str(tmp_path), "words")))
    assert sorted((r.qid, r.doc) for r in out.collect()) == [(8, 2), (9, 1), (9, 2)]


def test_dense_search_of_embedded_texts(spark, tmp_path):
    model = Model("enc", told(str(tmp_path), "encoder"))
    docs = models.embedded(spark.createDataFrame([(1, "aab"), (2, "bbc"), (3, "xyz"), (4, None)], "doc long, text string"), model)
    asked = models.embedded(spark.createDataFrame([(5, "b")], "qid long, text string"), model, prefix="c")
    assert [(r.doc, r.rank) for r in retrieval.dense_topk(docs, asked, 5).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_dense_search_is_dealt_in_blocks(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(300, 6))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "doc long, vector array<double>").repartition(5)
    asked = table.where("doc % 7 = 0").withColumnRenamed("doc", "qid")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = {(q, d, n + 1) for q in range(0, 300, 7) for n, d in enumerate(np.lexsort((np.arange(300), -(unit[q] @ unit.T)))[:9].tolist())}
    plans = set()
    for q, p in ((2048, 16384), (10, 50), (1, 300)):
        found = retrieval.dense_topk(table, asked, 9, query_rows=q, passage_rows=p)
        assert {(r.qid, r.doc, r.rank) for r in found.collect()} == want
        plans.add(len(found._jdf.queryExecution().analyzed().toString().splitlines()))
    assert len(plans) == 1
