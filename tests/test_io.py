import pytest
from pyspark.sql import functions as F

from citeweave.sources import io, layout
from citeweave.streaming import verdicts


def test_jsonl(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{broken\n{"a": 2}\n')
    assert [(r.a, r.b) for r in io.read_jsonl(spark, str(path), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    io.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '"b":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect())


def test_csv_keeps_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'two\n"lines"', ["x"]), ("2", None, None)], "id string, t string, l array<string>")
    io.write_csv(rows, str(tmp_path / "c"), ["id", "t", "l"])
    got = {r.id: r.t for r in io.read_csv(spark, str(tmp_path / "c")).collect()}
    assert got == {"1": 'two\n"lines"', "2": ""}


def test_runs_and_qrels(spark, tmp_path):
    run = spark.createDataFrame([("bm25", "q1", "a-b", 1, 2.0), ("bm25", "q1", "c", 2, 1.0)], "run string, qid string, doc string, rank int, score double")
    io.write_run(run, str(tmp_path / "run"))
    (tmp_path / "run" / "bad.trec").write_text("q1 Q0 x 1 notanumber bm25\nq1 Q0 x\n")
    assert {(r.doc, r.rank) for r in io.read_run(spark, str(tmp_path / "run"), strip_hyphens=True).collect()} == {("ab", 1), ("c", 2)}
    io.write_qrels(spark.createDataFrame([("q1", "a", 1)], "qid string, doc string, relevance int"), str(tmp_path / "qrels"))
    assert [tuple(r) for r in io.read_qrels(spark, str(tmp_path / "qrels")).collect()] == [("q1", "a", 1)]


def test_upsert_keeps_other_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    io.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "corpus string, n int"), path, ["corpus"])
    io.upsert(spark.createDataFrame([("b", 3)], "corpus string, n int"), path, ["corpus"])
    assert {(r.corpus, r.n) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}


def test_lookup_under_aliases(spark):
    rows = spark.createDataFrame([("p1", None, "u1", "text")], "pid string, id string, passage_uid string, passage string")
    assert {(r.key, r.text) for r in io.passage_lookup(rows).collect()} == {("p1", "text"), ("u1", "text")}


def test_streams(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    schema = "k long, v string"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], schema).write.json(src)
    verdicts.append_new(spark, src, schema, sink, ck, "k")
    spark.createDataFrame([(2, "d"), (3, "e")], schema).write.mode("append").json(src)
    verdicts.append_new(spark, src, schema, sink, ck, "k")
    assert sorted(r.k for r in spark.read.parquet(sink).collect()) == [1, 2, 3]
    rows = spark.createDataFrame([(1, "PASS", 0.5)], "item long, decision string, confidence double").withColumn("ts", F.current_timestamp())
    assert verdicts.running_consensus(rows, "item", "ts").first().votes_pass == 1


def test_strict_lines_raise(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        io.read_jsonl(spark, str(path), "a int", strict=True).collect()


def test_run_formats(spark, tmp_path):
    (tmp_path / "mine.trec").write_text("q Q0 b 9 1.0 x\nq Q0 a 1 2.0 x\nq Q0 a 2 0.5 x\n\nq Q0 c 1 z x\nq Q0 d 4 4.0\nq Q0 e\n")
    path = str(tmp_path / "mine.trec")
    assert sorted(map(tuple, io.read_run(spark, path).collect())) == [("x", "q", "a", 2, 0.5), ("x", "q", "b", 9, 1.0)]
    assert sorted((r.run, r.doc, r.score) for r in io.read_run(spark, path, columns=5).collect()) == [("mine", "a", 0.5), ("mine", "b", 1.0), ("mine", "d", 4.0)]
    assert [(r.run, r.doc) for r in io.read_ranked_lists(spark, path).orderBy("rank").collect()] == [("mine", d) for d in "baacde"]


def test_partitions_and_verdicts(spark, tmp_path):
    rows = spark.createDataFrame([("m", "train", 1), ("m", "test", 2)], "method string, split string, n int")
    io.write_partitioned(rows, str(tmp_path / "p"), ["method", "split"])
    assert spark.read.parquet(str(tmp_path / "p/method=m/split=test")).first().n == 2
    io.write_verdicts(spark.createDataFrame([("a", "PASS"), ("b", "DROP")], "item string, decision string"), str(tmp_path / "v"))
    assert [spark.read.json(str(tmp_path / "v" / x)).count() for x in ("all", "pass", "drop")] == [2, 1, 1]
    io.write_rankings(spark.createDataFrame([("r", "q", 2, "b", 1.0), ("r", "q", 1, "a", 2.0)], "run string, qid string, rank int, doc string, score double"), str(tmp_path / "k"))
    assert [d.doc for d in spark.read.json(str(tmp_path / "k")).first().ranking] == ["a", "b"]


def test_page_encodings(spark, tmp_path):
    texts = {"a.html": "\ufeffé".encode(), "b.html": "é".encode("cp1252"), "c.html": b"\x81\xe9"}
    for name, raw in texts.items():
        (tmp_path / name).write_bytes(raw)
    found = {r.path.rsplit("/", 1)[1]: r.html for r in io.read_html(spark, str(tmp_path)).collect()}
    assert found == {"a.html": "é", "b.html": "é", "c.html": "\x81é"}


def test_layouts(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# list\n\nhttps://b.example/x\nhttps://a.example/\nhttps://b.example/x\n")
    allowed = layout.read_allowlist(spark, str(tmp_path / "allow.txt"))
    assert [r.url for r in allowed.collect()] == ["https://a.example/", "https://b.example/x"] and layout.read_allowlist(spark, str(tmp_path / "allow.txt"), 1).count() == 1
    log = spark.createDataFrame([("https://a.example/", True), ("https://b.example/x", False)], "url string, ok boolean")
    assert [r.url for r in layout.to_fetch(allowed, log).collect()] == ["https://b.example/x"]
    name = allowed.select(layout.page_file(F.col("url")).alias("f")).collect()[1].f
    assert name.startswith("b.example_x__") and name.endswith(".html") and len(name) == len("b.example_x__.html") + 10
    (tmp_path / "curate_one").mkdir()
    (tmp_path / "curate_one/final_answer_valid.jsonl").write_text('{"item": "a"}\n')
    (tmp_path / "curate_one/final_answer_failed.jsonl").write_text('{"item": "b", "corpus": "Two"}\n')
    rows = layout.read_cohorts(spark, str(tmp_path / "curate_*/*.jsonl"), "item string, corpus string", ("one", "two"))
    assert sorted((r.item, r.corpus, r.cohort) for r in rows.collect()) == [("a", "one", "answer_valid"), ("b", "two", "answer_failed")]
    (tmp_path / "C-test.jsonl").write_text('{"item": "a", "method": "x"}\n{"item": "b", "method": "Y "}\n')
    assert [r.item for r in layout.read_split(spark, str(tmp_path), "c", "item string, method string", "y").collect()] == ["b"]
    (tmp_path / "C-Y-test.jsonl").write_text('{"item": "z"}\n')
    assert [r.item for r in layout.read_split(spark, str(tmp_path), "c", "item string, method string", "y").collect()] == ["z"]
    with pytest.raises(FileNotFoundError):
        layout.read_split(spark, str(tmp_path), "d", "item string")
    (tmp_path / "answer_eval_one_x_bm25_k5_test.json").write_text('{"model": "m", "results": [{"item": "a", "nli_scores": {"entailment": 0.5, "contradiction": 0.1}}, {"item": "b", "method": "own"}]}')
    found = {r.item: r for r in layout.read_results(spark, str(tmp_path / "answer_eval_*.json"), "item:string,method:string,nli_scores:struct<entailment:double,contradiction:double>").collect()}
    assert (found["a"].corpus, found["a"].method, found["a"].retriever, found["a"].entailment, found["b"].method, found["b"].generator_model) == ("one", "X", "bm25_k5", 0.5, "own", "m")
    assert layout.typed(spark.createDataFrame([("1", "x"), ("y", "x")], "n string, s string"), {"n": "int"}).count() == 1
    runs = spark.createDataFrame([("dense", 1), ("other", 2)], "run string, n int")
    assert sorted(r.run for r in layout.staged_runs(runs, None, ("dense", "bm25"), {"e5": "dense", "rrf": "none"}).collect()) == ["dense", "e5"]
    assert layout.staged_runs(runs, runs.limit(1), ("dense",), {}).count() == 1
