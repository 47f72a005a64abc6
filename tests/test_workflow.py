"""Streams, and the retrieval step as a whole, on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import curation, records, retrieval, sampling, statistics, xrefs
from citeweave.plans import bindings
from citeweave.streaming import verdicts
from tests.conftest import SMALL


def test_streams_skip_repeats_and_add_up(spark, tmp_path):
    schema = "k long, decision string, confidence double, ts timestamp"
    rows = [(1, "PASS", 0.5, "2024-01-01 00:01:00"), (1, "DROP", 0.25, "2024-01-01 00:02:00"), (2, "PASS", 1.0, "2024-01-01 00:03:00")]
    table = spark.createDataFrame(rows, "k long, decision string, confidence double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.json(f"{tmp_path}/in")

    def drained(stream, name, mode):
        out = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}-ck").format("memory").queryName(name).outputMode(mode).start()
        out.awaitTermination()
        return spark.table(name).collect()

    read = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in")
    assert sorted(r.k for r in drained(verdicts.new_only(read(), "k", "ts"), "new_rows", "append")) == [1, 2]
    found = {r.k: (r.n_passes, r.votes_pass, r.for_drop) for r in drained(verdicts.running_consensus(read(), "k", "ts"), "running", "update")}
    assert found == {1: (2, 1, 0.25), 2: (1, 1, 0.0)}


RUN = "qid long, doc long, score double, rank int"


def test_seven_runs(spark):
    lexical = spark.createDataFrame([(1, 10, 3.0, 1), (1, 11, 2.0, 2), (2, 12, 1.0, 1)], RUN)
    dense = spark.createDataFrame([(1, 11, 0.9, 1), (1, 13, 0.8, 2), (3, 10, 0.5, 1)], RUN)
    edges = spark.createDataFrame([(11, 14), (13, 10)], "src long, dst long")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "qid long, text string")
    passages = spark.createDataFrame([(d, t) for d, t in ((10, "alpha"), (11, "alpha beta"), (12, "gamma"), (13, "nothing"))], "doc long, text string")
    gold = spark.createDataFrame([(1, 11, 14), (2, 12, 99), (3, 1, 2)], "qid long, src long, tgt long")
    out = retrieval.workflow(lexical, dense, edges, queries, passages, gold, k=2)
    names = {r.run for r in out["runs"].select("run").distinct().collect()}
    assert names == {"bm25", "dense", "rrf_bm25_dense", "bm25_xref_expand", "dense_xref_expand", "rrf_xref_expand", "ce_rerank_union"}
    fused = [(r.qid, r.doc) for r in out["runs"].where("run = 'rrf_bm25_dense'").orderBy("qid", "rank").collect()]
    assert fused == [(1, 11), (1, 10), (1, 13)]  # only the query both answer, not cut
    assert [r.doc for r in out["runs"].where("run = 'ce_rerank_union'").orderBy("rank").collect()] == [11, 10]
    votes = {r.qid: (r.source_votes, r.target_votes, r.n_runs, r.decision) for r in out["votes"].collect()}
    assert votes[1] == (7, 3, 7, "JUDGE") and votes[2] == (2, 0, 7, "DROP") and votes[3] == (0, 0, 7, "DROP")
    (debug,) = out["rerank_debug"].collect()
    assert (debug.qid, debug.source_in_union, debug.target_in_union, debug.n_candidates, debug.top_docs, debug.source_rank, debug.target_rank) == (1, True, False, 3, [11, 10], 1, None)
    found = {(r.run, r.qid): r.n_added for r in out["expansion_debug"].collect()}
    assert found[("bm25", 1)] == 2 and found[("dense", 1)] == 2 and found[("bm25", 2)] == 0


def test_index_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c")], "doc long, text string")
    index = retrieval.build_index(docs, path=f"{tmp_path}/index")
    queries = spark.createDataFrame([(9, "c")], "qid long, text string")
    again = retrieval.search_index(spark.read.parquet(f"{tmp_path}/index"), queries, 5).collect()
    assert [(r.doc, r.rank) for r in again] == [(2, 1)] and retrieval.search_index(index, queries, 5).collect() == again
    assert retrieval.bm25(docs.limit(0), queries, 5).count() == 0


def test_search_adds_up_scores_where_a_document_is(spark):
    """Rows of a query and a document are not shuffled: only each task's first k go to the ranking."""
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c c"), (3, None), (4, " "), (5, "b")], "doc long, text string")
    queries = spark.createDataFrame([(8, "a a c"), (9, "b")], "qid long, text string")
    counts = {(r.doc, r.dl): sorted((e.term, e.tf) for e in r.entries) for r in retrieval.term_counts(docs).collect()}
    assert counts == {(1, 3): [("a", 2), ("b", 1)], (2, 3): [("a", 1), ("c", 2)], (5, 1): [("b", 1)]}
    run = retrieval.bm25(docs, queries, 2)
    assert sorted((r.qid, r.doc) for r in run.collect()) == [(8, 1), (8, 2), (9, 1), (9, 5)]
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(qid#\d+L?, doc#", plan) and re.search(r"hashpartitioning\(doc#", plan)


def below(plan: str, node: str) -> list[str]:
    """The lines below a node of a plan, from its child on."""
    lines = plan.splitlines()
    return lines[next(i for i, line in enumerate(lines) if re.search(node, line)) + 1 :]


def test_only_asked_terms_are_dealt(spark):
    """Of a passage's terms those that a query asks go to its task, as numbers; other terms stay where they lie."""
    docs = spark.createDataFrame([(1, "a b a x"), (2, "a c c y"), (2, "c z"), (3, None), (5, "b"), (6, "x y z")], "doc long, text string")
    queries = spark.createDataFrame([(8, "a a c q"), (9, "b"), (None, "c"), (7, " ")], "qid long, text string")
    run = retrieval.bm25(docs, queries, 2)
    dealt = below(run._jdf.queryExecution().executedPlan().toString(), r"hashpartitioning\(doc#")
    assert not re.search("entries#|term#", dealt[0]) and re.search(r"\bno#", dealt[0]) and any("Join" in line for line in dealt)
    assert sorted((r.qid or 0, r.doc) for r in run.collect()) == [(0, 2), (8, 1), (8, 2), (9, 1), (9, 5)]


def test_only_candidates_are_dealt_for_reranking(spark, monkeypatch):
    """Texts that are no candidates are not shuffled, and a join of many candidates gives the same."""
    candidates = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 99), (3, 12)], "qid long, doc long")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, None)], "qid long, text string")
    passages = spark.createDataFrame([(10, "alpha"), (11, "beta alpha gamma"), (12, None), (13, "gamma")], "doc long, text string")
    found = lambda: retrieval.rerank(candidates, queries, passages)
    rows = lambda run: sorted((r.qid, r.doc, r.score, r.rank) for r in run.collect())
    few = found()
    dealt = below(few._jdf.queryExecution().executedPlan().toString(), r"hashpartitioning\(doc#\d+L?, \d+\), REPARTITION")
    assert any("BroadcastHashJoin" in line and "LeftSemi" in line for line in dealt[:3])
    assert rows(few) == [(1, 10, 0.5, 2), (1, 11, 1.0, 1), (2, 11, 1.0, 1), (3, 12, 0.0, 1)]
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert rows(found()) == rows(few)


def test_features_are_written_once_for_all_samples(spark):
    rows = bindings.text_features(spark, SMALL)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and not re.search("Join|Exchange", plan)
    assert xrefs.sample_mixed(rows, 50, 13, "seq").count() == 50 and sampling.sample(rows, 7, "hard_enriched")[1]["sampled"] == 7


def test_runs_are_written_before_they_are_fused(spark):
    one = spark.createDataFrame([(1, 10, 2.0, 1), (1, 11, 1.0, 2)], "qid long, doc long, score double, rank int")
    rows = retrieval.all_runs({"a": one, "b": one.where("doc = 11")})
    assert sorted((r.run, r.doc) for r in rows.collect()) == [("a", 10), ("a", 11), ("b", 11), ("rrf", 10), ("rrf", 11)]
    assert "ExistingRDD" not in rows._jdf.queryExecution().executedPlan().toString()


def test_dense_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0, 0.0]), (8, [2.0, 0.0])]
    table = spark.createDataFrame(rows, "doc long, vector array<float>")
    asked = table.withColumnRenamed("doc", "qid").where("qid in (1, 3, 4, 5, 7)")
    for q, p in ((4096, 4096), (1, 2), (2, 1)):
        found = sorted((r.qid, r.rank, r.doc) for r in retrieval.dense_topk(table, asked, 2, query_rows=q, passage_rows=p).collect())
        assert found == [(1, 1, 1), (1, 2, 8), (7, 1, 7)]
    many = spark.createDataFrame([(k, [1.0, k % 3 / 10]) for k in range(500)], "doc long, vector array<float>").repartition(7)
    found = [r.doc for r in retrieval.dense_topk(many, many.where("doc = 0").withColumnRenamed("doc", "qid"), 5).orderBy("rank").collect()]
    assert found == [0, 3, 6, 9, 12]


def test_metrics_of_answered_queries(spark):
    runs = spark.createDataFrame([("r", "q", "a", 1.0), ("r", "q", "b", 1.0)], "run string, qid string, doc string, score double")
    wanted = spark.createDataFrame([("q", "b"), ("x", "a")], "qid string, doc string")
    ask = lambda **more: retrieval.metrics(runs, wanted, 1, **more).first()
    assert (ask().n_queries, ask().recall) == (2, 0.0) and ask(all_queries=False).n_queries == 1
    assert ask(descending_ties=True).recall == 0.5 and ask(descending_ties=True, all_queries=False).recall == 1.0


def test_neighbours_up_to_a_cap(spark):
    edges = spark.createDataFrame([(1, k) for k in (5, 3, 4)] + [(2, 1), (3, 1)], "src long, dst long")
    assert sorted(r.doc for r in retrieval.neighbours(edges, cap=4).where("seed = 1").collect()) == [2, 3, 4, 5]
    assert sorted(r.doc for r in retrieval.neighbours(edges, cap=2).where("seed = 1").collect()) == [3, 4]
    assert retrieval.neighbours(edges, cap=0).count() == 0


def test_judge_and_answer_differ(spark):
    columns = "item string, pass_no int, decision string, reason string, confidence double, score double, " + ", ".join(f"{c} boolean" for c in dict.fromkeys((*records.JUDGE_CHECKS, *records.ANSWER_CHECKS)))
    row = lambda *x: (*x, *[None] * (len(columns.split(",")) - len(x)))
    passes = spark.createDataFrame([row("a", 1, "DROP", "X", 0.9), row("a", 2, "PASS", "Y", 0.1), row("a", 3, "PASS", "Y", 0.1), (("b"), 1, "PASS", None, 0.9, 8.0, None, None, True, None, True, True, True, None), ("b", 2, "PASS", None, 0.9, 7.0, None, None, False, None, False, False, True, None)], columns)
    judged, answered = ({r.item: r for r in f(passes).collect()} for f in (records.judge_verdicts, records.answer_verdicts))
    assert judged["a"].reason == "X" and answered["a"].reason == "Y"  # dropping passes alone, or all
    assert judged["b"].target_adds is False and answered["b"].answer_responsive is True  # more than half, or half
    assert (judged["b"].decision, judged["b"].reason, answered["b"].decision) == ("DROP", "QP_WRONG_TARGET", "PASS")
    assert judged["b"].final_score == 8 and judged["b"].fails_target_not_necessary and not judged["b"].fails_source_alone


def test_records_take_constants_only_where_missing(spark):
    rows = spark.createDataFrame([("a", None), ("b", "own")], "item string, role string")
    assert [(r.role, r.family) for r in records.with_constants(rows, {"role": "given", "family": "f"}).orderBy("item").collect()] == [("given", "f"), ("own", "f")]


def test_sampling_doors(spark):
    rows = spark.createDataFrame([(k, f"d{k % 3}", f"e{k % 2}", k / 10, 1 + k % 2, 20, 20, k % 4 == 0, False, k % 2 == 0) for k in range(10)], "seq long, source_doc string, target_doc string, jaccard double, out_refs int, source_words int, target_words int, has_definition boolean, has_exception boolean, cross_doc boolean")
    for mode in sampling.MODES:
        out, report = sampling.sample(rows, 4, mode)
        assert out.count() == 4 and report["sampled"] == 4 and sum(report["buckets"].values()) == 4
    assert sampling.sample(rows, 0)[1]["no_sampling_applied"] and sampling.sample(rows, 10)[0].count() == 10
    with pytest.raises(ValueError):
        sampling.sample(rows, 3, "other")
    # the first rows of new documents in order of score, by hand
    scored = sorted(xrefs.hard_score(rows).collect(), key=lambda r: (-r.hard_score, r.seq))
    taken, s, t = [], set(), set()
    for r in scored:
        if r.source_doc not in s or r.target_doc not in t:
            taken.append(r.seq)
            s.add(r.source_doc)
            t.add(r.target_doc)
    rest = [r.seq for r in scored if r.seq not in taken]
    assert [r.seq for r in xrefs.sample_hard(rows, 6, "seq").orderBy("picked", F.desc("hard_score"), "seq").collect()] == (taken + rest)[:6]


def test_places_in_groups(spark):
    rows = spark.createDataFrame([("a" if k % 5 else None, k * 7 % 101) for k in range(300)], "g string, v long").withColumn("k", F.monotonically_increasing_id()).repartition(5)
    got = {}
    for r in curation.numbered(rows, ["g"], [F.col("v"), F.col("k")]).collect():
        got.setdefault(r.g, []).append((r.v, r.k, r._at, r._n))
    for items in got.values():
        items.sort()
        assert [x[2] for x in items] == list(range(1, len(items) + 1)) and {x[3] for x in items} == {len(items)}
    split = curation.split(rows.where("g is not null").withColumn("s", F.when(F.col("v") < 50, "train").otherwise("odd")), "k", ["g"], existing="s")
    assert {r.split for r in split.select("split").distinct().collect()} == {"train"}


def test_reports_are_whole_or_fail(spark):
    assert statistics.markdown_table(spark.range(3)).count("\n") == 4
    with pytest.raises(ValueError):
        statistics.markdown_table(spark.range(5), most=4)
    assert '"n": 2' in statistics.report({"x": spark.range(2).agg(F.count("*").alias("n"))})


def test_question_keys_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    q = F.lit(" What's  the (RULE)? é4 ")
    assert one(T.question_key_unicode(q)) == "what s the rule ? é4" and one(T.question_key_tokens(q)) == "whats the rule ? é4"
    assert one(T.question_key_ascii(q)) == "what s the rule ? 4" and one(T.question_key(q)) == "what s the rule 4"
    assert one(T.file_name(F.lit("a b/c:d.txt"))) == "a_b_c_d.txt"
    assert one(T.strict_bool(F.lit("pass"))) is None and one(T.tri_state(F.lit("pass"))) is True and one(T.strict_bool(F.lit(" Yes"))) is True
    assert one(T.word_overlap(F.lit("a b é"), F.lit("É c"))) == 0.25 and one(T.word_overlap(F.lit("-"), F.lit("a"))) is None
    assert one(curation.normal_outcome(F.lit(" SRC-only "))) == "source_only" and one(curation.normal_outcome(F.lit(""))) == "unknown" and one(curation.normal_outcome(F.lit("Odd"))) == "odd"
