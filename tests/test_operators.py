import pytest
from pyspark.sql import functions as F

from citeweave.operators import curation, graph, html, links, retrieval, statistics, xrefs

RUN = "run string, qid string, doc string, score double"


def test_pair_diagnostics(spark):
    runs = spark.createDataFrame([("r", "q", d, s) for d, s in (("d0", 4.0), ("src", 3.0), ("d1", 2.0), ("tgt", 1.0))], RUN)
    gold = spark.createDataFrame([("q", "src", "tgt"), ("x", "a", "b")], "qid string, src string, tgt string")
    rows = {r.qid: r for r in retrieval.pair_diagnostics(runs, gold).collect()}
    assert (rows["q"].src_rank, rows["q"].tgt_rank, rows["q"].pair_rr, rows["q"].outcome_5) == (2, 4, 0.25, "both")
    assert rows["x"].src_rank is None and rows["x"].pair_rr == 0.0 and rows["x"].outcome_20 == "neither"


def test_recall_identity(spark):
    runs = spark.createDataFrame([("r", f"q{q}", f"d{(q * 7 + k) % 23}", float(100 - k // 2)) for q in range(20) for k in range(15)], RUN)
    gold = spark.createDataFrame([(f"q{q}", f"d{q % 23}", f"d{(q * 5 + 1) % 23}") for q in range(20)], "qid string, src string, tgt string").where("src <> tgt")
    m = retrieval.metrics(runs, retrieval.qrels(gold), 10).first()
    p = retrieval.pair_metrics(retrieval.pair_diagnostics(runs, gold)).first()
    assert abs(m.recall - (p.both + (p.src_only + p.tgt_only) / 2)) < 1e-12
    assert abs(p.both + p.src_only + p.tgt_only + p.neither - 1) < 1e-12


def test_expansion(spark):
    run = spark.createDataFrame([("q", "seed", 10.0, 1), ("q", "other", 2.0, 2)], "qid string, doc string, score double, rank int")
    edges = spark.createDataFrame([("seed", "target")], "src string, dst string")
    assert [(r.doc, r.score) for r in retrieval.expand(run, edges, seed_k=1, direction="outgoing").orderBy("rank").collect()] == [("seed", 10.0), ("target", 8.0)]
    run = spark.createDataFrame([("q", "p1", 5.0, 1), ("q", "p2", 4.0, 2)], "qid string, doc string, score double, rank int")
    edges = spark.createDataFrame([("p1", "shared"), ("p2", "shared")], "src string, dst string")
    out = {r.doc: r.score for r in retrieval.expand(run, edges, weight=0.5, mode="sum", direction="outgoing").collect()}
    assert out["shared"] == 4.5
    with pytest.raises(ValueError):
        retrieval.expand(run, edges, mode="other")


def test_labels_and_votes(spark):
    label = lambda s, t, b, n: spark.range(1).select(retrieval.difficulty_label(F.lit(s), F.lit(t), F.lit(b), n)).first()[0]
    assert label(3, 3, 3, 3) == "easy" and label(3, 3, 3, 4) == "easy" and label(2, 2, 2, 4) == "medium"
    assert label(1, 1, 0, 3) == "hard" and label(1, 0, 0, 3) == "source_only" and label(0, 0, 0, 0) == "neither"
    runs = spark.createDataFrame([("bm25", "q", "s", 1.0), ("e5", "q", "s", 1.0), ("e5", "q", "t", 1.0), ("dense", "q", "t", 1.0)], RUN)
    items = spark.createDataFrame([("q", "s", "t"), ("none", "a", "b")], "qid string, src string, tgt string")
    v = {r.qid: r for r in retrieval.votes(runs, items).collect()}
    assert (v["q"].source_votes, v["q"].target_votes, v["q"].both_votes, v["q"].both_runs) == (2, 2, 1, "e5") and v["none"].source_votes == 0
    decide = lambda s, t: spark.range(1).select(retrieval.vote_decision(F.lit(s), F.lit(t))).first()[0]
    assert decide(4, 4) == "KEEP" and decide(3, 0) == "JUDGE" and decide(5, 2) == "DROP"


def test_bm25_counts_repeats_and_drops_zero(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma delta"), (4, "")], "doc long, text string")
    once = {r.doc: r.score for r in retrieval.bm25(docs, spark.createDataFrame([(9, "beta")], "qid long, text string"), 5).collect()}
    twice = {r.doc: r.score for r in retrieval.bm25(docs, spark.createDataFrame([(9, "beta beta")], "qid long, text string"), 5).collect()}
    assert set(once) == {1} and abs(twice[1] - 2 * once[1]) < 1e-8


def test_consensus_and_guard(spark):
    passes = spark.createDataFrame([("a", 1, "PASS", None, 0.9), ("a", 2, "DROP", "x", 0.5), ("b", 1, "DROP", "x", 0.5), ("b", 2, "DROP", "y", 0.6), ("b", 3, "PASS", None, 0.1), ("c", 1, "PASS", None, 0.5), ("c", 2, "DROP", "z", 0.5)], "item string, pass_no int, decision string, reason string, confidence double")
    rows = {r.item: r for r in curation.consensus(passes).collect()}
    assert rows["a"].decision == "PASS" and rows["a"].reason is None and rows["a"].low_consensus
    assert (rows["b"].decision, rows["b"].reason) == ("DROP", "x") and (rows["c"].decision, rows["c"].reason) == ("DROP", None)
    votes = spark.createDataFrame([(True,), (False,)], "v boolean")
    assert votes.agg(curation.majority(F.col("v"))).first()[0] is False and votes.agg(curation.majority(F.col("v"), strict=False)).first()[0] is True
    d, r = curation.guarded(F.lit("PASS"), F.lit(None), F.lit(False), F.lit(True), F.lit(False), F.lit(True))
    assert tuple(spark.range(1).select(d, r).first()) == ("DROP", "QP_ILL_FORMED")


def test_judge_replies(spark):
    good = '{"final_score": 8, "binary_checks": {"source_relevant": true, "target_relevant": true, "source_alone_sufficient": false, "target_adds_essential_information": true, "answer_supported": true, "citation_dependent": true}}'
    replies = [good, good.replace('"source_alone_sufficient": false', '"source_alone_sufficient": true'), good.replace("8", "6"), '```json\n{"decision_qp": "PASS_QP", "confidence": 0.7, "source_alone_insufficient": true}\n```', "nothing", None]
    rows = [r.j for r in spark.createDataFrame([(k, v) for k, v in enumerate(replies)], "k int, raw string").select("k", curation.parse_judgement(F.col("raw")).alias("j")).orderBy("k").collect()]
    assert rows[0].decision == "PASS_QP" and rows[0].score == 8 and rows[0].confidence == 0.8
    assert (rows[1].decision, rows[1].reason) == ("DROP_QP", "QP_NOT_CIT_DEP") and rows[2].decision == "DROP_QP"
    assert rows[3].version == "v1" and rows[3].source_alone_sufficient is False and rows[4] is None and rows[5] is None


def test_cohorts(spark):
    judged = spark.createDataFrame([("q1", "PASS"), ("q2", "PASS"), ("q3", "DROP")], "item string, decision string")
    answered = spark.createDataFrame([("q1", "PASS"), ("q3", "PASS")], "item string, decision string")
    items = spark.createDataFrame([("q1",)], "item string")
    assert {r.item: r.cohort for r in curation.cohorts(judged, answered, items).collect()} == {"q1": "answer_valid", "q2": "dependency_valid"}


def test_agreement(spark):
    rows = [(str(k), "c", who, v) for k, pair in enumerate([(True, True), (True, False), (False, False)]) for who, v in zip("ab", pair, strict=True)]
    labels = spark.createDataFrame(rows, "item string, criterion string, annotator string, label boolean")
    assert abs(curation.cohen_kappa(labels).first().kappa - 0.4) < 1e-12
    assert abs(curation.cohen_kappa(labels.where("item <> '1'")).first().kappa - 1.0) < 1e-12
    majority = {r.item: r.majority for r in curation.label_majority(labels).collect()}
    assert majority == {"0": True, "1": None, "2": False}


def test_contrast(spark):
    rows = spark.createDataFrame([("i", "both", 0.8), ("j", "source_only", 0.5), ("k", "target_only", 0.4), ("l", "neither", 0.2)], "item string, outcome string, m double").withColumn("g", F.lit("g"))
    assert abs(curation.quality_by_outcome(rows, ["g"], ["m"]).first().contrast - (0.8 - (0.5 + 0.4 + 0.2) / 3)) < 1e-12


def test_allocations():
    assert xrefs.bucket_allocation({"low_overlap": 2, "multi_ref": 50, "definition_condition": 50, "random": 50}, 20) == {"low_overlap": 2, "multi_ref": 4, "definition_condition": 10, "random": 4}
    assert xrefs.largest_remainder({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert sum(xrefs.largest_remainder({k: k + 1 for k in range(7)}, 23).values()) == 23


def test_components_and_partitions(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7)], "src long, dst long")
    found = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100}


def test_html_and_links(spark):
    page = '<html><nav><p>Menu entry that is long enough to count</p></nav><article><h1>Title</h1><a id="x"></a><p>Short</p><p id="one">This is a paragraph with words, see <a href="../b#c">there</a>.</p><div class="advert"><p>Advertisement with quite many words in it</p></div><p>Another paragraph of sufficient length here</article></html>'
    rows = html.passages(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).orderBy("position").collect()
    assert [(r.anchor, r.headings) for r in rows] == [("one", ["Title"]), ("p000001", ["Title"])] and rows[0].anchors == ["one", "x"]
    found = html.links(spark.createDataFrame([(1, "http://h.org/a/p", page)], "page_id long, url string, html string")).collect()
    assert [(r.href, r.absolute) for r in found] == [("../b#c", "http://h.org/b#c")]
    docs = spark.createDataFrame([(1, "http://h.org/b", 0), (2, "http://h.org/d/01-02-2020", 1)], "doc long, url string, load_order int")
    anchors = spark.createDataFrame([(1, "Sec-1", 10, 0), (1, "c", 11, 1), (2, "z", 20, 0)], "doc long, anchor string, passage long, position int")
    refs = [(1, "#c"), (2, "#C"), (3, "#sec%2D1"), (4, "#no"), (5, "")]
    table = spark.createDataFrame([(k, "http://h.org/a", "http://h.org/b" + f) for k, f in refs] + [(6, "http://h.org/a", "mailto:x"), (7, "http://h.org/a", "http://else.org/q"), (8, "http://h.org/a", "http://h.org/d")], "ref long, page_url string, href string")
    got = {r.ref: (r.passage, r.reason) for r in links.resolve(table, docs, anchors).collect()}
    assert got[1] == (11, "exact") and got[2] == (11, "lower") and got[3] == (10, "normalised") and got[4] == (10, "document")
    assert got[6] == (None, "bad_href") and got[7] == (None, "off_site") and got[8] == (20, "document")


def test_reports(spark):
    rows = spark.createDataFrame([("a_b", 1), (None, 2)], "k string, n long")
    assert statistics.markdown_table(rows).count("|") == 12 and r"a\_b" in statistics.latex_table(rows)
