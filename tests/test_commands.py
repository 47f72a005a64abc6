"""The stages over small files, and models that answer or fail."""

import json

import pytest
from pyspark.sql import functions as F

from citeweave import commands
from citeweave.operators import html, kept_index, replies
from citeweave.plans.config import Config, Generation
from citeweave.sources import io, publish


def write(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read(spark, path):
    return spark.read.json(str(path)).collect()


@pytest.fixture()
def files(tmp_path):
    long = "A firm must report each breach of its duties to the board within thirty days of the event, and it must keep records."
    passages = [{"passage_uid": f"p{k}", "doc_id": f"d{k % 2}", "passage": f"{long} Part number {k} says so, and rule {k} too."} for k in range(6)]
    refs = [{"source_uid": f"p{k}", "target_uid": f"p{(k + 1) % 6}", "ref_type": "Internal", "ref_text": f"rule {k}", "seq": k} for k in range(6)] + [{"source_uid": "p1", "target_uid": "p1", "ref_type": "Internal", "ref_text": "x", "seq": 9}]
    return write(tmp_path / "p.jsonl", passages), write(tmp_path / "r.jsonl", refs)


def test_from_references_to_metrics(spark, tmp_path, files):
    passages, refs = files
    config = Config(generation=Generation(pairs=4, per_pair=1))
    commands.generate(spark, config, refs, passages, f"{tmp_path}/g")
    prompts = read(spark, tmp_path / "g/prompts")
    assert len(prompts) == 4 and all("professional" in p.prompt and "must report" in p.prompt for p in prompts)
    assert {(r.reason, r.n) for r in read(spark, tmp_path / "g/dropped")} == {("degenerate", 1)}
    tags = lambda p: f" [#SRC:{p.source_uid}] [#TGT:{p.target_uid}]"
    said = [{"pair_uid": p.pair_uid, "source_uid": p.source_uid, "target_uid": p.target_uid, "content": json.dumps({"professional": [{"question": q, "answer": "yes" + tags(p)}, {"question": "again " + q, "answer": "yes" + tags(p)}]})} for k, p in enumerate(prompts) for q in [f"What of part number {p.source_uid[1:]}?" if k else "What does Rule 4.2.1 say?"]]
    commands.generate(spark, config, refs, passages, f"{tmp_path}/g2", write(tmp_path / "said.jsonl", said))
    items = read(spark, tmp_path / "g2/items")
    assert len(items) == 3 and len(read(spark, tmp_path / "g2/leaking-items")) == 1
    assert {(r.reason, r.n) for r in read(spark, tmp_path / "g2/question-reasons")} == {("over_cap", 4)}
    commands.merge(spark, config, [f"{tmp_path}/g2/items"], passages, f"{tmp_path}/m")
    commands.search(spark, config, f"{tmp_path}/m/items", passages, f"{tmp_path}/s", write(tmp_path / "e.jsonl", [{"src": f"p{k}", "dst": f"p{(k + 1) % 6}"} for k in range(6)]))
    commands.vote(spark, config, f"{tmp_path}/m/items", [f"{tmp_path}/s/bm25", f"{tmp_path}/s/bm25_xref_expand"], f"{tmp_path}/v")
    assert all(r.source_votes == 2 for r in read(spark, tmp_path / "v/votes"))
    commands.evaluate(spark, config, [f"{tmp_path}/s/bm25", f"{tmp_path}/s/bm25_xref_expand"], f"{tmp_path}/s/qrels", f"{tmp_path}/x")
    assert {r.run for r in read(spark, tmp_path / "x/metrics-10")} == {"bm25", "bm25_xref_expand"}
    commands.finalize(spark, config, f"{tmp_path}/m/items", f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").count() == 3
    commands.validate(spark, config, f"{tmp_path}/m/items", f"{tmp_path}/ok")
    assert read(spark, tmp_path / "ok")[0].share == 1.0
    commands.audit_export(spark, config, f"{tmp_path}/m/items", f"{tmp_path}/a")


def test_dense_and_kept_searches_are_staged(spark, tmp_path, files):
    passages, _ = files
    items = write(tmp_path / "i.jsonl", [{"item": f"i{k}", "question": f"What does rule {k} say of part number {k}?", "source_passage_id": f"p{k}", "target_passage_id": f"p{(k + 1) % 6}"} for k in range(3)])
    vectors = write(tmp_path / "v.jsonl", [{"doc": f"p{k}", "vector": [1.0, k / 6]} for k in range(6)])
    asked = write(tmp_path / "q.jsonl", [{"qid": f"i{k}", "vector": [1.0, k / 6]} for k in range(3)])
    edges = write(tmp_path / "e.jsonl", [{"src": "p0", "dst": "p5"}])
    passes = write(tmp_path / "j.jsonl", [{"item": "i0", "pass_no": 1, "decision": "PASS", "confidence": 0.9, "score": 8}])
    for _ in range(2):  # the second time the index is there already
        commands.curate(spark, Config(), [items], passages, f"{tmp_path}/c", edges, passes, f"{tmp_path}/index", vectors, asked)
    names = ["bm25", "bm25_xref_expand", "dense", "dense_xref_expand", "rrf_bm25_dense", "rrf_xref_expand"]
    runs = [f"{tmp_path}/c/ir/{n}" for n in names]
    found = {(r.run, r.qid): r.doc for p in runs for r in io.read_run(spark, p).where("rank = 1").collect()}
    assert {run for run, _ in found} == set(names) and all(found["dense", f"i{k}"] == found["bm25", f"i{k}"] == f"p{k}" for k in range(3))
    assert {r.source_votes for r in read(spark, tmp_path / "c/votes/votes")} == {6}
    assert {r.run for r in read(spark, tmp_path / "c/metrics/metrics-10")} == set(names)
    commands.stage(spark, Config(), runs, f"{tmp_path}/staged")
    assert publish.staged_names(spark, f"{tmp_path}/staged") == sorted([*names, "e5", "rrf"])
    with pytest.raises(kept_index.StaleIndex):
        commands.search(spark, Config(), items, write(tmp_path / "p2.jsonl", [{"passage_uid": "p0", "passage": "other text"}]), f"{tmp_path}/x", index=f"{tmp_path}/index")


def test_reports_on_what_was_made(spark, tmp_path):
    rows = [{"run": "r", "outcome": o, "f1": v, "cites": v > 0.5} for o, v in (("both", 0.9), ("SRC-only", 0.3), ("neither", 0.1))]
    commands.quality_by_retrieval(spark, Config(), write(tmp_path / "a.jsonl", rows), f"{tmp_path}/q")
    got = {(r.outcome, r.metric): (r["mean"], round(r.contrast, 6)) for r in read(spark, tmp_path / "q")}
    assert got["both", "f1"] == (0.9, 0.7) and got["source_only", "cites"] == (0.0, 1.0)
    made = [{"item": "a", "cohort": "answer_valid", "method": "x"}, {"item": "b", "cohort": "answer_failed", "method": None}]
    commands.benchmark_statistics(spark, Config(), write(tmp_path / "b.jsonl", made), f"{tmp_path}/b")
    assert {(r.field, r.value, r.cohort, r.n) for r in read(spark, tmp_path / "b/groups")} >= {("overall", "all", "all", 2), ("method", "missing", "answer_failed", 1)}


def test_verdicts_audits_and_answers(spark, tmp_path):
    passes = [{"item": "a", "pass_no": 1, "decision": "PASS", "confidence": 0.9, "score": 8, "source_alone_sufficient": True}, {"item": "b", "pass_no": 1, "decision": "PASS", "confidence": 0.9}]
    commands.judge(spark, Config(), write(tmp_path / "j.jsonl", passes), f"{tmp_path}/j")
    assert [(r.item, r.reason) for r in read(spark, tmp_path / "j/drop")] == [("a", "QP_NOT_CIT_DEP")] and len(read(spark, tmp_path / "j/pass")) == 1
    commands.judge(spark, Config(), str(tmp_path / "j.jsonl"), f"{tmp_path}/j2", answers=True)
    assert len(read(spark, tmp_path / "j2/pass")) == 2
    labels = [{"item": f"i{k}", "criterion": "c", "annotator": who, "label": "yes" if k % 2 or who == "x" else "no"} for k in range(4) for who in "xy"]
    commands.audit_aggregate(spark, Config(), write(tmp_path / "l.jsonl", labels), f"{tmp_path}/l")
    assert read(spark, tmp_path / "l/agreement")[0].agreement == 0.75
    commands.answer_eval(spark, Config(), write(tmp_path / "q.jsonl", [{"item": "a", "run": "r", "answer": "one two", "reference": "one two", "context": "one"}]), f"{tmp_path}/q")
    assert (lambda r: (r.rouge_l, r.passage_overlap))(read(spark, tmp_path / "q/answers")[0]) == (1.0, 0.5)


def test_pages_to_passages(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/one.html").write_text("<main><p id='x'>A paragraph that is long enough to stay here, see <a href='#x'>this one</a>.</p><p>Part one of many things in here now</p></main>")
    commands.adapter(spark, Config(), str(tmp_path / "h"), f"{tmp_path}/o")
    assert [r.passage[:11] for r in read(spark, tmp_path / "o/passages")] == ["A paragraph"]
    assert [(r.reason, r.kind) for r in read(spark, tmp_path / "o/references")] == [("exact", "internal")]


@pytest.mark.parametrize(("text", "keeps"), [("Contents of it ..... page 4 of many", False), ("Legal instruments that change this rule since", False), ("Annexes to the rulebook in full length", False), ("Partial repeal of the rules is allowed here", True), ("too short a text", False), ("Policy statement on the new regime of rules", False)])
def test_passages_that_only_lead_elsewhere(text, keeps):
    assert html.is_meaningful(text) == keeps


def test_page_furniture():
    page = "<body>" + "".join(f"<div class='{c}'><p>This block stands in {c} and is long enough.</p></div>" for c in ("nav-menu", "cookie-box", "my_consent", "advert", "sidebar", "share", "header-text")) + "</body>"
    assert [p[5].split()[4] for p in html.parse(page)[0]] == ["nav-menu"]  # the first block alone is the container
    page = "<main>" + page.removeprefix("<body>").removesuffix("</body>") + "</main>"
    assert [p[5].split()[4] for p in html.parse(page)[0]] == ["nav-menu", "share", "header-text"]


def test_models_answer_or_fail(spark):
    def model(prompt):
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return prompt.upper()

    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "boom"), (3, "plain"), (4, "")], "item long, prompt string")
    found = {r.item: (r.ok, r.error, r.attempts) for r in replies.ask(rows, model, retries=1).collect()}
    assert found == {1: (True, None, 1), 2: (False, "no answer", 2), 3: (False, "invalid_json", 2), 4: (False, "invalid_json", 2)}
    assert {r.item: r.ok for r in replies.ask(rows, model, retries=0, wants_json=False).collect()} == {1: True, 2: False, 3: True, 4: False}
    told = replies.replay(rows, rows.where("item = 3").select("item", F.col("prompt").alias("content"))).collect()
    assert sorted((r.item, r.ok, r.error) for r in told) == [(1, False, "no_reply"), (2, False, "no_reply"), (3, True, None), (4, False, "no_reply")]


def test_lenient_json():
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', 'so: {"a": 1} there'):
        assert replies.lenient_json(text) == {"a": 1}
    assert replies.lenient_json("none") is None and replies.lenient_json("[1]") is None
