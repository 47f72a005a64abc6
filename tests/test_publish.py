import uuid

import pytest
from pyspark.sql import functions as F

from citeweave.operators import links, records, replies
from citeweave.sources import io, lines, publish


def test_lines_of_several_splits_are_numbered(spark, tmp_path):
    rows = [f"q{k % 7} Q0 d{k} {k} {k / 10} r" for k in range(20_000)]
    (tmp_path / "big.trec").write_text("\n".join(rows) + "\n")
    (tmp_path / "small.trec").write_text("q0 Q0 x 1 1.0 s\r\nq0 Q0 y 2 0.5 s\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        numbered = lines.numbered_lines(spark, str(tmp_path))
        assert lines.placed_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        got = sorted((r.file, r.line, r.value) for r in numbered.collect())
        assert got == [("big", k, v) for k, v in enumerate(rows)] + [("small", 0, "q0 Q0 x 1 1.0 s"), ("small", 1, "q0 Q0 y 2 0.5 s")]
        ranks = {(r.run, r.qid, r.doc): r["rank"] for r in io.read_ranked_lists(spark, str(tmp_path)).collect()}
        assert all(ranks["big", f"q{k % 7}", f"d{k}"] == k // 7 + 1 for k in range(20_000))
        # of a document's repeats in different splits the last line counts
        (tmp_path / "big.trec").write_text("\n".join(["q Q0 d 1 9.0 r", *rows, "q Q0 d 2 1.0 r"]))
        assert [(r["rank"], r.score) for r in io.read_run(spark, str(tmp_path / "big.trec")).where("doc = 'd'").collect()] == [(2, 1.0)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_readers_see_the_old_table_or_the_new(spark, tmp_path):
    folder = "file://" + str(tmp_path / "t")
    assert publish.current(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, folder)
    publish.publish_table(spark.range(3), folder)
    old = publish.read(spark, folder)

    def dies(path):
        spark.range(9).write.parquet(f"{path}/part")
        raise RuntimeError("killed between folders")

    with pytest.raises(RuntimeError):
        publish.publish(spark, folder, dies)
    assert publish.read(spark, folder).count() == 3
    publish.publish_table(spark.range(5), folder)
    assert old.count() == 3 and publish.read(spark, folder).count() == 5
    assert len(publish.purge(spark, folder)) == 2 and publish.read(spark, folder).count() == 5 and publish.purge(spark, folder) == []


def test_published_upsert(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = lambda rows: spark.createDataFrame(rows, "corpus string, n int")
    publish.upsert(table([("a", 1), ("b", 2), ("b", 3)]), folder, ["corpus"])
    publish.upsert(table([("b", 9)]), folder, ["corpus"])
    assert sorted(map(tuple, publish.read(spark, folder).collect())) == [("a", 1), ("b", 9)]


def test_staging_purges_and_aliases(spark, tmp_path):
    folder, schema = str(tmp_path / "s"), "run string, qid string, doc string, rank int, score double"
    runs = spark.createDataFrame([("dense", "q", "b", 2, 0.5), ("dense", "q", "a", 1, 1.0), ("old", "q", "z", 1, 1.0)], schema)
    path = publish.stage_runs(runs, folder, ("dense", "bm25"), {"e5": "dense", "rrf": "bm25"})
    assert publish.staged_names(spark, folder) == ["dense", "e5"]
    assert [r.value for r in spark.read.text(f"{path}/run=e5").collect()] == ["q Q0 a 1 1.0 e5", "q Q0 b 2 0.5 e5"]
    assert publish.stage_runs(runs.where("run = 'old'"), folder, ("old",)) == path
    publish.stage_runs(runs.where("run = 'old'"), folder, ("old",), restage=True)
    assert publish.staged_names(spark, folder) == ["old"]


def test_repeated_items_have_fixed_winners(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    passed = t([("a", "PASS", 1, "v1"), ("a", "PASS", 2, "v2"), ("b", "PASS", 1, "v3"), ("a", "DROP", 9, "no")], "item string, decision string, seq int, judge_schema_version string")
    every = t([("a", 1, True, None), ("a", 2, None, True), ("b", 1, False, False)], "item string, seq int, citation_dependent boolean, source_alone_sufficient boolean")
    good = t([("a", "PASS", 1, 0.1), ("a", "PASS", 3, 0.3), ("a", "PASS", 2, 0.2)], "item string, decision string, seq int, confidence_mean double")
    bad = t([("b", "DROP", 1, 0.7), ("b", "DROP", 2, 0.8)], "item string, decision string, seq int, confidence_mean double")
    none = t([], "item string, seq int")
    made = t([("a", 2, "second"), ("a", 1, "first"), ("b", None, "x"), ("b", None, "y")], "item string, seq int, question string")
    rows = {r.item: r for r in records.cohort_records(passed, every, good, bad, none, none, made).collect()}
    assert (rows["a"].judge_schema_version, rows["a"].citation_dependent, rows["a"].source_alone_sufficient) == ("v2", True, True)
    assert (rows["a"].question, rows["a"].answer_validation_score, rows["b"].answer_validation_score) == ("second", 0.3, 0.8)
    again = {records.cohort_records(passed, every, good, bad, none, none, made.repartition(n)).where("item = 'b'").first().question for n in (1, 2, 5)}
    assert len(again) == 1


def test_unknown_links_stay_out_of_the_exchange(spark):
    """Half of the links lead nowhere, many have no fragment: no key gathers them."""
    refs = spark.range(4000).select(
        F.col("id").alias("ref"),
        F.lit("http://h.org/p").alias("page_url"),
        F.when(F.col("id") % 2 == 0, "").when(F.col("id") % 10 == 1, F.concat(F.lit("http://h.org/d"), F.col("id") % 50)).otherwise(F.concat(F.lit("http://h.org/d"), F.col("id") % 50, F.lit("#A-"), F.col("id") % 4)).alias("href"),
    )
    docs = spark.range(50).select(F.col("id").alias("doc"), F.concat(F.lit("http://h.org/d"), "id").alias("url"), F.col("id").alias("load_order"))
    anchors = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")).select("doc", F.concat(F.lit("a"), "position").alias("anchor"), (F.col("doc") * 10 + F.col("position")).alias("passage"), "position")
    got = {r.reason: r["count"] for r in links.resolve(refs, docs, anchors).groupBy("reason").count().collect()}
    odd = [k for k in range(4000) if k % 2]
    plain = sum(k % 10 == 1 for k in odd)
    found = sum(k % 10 != 1 and k % 4 < 3 for k in odd)
    assert got == {"bad_href": 2000, "normalised": found, "document": len(odd) - found}
    assert plain and links.resolve(refs, docs, anchors, to_document=False).where("reason = 'document'").count() == 0
    keyed = links._keyed(refs, ["ref"], [F.regexp_extract("href", "#(.*)$", 1)])
    assert keyed.count() == len(odd) - plain


def test_logged_replies_are_not_asked_again(spark, tmp_path):
    """A model that counts its calls in files dies half-way; the second run asks what is left, each prompt once."""
    log = replies.ReplyLog(str(tmp_path / "log"))
    rows = spark.createDataFrame([(k, f"prompt {k % 30}") for k in range(60)], "item long, prompt string").repartition(3)

    def model_that(dies):
        def model(prompt):
            if dies and int(prompt.split()[1]) >= 20:
                raise SystemExit  # not an error of the call: the task is lost
            (tmp_path / "calls").mkdir(exist_ok=True)
            (tmp_path / "calls" / f"{prompt}-{uuid.uuid4().hex}").write_text("")
            return prompt.upper()

        return model

    with pytest.raises(Exception):  # noqa: B017
        replies.ask(rows.orderBy("item").coalesce(1), model_that(True), wants_json=False, log=log).collect()
    early = len(list((tmp_path / "calls").iterdir()))
    assert early == 20
    out = replies.ask(rows.coalesce(1), model_that(False), wants_json=False, at_once=4, log=log).collect()
    assert all(r.ok and r.content == f"PROMPT {r.item % 30}" for r in out) and len(out) == 60
    asked = sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "calls").iterdir())
    assert asked == sorted(f"prompt {k}" for k in range(30))


def test_waits_double(monkeypatch):
    waits = []
    monkeypatch.setattr(replies.time, "sleep", waits.append)
    assert replies.one_call(lambda p: "", "x", 3, False, 0.5) == (False, "", "empty_response", 4) and waits == [0.5, 1.0, 2.0]
