"""The stages of the workflow over files: each reads JSON lines (or pages) and writes JSON lines below a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import curation, html, kept_index, links, records, replies, retrieval, sampling, statistics, tables, xrefs
from citeweave.plans.config import Config
from citeweave.sources import io, publish

PASSAGE = "passage_uid string, doc_id string, passage string"
REFERENCE = "source_uid string, target_uid string, ref_type string, ref_text string, source_inline string, target_inline string, seq long"
REPLY = "pair_uid string, source_uid string, target_uid string, content string"
ITEM = "item string, question string, gold_answer string, source_passage_id string, target_passage_id string, method string, persona string, pair_uid string, split string"
PASS = "item string, pass_no int, decision string, reason string, confidence double, score double, " + ", ".join(f"{c} boolean" for c in dict.fromkeys((*records.JUDGE_CHECKS, *records.ANSWER_CHECKS)))
LABEL = "item string, criterion string, annotator string, label string"
STAGED = ("bm25", "dense", "rrf_bm25_dense", "bm25_xref_expand", "dense_xref_expand", "rrf_xref_expand", "ce_rerank_union")
ALIASES = {"e5": "dense", "rrf": "rrf_bm25_dense"}
ANSWER = "item string, run string, question string, answer string, reference string, context string"


def _pairs_as_passages(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("passage_uid").alias("doc"), F.col("passage").alias("text"))


def adapter(spark: SparkSession, config: Config, pages: str, out: str) -> None:
    """Pages to passages and resolved references."""
    files = html.decode(spark.read.format("binaryFile").load(pages).select("path", "content"))
    docs = files.select(F.xxhash64("path").alias("page_id"), F.regexp_replace("path", "^file:/+", "file:///").alias("url"), "html")
    found = html.passages(docs)
    uid = F.concat_ws("::", F.col("page_id").cast("string"), F.col("anchor"))
    io.write_jsonl(found.select(uid.alias("passage_uid"), F.col("page_id").cast("string").alias("doc_id"), F.col("text").alias("passage"), F.col("headings").alias("heading_path"), F.col("anchors").alias("anchor_ids")), f"{out}/passages")
    refs = html.links(docs).join(docs.select("page_id", F.col("url").alias("page_url")), "page_id").select(F.concat_ws("::", F.col("page_id").cast("string"), F.col("position").cast("string"), F.col("href")).alias("ref"), "page_url", F.col("absolute").alias("href"))
    anchors = found.select(F.col("page_id").alias("doc"), F.explode(F.array_union(F.array("anchor"), "anchors")).alias("anchor"), uid.alias("passage"), "position")
    resolved = links.resolve(refs, docs.select(F.col("page_id").alias("doc"), "url", F.col("page_id").alias("load_order")), anchors, to_document=False)
    io.write_jsonl(resolved, f"{out}/references")
    io.write_jsonl(statistics.reason_counts(resolved), f"{out}/reasons")


def generate(spark: SparkSession, config: Config, references: str, passages: str, out: str, replies_path: str | None = None, personas: tuple[str, ...] = ("professional", "basic"), leaks: str = "separate") -> None:
    """References to prompts, and recorded replies to questions."""
    known = io.read_jsonl(spark, passages, PASSAGE)
    docs = known.select(F.col("passage_uid").alias("doc"), F.col("passage").alias("text"), F.col("doc_id").alias("origin"))
    pairs = xrefs.build_pairs(io.read_jsonl(spark, references, REFERENCE), known.select(F.col("passage_uid").alias("uid"), F.col("passage").alias("text")))
    reason = xrefs.pair_drop_reason(F.col("source_text"), F.col("target_text"), F.col("ref_type"), F.col("source_uid"), F.col("target_uid"))
    judged = pairs.withColumn("reason", reason)
    io.write_jsonl(statistics.reason_counts(judged), f"{out}/dropped")
    kept = judged.where("reason is null").select("seq", F.col("source_uid").alias("source_id"), F.col("target_uid").alias("target_id"), "ref_type", "ref_text")
    features, _ = tables.written(xrefs.features_of_references(kept, xrefs.document_features(docs), docs), "features")
    rows, report = sampling.sample(features, config.generation.rows or config.sampling.n, config.sampling.mode, config.sampling.seed, low_overlap=config.sampling.low_overlap)
    rows = sampling.capped(rows, config.generation.pairs)
    text = lambda side: docs.select(F.col("doc").alias(f"{side}_id"), F.col("text").alias(f"{side}_text"))
    asked = rows.join(text("source"), "source_id").join(text("target"), "target_id")
    pair_uid = T.uid(F.col("ref_type"), F.col("ref_text"), F.col("source_id"), F.col("target_id"), caps=(0, 120, 0, 0))
    prompt = replies.question_prompt(F.col("source_text"), F.col("target_text"), F.col("ref_text"), personas, config.generation.per_pair)
    io.write_jsonl(asked.select(pair_uid.alias("pair_uid"), F.col("source_id").alias("source_uid"), F.col("target_id").alias("target_uid"), prompt.alias("prompt")), f"{out}/prompts")
    io.write_jsonl(spark.createDataFrame([(k, str(v)) for k, v in report.items()], "name string, value string"), f"{out}/sampling")
    if replies_path is None:
        return
    found = replies.extract_questions(io.read_jsonl(spark, replies_path, REPLY), personas, config.generation.per_pair)
    io.write_jsonl(statistics.reason_counts(found), f"{out}/question-reasons")
    good = found.where("reason is null").withColumn("leaks", F.size(T.leakages(F.col("question"))) > 0)
    routed = good.withColumn("route", curation.leakage_route(leaks, F.col("leaks"))).select(T.uid(F.col("pair_uid"), F.col("persona"), F.col("question")).alias("item"), "question", F.col("answer").alias("gold_answer"), F.col("source_uid").alias("source_passage_id"), F.col("target_uid").alias("target_passage_id"), F.lit("direct").alias("method"), "persona", "pair_uid", F.col("leaks").alias("citation_leakage"), "route")
    io.write_jsonl(routed.where("route = 'kept'").drop("route"), f"{out}/items")
    io.write_jsonl(routed.where("route = 'separate'").drop("route"), f"{out}/leaking-items")


def merge(spark: SparkSession, config: Config, items: list[str], passages: str, out: str) -> None:
    """Items of several methods as one table, and the passages they need."""
    every = None
    for path in items:
        part = io.read_jsonl(spark, path, ITEM)
        every = part if every is None else every.unionByName(part)
    io.write_jsonl(every, f"{out}/items")
    known = io.read_jsonl(spark, passages, PASSAGE).select(F.col("passage_uid").alias("key"), F.col("passage").alias("text"))
    io.write_jsonl(records.passages_needed(every, known), f"{out}/passages")


def search(spark: SparkSession, config: Config, items: str, passages: str, out: str, edges: str | None = None, index: str | None = None, vectors: str | None = None, query_vectors: str | None = None) -> None:
    """The searches of all items as run files, and qrels.

    Lexical search, in the index kept at ``index`` if one is named (built there at the first call; one of other
    passages is an error); dense search and its fusion with the lexical one, where vectors of passages (doc, vector)
    and of items (qid, vector) are given; and the graph expansion of each where edges are given.
    """
    rows, known = io.read_jsonl(spark, items, ITEM), _pairs_as_passages(io.read_jsonl(spark, passages, PASSAGE))
    queries, k = rows.select(F.col("item").alias("qid"), F.col("question").alias("text")), config.retrieval.top_k
    name = lambda run, x: run.select(F.lit(x).alias("run"), "qid", "doc", "score", "rank")
    with tables.scratch(spark):
        lexical = kept_index.kept(known, index).search(queries, k) if index else retrieval.bm25(known, queries, k)
        found = name(lexical, "bm25")
        if vectors and query_vectors:
            side = lambda path, c: io.read_jsonl(spark, path, f"{c} string, vector array<double>")
            found = found.unionByName(name(retrieval.dense_topk(side(vectors, "doc"), side(query_vectors, "qid"), k), "dense"))
        found, _ = tables.written(found, "run")
        if vectors and query_vectors:
            found, _ = tables.written(found.unionByName(retrieval.fused_runs(found, "rrf_bm25_dense")), "run")
        runs = ("bm25", "dense", "rrf_bm25_dense") if vectors and query_vectors else ("bm25",)
        if edges:
            graph, e = io.read_jsonl(spark, edges, "src string, dst string"), config.expansion
        for run in runs:
            base = found.where(F.col("run") == run)
            io.write_run(base, f"{out}/{run}")
            if edges:
                wide = f"{run.removesuffix('_bm25_dense')}_xref_expand"
                io.write_run(name(retrieval.expand(base, graph, e.seed_k, e.final_k, e.direction, e.weight, e.mode, e.cap), wide), f"{out}/{wide}")
    io.write_qrels(retrieval.qrels(rows, "item", "source_passage_id", "target_passage_id"), f"{out}/qrels")


def stage(spark: SparkSession, config: Config, runs: list[str], out: str, restage: str | None = None) -> None:
    """Publish run files under the names evaluation expects, with the aliases of the configuration's layout."""
    publish.stage_runs(_runs(spark, runs), out, STAGED, ALIASES, restage is not None)


def vote(spark: SparkSession, config: Config, items: str, runs: list[str], out: str) -> None:
    """Votes of run files on each item, with decisions and labels."""
    rows = io.read_jsonl(spark, items, ITEM).select(F.col("item").alias("qid"), F.col("source_passage_id").alias("src"), F.col("target_passage_id").alias("tgt"))
    found = _runs(spark, runs)
    counted = retrieval.votes(found, rows)
    r = config.retrieval
    label = retrieval.difficulty_label(F.col("source_votes"), F.col("target_votes"), F.col("both_votes"), len(runs))
    io.write_jsonl(counted.withColumn("decision_ir", retrieval.vote_decision(F.col("source_votes"), F.col("target_votes"), r.keep_votes, r.judge_votes)).withColumn("ir_difficulty_label", label), f"{out}/votes")


def _runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    out = None
    for path in paths:
        part = io.read_run(spark, path)
        out = part if out is None else out.unionByName(part)
    return out


def evaluate(spark: SparkSession, config: Config, runs: list[str], qrels: str, out: str, all_queries: bool = True) -> None:
    """Metrics of run files."""
    found, wanted = _runs(spark, runs), io.read_qrels(spark, qrels).where("relevance > 0")
    for k in config.retrieval.cutoffs:
        io.write_jsonl(retrieval.metrics(found, wanted, k, all_queries), f"{out}/metrics-{k}")


def judge(spark: SparkSession, config: Config, passes: str, out: str, answers: bool = False) -> None:
    """Passes over items to verdicts, all and by decision, with counts."""
    rows = io.read_jsonl(spark, passes, PASS)
    verdicts, _ = retrieval.written((records.answer_verdicts if answers else records.judge_verdicts)(rows), "verdicts")
    io.write_verdicts(verdicts, out)
    io.write_jsonl(records.verdict_stats(verdicts), f"{out}/stats")


def finalize(spark: SparkSession, config: Config, items: str, out: str) -> None:
    """Items to train, dev and test, one folder for each method and split."""
    rows = curation.split(io.read_jsonl(spark, items, ITEM).drop("split"), "item", ["method"], config.split.seed, config.split.train, config.split.dev)
    io.write_partitioned(rows, out, ["method", "split"])


def audit_export(spark: SparkSession, config: Config, items: str, out: str) -> None:
    """A stratified sample for annotators."""
    sample, short = xrefs.stratified_sample(io.read_jsonl(spark, items, ITEM).na.fill(""), ["method", "persona"], config.audit.n, config.audit.seed, "item")
    io.write_csv(sample, out, ["audit_id", "item", "method", "persona", "question", "gold_answer"])
    if short:
        print(f"{short} items fewer than asked")


def audit_aggregate(spark: SparkSession, config: Config, labels: str, out: str) -> None:
    """Annotators' labels to majorities, agreement and kappa."""
    rows = io.read_jsonl(spark, labels, LABEL).withColumn("label", T.tri_state(F.col("label")))
    for name, table in (("majority", curation.label_majority(rows)), ("agreement", curation.percent_agreement(rows)), ("kappa", curation.cohen_kappa(rows))):
        io.write_jsonl(table, f"{out}/{name}")


def validate(spark: SparkSession, config: Config, items: str, out: str) -> None:
    """How many rows of each split have both passages."""
    rows = io.read_jsonl(spark, items, ITEM)
    has = ~T.absent(F.col("source_passage_id")) & ~T.absent(F.col("target_passage_id"))
    both = F.count(F.when(has, 1))
    io.write_jsonl(rows.groupBy("method", "split").agg(F.count("*").alias("n"), both.alias("with_ids"), (both / F.count("*")).alias("share")), out)


def answer_eval(spark: SparkSession, config: Config, answers: str, out: str) -> None:
    """Answers' overlap with references and passages, and their means by run."""
    rows = io.read_jsonl(spark, answers, ANSWER)
    a, r, c = (T.ascii_tokens(F.col(x)) for x in ("answer", "reference", "context"))
    words = F.array_distinct(a)
    scored = rows.select("item", "run", T.f1(T.lcs_length(a, r), F.size(a), F.size(r)).alias("rouge_l"), F.when(F.size(words) > 0, F.size(F.array_intersect(words, c)) / F.size(words)).otherwise(0.0).alias("passage_overlap"), F.size(T.words(F.col("answer"))).alias("words"))
    io.write_jsonl(scored, f"{out}/answers")
    io.write_jsonl(statistics.answer_summary(scored, ["run"], ["rouge_l", "passage_overlap", "words"]), f"{out}/summary")


def curate(spark: SparkSession, config: Config, items: list[str], passages: str, out: str, edges: str | None = None, passes: str | None = None, index: str | None = None, vectors: str | None = None, query_vectors: str | None = None) -> None:
    """Merging, searches, votes, metrics and, where passes of a judge are given, verdicts, one after another below ``out``."""
    merge(spark, config, items, passages, f"{out}/merged")
    search(spark, config, f"{out}/merged/items", passages, f"{out}/ir", edges, index, vectors, query_vectors)
    runs = [f"{out}/ir/{n}" for n in tables.list_folders(spark, f"{out}/ir") if n != "qrels"]
    vote(spark, config, f"{out}/merged/items", runs, f"{out}/votes")
    evaluate(spark, config, runs, f"{out}/ir/qrels", f"{out}/metrics")
    if passes:
        judge(spark, config, passes, f"{out}/judge")


def benchmark_statistics(spark: SparkSession, config: Config, records: str, out: str) -> None:
    """Counts of benchmark records overall, by cohort and by each known field, and how many each step of construction left."""
    rows = spark.read.json(records)
    absent = [F.lit(None).cast("string").alias(c) for c in ("cohort", "citation_leakage") if c not in rows.columns]
    rows = rows.select("*", *absent)
    io.write_jsonl(statistics.benchmark_groups(rows), f"{out}/groups")
    io.write_jsonl(statistics.construction_counts(rows), f"{out}/construction")


def quality_by_retrieval(spark: SparkSession, config: Config, answers: str, out: str) -> None:
    """Every numeric column of answers (run, outcome, ...) by run and outcome, with the contrast of ``both`` to the others."""
    rows = spark.read.json(answers)
    numeric = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("double", "long", "boolean")]
    known = rows.withColumn("outcome", curation.normal_outcome(F.col("outcome"))).select("run", "outcome", *[F.col(c).cast("double").alias(c) for c in numeric])
    io.write_jsonl(curation.quality_by_outcome(known, ["run"], numeric), out)


STAGES = {
    "adapter": (adapter, ("pages",)),
    "generate": (generate, ("references", "passages")),
    "merge": (merge, ("items*", "passages")),
    "search": (search, ("items", "passages")),
    "stage": (stage, ("runs*",)),
    "vote": (vote, ("items", "runs*")),
    "evaluate": (evaluate, ("runs*", "qrels")),
    "judge": (judge, ("passes",)),
    "finalize": (finalize, ("items",)),
    "audit-export": (audit_export, ("items",)),
    "audit-aggregate": (audit_aggregate, ("labels",)),
    "validate": (validate, ("items",)),
    "answer-eval": (answer_eval, ("answers",)),
    "curate": (curate, ("items*", "passages")),
    "benchmark-statistics": (benchmark_statistics, ("records",)),
    "quality-by-retrieval": (quality_by_retrieval, ("answers",)),
}
OPTIONS = {"generate": ("replies_path",), "search": ("edges", "index", "vectors", "query_vectors"), "stage": ("restage",), "curate": ("edges", "passes", "index", "vectors", "query_vectors")}
