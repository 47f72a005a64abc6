"""Full verdicts, queues and cohort records.

Tables are keyed by ``item``.  Where several tables carry one field, the first
that has a value gives it; an absent field and a null are the same here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.operators import curation, retrieval

JUDGE_CHECKS = ("source_alone_sufficient", "target_alone_sufficient", "target_adds", "citation_dependent", "answer_supported")
ANSWER_CHECKS = ("answer_responsive", "answer_supported", "tags_present_for_both", "hallucination_detected")


def judge_verdicts(passes: DataFrame) -> DataFrame:
    """One judgement per item: the consensus, majorities of checks (more than half), mean score, failure flags, and the guard.

    ``passes``: item, pass_no, decision, reason, confidence, score and the five checks.
    """
    agreed = curation.consensus(passes)
    checks = passes.groupBy("item").agg(F.bround(F.avg("score")).cast("int").alias("final_score"), *[curation.majority(F.col(c)).alias(c) for c in JUDGE_CHECKS])
    rows = agreed.join(checks, "item")
    sufficient, adds, supported, dependent = (F.col(c) for c in ("source_alone_sufficient", "target_adds", "answer_supported", "citation_dependent"))
    decision, reason = curation.guarded(F.col("decision"), F.col("reason"), sufficient, adds, supported, dependent)
    is_ = lambda c, value: F.coalesce(c == F.lit(value), F.lit(False))
    flags = [is_(sufficient, True).alias("fails_source_alone"), is_(adds, False).alias("fails_target_not_necessary"), is_(supported, False).alias("fails_unsupported_answer")]
    return rows.select("item", decision.alias("decision"), reason.alias("reason"), "n_passes", "votes_pass", "votes_drop", F.round("confidence_mean", 3).alias("confidence_mean"), F.round("weighted_fraction", 3).alias("weighted_fraction"), "low_consensus", "final_score", *JUDGE_CHECKS, *flags)


def answer_verdicts(passes: DataFrame) -> DataFrame:
    """One verdict on an answer per item: the consensus with reasons of all passes, and majorities of checks (half or more)."""
    agreed = curation.consensus(passes, answers=True)
    checks = passes.groupBy("item").agg(*[curation.majority(F.col(c), strict=False).alias(c) for c in ANSWER_CHECKS])
    return agreed.join(checks, "item").select("item", "decision", "reason", "n_passes", "votes_pass", "votes_drop", F.round("confidence_mean", 3).alias("confidence_mean"), F.round("weighted_fraction", 3).alias("weighted_fraction"), "low_consensus", *ANSWER_CHECKS)


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """Counts of verdicts, low consensus and mean confidence, in one row."""
    says = lambda d: F.count(F.when(F.col("decision") == d, 1))
    return verdicts.agg(F.count("*").alias("total"), says("PASS").alias("passed"), says("DROP").alias("dropped"), F.count(F.when(F.col("low_consensus"), 1)).alias("low_consensus"), F.round(F.coalesce(F.avg("confidence_mean"), F.lit(0.0)), 3).alias("confidence_mean"), F.round(F.coalesce(F.avg("weighted_fraction"), F.lit(0.0)), 3).alias("weighted_fraction"))


def with_failures(expected: DataFrame, replies: DataFrame, reason: str, checks: tuple[str, ...] = ()) -> DataFrame:
    """Replies by (item, pass_no); a pass that is missing or unreadable drops its item with no confidence and all checks false."""
    rows = expected.select("item", "pass_no").join(replies, ["item", "pass_no"], "left")
    failed = F.col("decision").isNull()
    out = rows.withColumn("failed", failed).withColumn("reason", F.when(failed, reason).otherwise(F.col("reason"))).withColumn("confidence", F.when(failed, 0.0).otherwise(F.col("confidence")))
    for c in checks:
        out = out.withColumn(c, F.when(failed, F.lit(False)).otherwise(F.col(c)))
    if "score" in rows.columns:
        out = out.withColumn("score", F.when(failed, F.lit(0)).otherwise(F.col("score")))
    return out.withColumn("decision", F.coalesce("decision", F.lit("DROP")))


def filled(*texts: Column) -> Column:
    """The first text that is not empty, else the empty text."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def with_texts(items: DataFrame, passages: DataFrame, source: str = "source_passage_id", target: str = "target_passage_id") -> DataFrame:
    """Items whose empty source and target texts are filled from (key, text) passages."""
    out = items
    for side, on in (("source", source), ("target", target)):
        out = out.join(passages.select(F.col("key").alias(on), F.col("text").alias(f"_{side}")), on, "left")
        out = out.withColumn(f"{side}_text", filled(F.col(f"{side}_text"), F.col(f"_{side}"))).drop(f"_{side}")
    return out


def judge_queue(items: DataFrame, passages: DataFrame, required=("item", "question", "source_passage_id", "target_passage_id")) -> DataFrame:
    """Items to be judged: those the retrieval decision sends there, or the older decision where that is absent, with texts filled in."""
    decision = F.coalesce("decision_ir", "decision") if "decision_ir" in items.columns else F.col("decision")
    ready = decision.isin("JUDGE", "JUDGE_IR")
    for c in required:
        ready &= F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return with_texts(items.where(ready), passages)


def answer_queue(passed: DataFrame, items: DataFrame, passages: DataFrame) -> DataFrame:
    """Items that passed the judge, once each, with both passages; items without two passage ids are left out."""
    ids = passed.where("decision = 'PASS'").select("item").distinct()
    known = items.where("coalesce(source_passage_id, '') <> '' and coalesce(target_passage_id, '') <> ''")
    bare = known.join(ids, "item", "left_semi").withColumn("source_text", F.lit("")).withColumn("target_text", F.lit(""))
    return with_texts(bare, passages)


def passages_needed(items: DataFrame, passages: DataFrame, key: str = "key") -> DataFrame:
    """The passages that items refer to on either side."""
    ids = items.select(F.explode(F.array_compact(F.array("source_passage_id", "target_passage_id"))).alias(key)).distinct()
    return passages.join(ids, key, "left_semi")


def with_constants(records: DataFrame, constants: dict[str, object]) -> DataFrame:
    """Records in which every constant field that is missing or null has its default."""
    for name, value in constants.items():
        have = F.col(name) if name in records.columns else F.lit(None)
        records = records.withColumn(name, F.coalesce(have, F.lit(value)))
    return records


def merged_reasons(final: Column, runs: Column) -> Column:
    """The final reason, then each run's reason and notes, every text once in order; ``runs`` holds structs of reason and notes."""
    each = F.flatten(F.transform(F.coalesce(runs, F.array().cast("array<struct<reason:string,notes:string>>")), lambda r: F.array(r["reason"], r["notes"])))
    return F.array_distinct(F.filter(F.concat(F.array(final), each), lambda x: x.isNotNull() & (x != "")))


TEXT_FIELDS = ("question", "gold_answer", "source_passage_id", "target_passage_id", "source_text", "target_text", "reference_text", "reference_type", "method", "pair_uid", "persona")
COUNT_FIELDS = ("source_vote_count", "target_vote_count", "both_vote_count")
LIST_FIELDS = ("retrievers_recovering_source", "retrievers_recovering_target", "retrievers_recovering_both")


def _either(first: DataFrame, second: DataFrame, key: str = "item") -> DataFrame:
    """A full join in which the second table's fields override the first's."""
    both = [c for c in second.columns if c in first.columns and c != key]
    renamed = second.select(key, *[F.col(c).alias(f"_{c}" if c in both else c) for c in second.columns if c != key])
    rows = first.join(renamed, key, "full")
    for c in both:
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return rows


def _winners(df: DataFrame, order: str, by_field: bool = False) -> DataFrame:
    """One row per item: the last by ``order``, or of each field the last value that is not null.

    Without that column, and among equal ones, the row of the greatest hash counts, which
    depends on the rows alone.
    """
    fields = [c for c in df.columns if c not in ("item", order)]
    place = F.struct(F.col(order) if order in df.columns else F.lit(0), F.xxhash64(*fields) if fields else F.lit(0))
    rows = df.where("item is not null")
    if by_field:
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c)
        return rows.groupBy("item").agg(*map(last, fields)) if fields else rows.select("item").distinct()
    return rows.groupBy("item").agg(F.max_by(F.struct("item", *fields), place).alias("row")).select("row.*")


def cohort_records(judge_passed: DataFrame, judge_all: DataFrame, answer_passed: DataFrame, answer_dropped: DataFrame, answer_all: DataFrame, ir_items: DataFrame, generated: DataFrame, constants: dict[str, object] | None = None, order: str = "seq") -> DataFrame:
    """The full record of every item that passed the judge.

    Generated fields come before those of retrieval, aggregated verdicts before
    those of the pass files.  ``cohort`` is answer_valid, answer_failed or
    dependency_valid; an item in both answer files counts as valid.  Missing
    columns of an input count as null.  Of an item's repeats the last row by the
    column ``order`` counts, of the two answer files the dropped one's, and of
    aggregated verdicts the last value of each field.
    """

    def of(df: DataFrame, prefix: str, fields) -> DataFrame:
        pick = [(F.col(c) if c in df.columns else F.lit(None)).alias(f"{prefix}_{c}") for c in fields]
        return df.select("item", *pick)

    ids = judge_passed.where("decision = 'PASS'").select("item").distinct()
    valid = answer_passed.where("decision = 'PASS'").select("item").distinct().withColumn("_valid", F.lit(True))
    failed = answer_dropped.where("decision = 'DROP'").select("item").distinct().withColumn("_failed", F.lit(True))
    judge_fields = ("judge_schema_version", "source_alone_sufficient", "target_alone_sufficient", "target_adds_essential_information", "citation_dependent", "answer_supported_by_judge")
    answer_fields = ("confidence_mean", "reason", "runs", "unsupported_claims", "answer_responsive", "answer_addresses_question", "answer_supported", "answer_grounded_in_passages")
    judge = of(_either(_winners(judge_passed.where("decision = 'PASS'"), order), _winners(judge_all, order, by_field=True)), "j", judge_fields)
    passed_rows, dropped_rows = _winners(answer_passed.where("decision = 'PASS'"), order), _winners(answer_dropped.where("decision = 'DROP'"), order)
    answered = passed_rows.join(dropped_rows.select("item"), "item", "left_anti").unionByName(dropped_rows, allowMissingColumns=True)
    answer = of(_either(answered, _winners(answer_all, order, by_field=True)), "a", answer_fields)
    leak_fields = ("citation_leakage", "citation_leakage_matches", "citation_leakage_types")
    gen = of(_winners(generated, order), "g", (*TEXT_FIELDS, *leak_fields))
    ir = of(_winners(ir_items, order), "i", (*TEXT_FIELDS, *leak_fields, *COUNT_FIELDS, *LIST_FIELDS, "ir_difficulty_label", *judge_fields))
    rows = ids.join(judge, "item", "left").join(answer, "item", "left").join(gen, "item", "left").join(ir, "item", "left").join(valid, "item", "left").join(failed, "item", "left")

    first = lambda c, default: F.coalesce(F.col(f"g_{c}"), F.col(f"i_{c}"), default)
    none = F.array().cast("array<string>")
    label = F.coalesce("i_ir_difficulty_label", F.lit("unknown"))
    out = {"item": F.col("item")}
    out |= {c: first(c, F.lit("")) for c in TEXT_FIELDS}
    out["citation_leakage"] = first("citation_leakage", F.lit(False))
    out |= {c: F.coalesce(F.col(f"g_{c}").cast("array<string>"), F.col(f"i_{c}").cast("array<string>"), none) for c in leak_fields[1:]}
    out["ir_difficulty_label"], out["difficulty_tier"] = label, retrieval.difficulty_tier(label)
    out |= {c: F.coalesce(F.col(f"i_{c}").cast("long"), F.lit(0).cast("long")) for c in COUNT_FIELDS}
    out |= {c: F.coalesce(F.col(f"i_{c}").cast("array<string>"), none) for c in LIST_FIELDS}
    passed = F.coalesce("_valid", F.lit(False))
    runs = F.col("a_runs").cast("array<struct<reason:string,notes:string>>")
    has_tag = lambda tag, uid: out["gold_answer"].contains(F.concat(F.lit(f"[#{tag}:"), uid, F.lit("]")))
    out |= {
        "answer_validation_passed": passed,
        "answer_validation_score": F.col("a_confidence_mean").cast("double"),
        "answer_validation_reasons": merged_reasons(F.col("a_reason").cast("string"), runs),
        "unsupported_claims": F.col("a_unsupported_claims").cast("string"),
        "missing_source_tag": ~has_tag("SRC", out["source_passage_id"]),
        "missing_target_tag": ~has_tag("TGT", out["target_passage_id"]),
        "answer_responsive": F.coalesce(F.col("a_answer_responsive").cast("boolean"), F.col("a_answer_addresses_question").cast("boolean")),
        "answer_supported": F.coalesce(F.col("a_answer_supported").cast("boolean"), F.col("a_answer_grounded_in_passages").cast("boolean")),
        "answer_validation_failed": F.coalesce("_failed", F.lit(False)),
    }
    out |= {c: F.coalesce(F.col(f"j_{c}").cast("string"), F.col(f"i_{c}").cast("string")) if c == "judge_schema_version" else F.coalesce(F.col(f"j_{c}").cast("boolean"), F.col(f"i_{c}").cast("boolean")) for c in judge_fields}
    out["cohort"] = F.when(passed, "answer_valid").when(F.coalesce("_failed", F.lit(False)), "answer_failed").otherwise("dependency_valid")
    return with_constants(rows.select(*[v.alias(k) for k, v in out.items()]), constants or {})


def export(records: DataFrame, basis: str = "answer_valid") -> dict[str, DataFrame]:
    """The cohorts as tables of their own: all three, the final one by ``basis``, and its challenging part."""
    if basis not in ("dependency_valid", "answer_valid"):
        raise ValueError(f"no such basis: {basis}")
    cohorts = {"dependency_valid": records, "answer_valid": records.where("answer_validation_passed"), "answer_failed": records.where("answer_validation_failed")}
    final = cohorts[basis]
    return cohorts | {"final": final, "hard": final.where("difficulty_tier = 'challenging'")}


def cohort_stats(records: DataFrame, basis: str = "answer_valid") -> DataFrame:
    """(kind, value, n): sizes of the cohorts, and of the final one's tiers and labels."""
    tables = export(records, basis)
    final = tables["final"]
    size = F.lit(1)
    sizes = records.agg(F.count(size).alias("dependency_valid"), F.count(F.when(F.col("answer_validation_passed"), 1)).alias("answer_valid"), F.count(F.when(F.col("answer_validation_failed"), 1)).alias("answer_failed"))
    stacked = sizes.select(F.explode(F.array(*[F.struct(F.lit("cohort").alias("kind"), F.lit(c).alias("value"), F.col(c).alias("n")) for c in sizes.columns])).alias("x")).select("x.*")
    part = lambda kind, c: final.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return stacked.unionByName(part("tier", "difficulty_tier")).unionByName(part("label", "ir_difficulty_label"))


def eval_summary(ir: DataFrame, answers: DataFrame) -> DataFrame:
    """Retrieval metrics of each method with its answers' metrics beside them."""
    return ir.join(answers, "method", "left")


def human_eval(sample: DataFrame, items: DataFrame, passages: DataFrame, references: DataFrame) -> DataFrame:
    """Rows for annotators: question, answer, both passages with documents, and the reference between them.

    ``passages`` (key, uid, doc, text) has a row for each id a passage goes by;
    ``references`` (source_id, target_id, source_uid, target_uid, ref_text,
    ref_type, seq) is met by ids first and by uids otherwise, the first row by
    ``seq`` winning either way.
    """
    rows = sample.select("item", "method", "split", "persona").join(items.select("item", "question", F.col("gold_answer").alias("expected_answer"), "source_passage_id", "target_passage_id"), "item", "left")
    once = passages.groupBy("key").agg(F.min(F.struct("uid", "doc", "text")).alias("p"))
    for side in ("source", "target"):
        found = once.select(F.col("key").alias(f"{side}_passage_id"), F.col("p.text").alias(f"{side}_text"), F.col("p.doc").alias(f"{side}_doc"), F.col("p.uid").alias(f"{side}_uid"))
        rows = rows.join(found, f"{side}_passage_id", "left")

    def index(a: str, b: str, to_a: str, to_b: str, name: str) -> DataFrame:
        known = references.where((F.coalesce(F.col(a), F.lit("")) != "") & (F.coalesce(F.col(b), F.lit("")) != ""))
        return known.groupBy(F.col(a).alias(to_a), F.col(b).alias(to_b)).agg(F.min(F.struct("seq", "ref_text", "ref_type")).alias(name))

    by_id = index("source_id", "target_id", "source_passage_id", "target_passage_id", "_by_id")
    by_uid = index("source_uid", "target_uid", "source_uid", "target_uid", "_by_uid")
    rows = rows.join(by_id, ["source_passage_id", "target_passage_id"], "left").join(by_uid, ["source_uid", "target_uid"], "left")
    pick = lambda c: F.coalesce(F.col(f"_by_id.{c}"), F.col(f"_by_uid.{c}"), F.lit("")).alias(c)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("item", "question", "expected_answer", empty("source_text"), empty("target_text"), empty("source_doc"), empty("target_doc"), "method", "split", "persona", pick("ref_text"), pick("ref_type"))


def rag_context(run: DataFrame, passages: DataFrame, gold: DataFrame, k: int = 10, separator: str = "\n\n") -> DataFrame:
    """(qid, context, n_passages, fallback): the texts of the first k retrieved passages in order; the gold pair's where none is known."""
    texts = passages.select("doc", "text")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"])
    found = run.where(F.col("rank") <= k).join(texts, "doc").groupBy("qid").agg(ordered(F.struct("rank", "text")).alias("found"))
    ends = gold.select("qid", F.posexplode(F.array("src", "tgt")).alias("place", "doc"))
    pair = ends.join(texts, "doc").groupBy("qid").agg(ordered(F.struct("place", "text")).alias("pair"))
    rows = gold.select("qid").distinct().join(found, "qid", "left").join(pair, "qid", "left")
    chosen = F.coalesce("found", "pair", F.array().cast("array<string>"))
    return rows.select("qid", F.array_join(chosen, separator).alias("context"), F.size(chosen).alias("n_passages"), F.col("found").isNull().alias("fallback"))


def nli_argmax(scores: Column, labels: tuple[str, ...] = ("contradiction", "neutral", "entailment")) -> tuple[Column, Column]:
    """The label of the highest of the scores, the first of equals, and that score as it is, however large."""
    top = F.array_max(scores)
    return F.when(F.size(scores) > 0, F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, top).cast("int"))), top


