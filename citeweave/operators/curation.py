"""Verdicts over several passes, cohort assembly, answers, annotators and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.tables import written

# Consensus limits, pass mark and reason codes.
LEAST_MAJORITY, LEAST_WEIGHTED, LEAST_CONFIDENCE = 0.67, 0.70, 0.75
PASS_MARK = 7
CHECKS = ("source_relevant", "target_relevant", "source_alone_sufficient", "target_alone_sufficient", "target_adds_essential_information", "answer_supported", "citation_dependent")
REASONS = ("QP_NOT_CIT_DEP", "QP_WRONG_TARGET", "QP_SCOPE_MISMATCH", "QP_UNDER_SPEC", "QP_TOO_BROAD", "QP_ILL_FORMED")
JUDGE_SCHEMA = f"struct<judge_schema_version:string,passed:boolean,final_score:double,confidence:double,reason_code_qp:string,decision_qp:string,source_alone_insufficient:boolean,binary_checks:struct<{','.join(f'{c}:string' for c in CHECKS)}>>"


def score_10(c: Column) -> Column:
    """Rounded half to even and clamped to 0 .. 10."""
    rounded = F.bround(c.cast("double")).cast("int")
    return F.when(rounded.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(10), rounded)))


def parse_judgement(raw: Column, pass_mark: int = PASS_MARK) -> Column:
    """One judge reply, fenced or not, of the current form or the older one, as a struct; null if unreadable."""
    reply = F.from_json(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), JUDGE_SCHEMA)
    check = {c: T.strict_bool(reply["binary_checks"][c]) for c in CHECKS}
    is_true = lambda c: F.coalesce(check[c], F.lit(False))
    is_false = lambda c: F.coalesce(~check[c], F.lit(False))
    score = score_10(reply["final_score"])
    any_check = F.coalesce(*[check[c] for c in CHECKS]).isNotNull()
    current = reply["passed"].isNotNull() | any_check | score.isNotNull()
    good = is_true("source_relevant") & is_true("target_relevant") & ~is_true("source_alone_sufficient") & is_true("target_adds_essential_information") & is_true("answer_supported") & is_true("citation_dependent") & (F.coalesce(score, F.lit(0)) >= pass_mark)
    reason = (
        F.when(reply["reason_code_qp"].isin(*REASONS), reply["reason_code_qp"])
        .when(is_true("source_alone_sufficient"), "QP_NOT_CIT_DEP")
        .when(is_false("target_relevant") | is_false("target_adds_essential_information"), "QP_WRONG_TARGET")
        .when(is_false("source_relevant"), "QP_SCOPE_MISMATCH")
        .when(is_false("answer_supported"), "QP_ILL_FORMED")
        .when(is_false("citation_dependent"), "QP_NOT_CIT_DEP")
        .otherwise("QP_ILL_FORMED")
    )
    old = reply["decision_qp"].isNotNull() & reply["confidence"].isNotNull()
    return F.when(
        current | old,
        F.struct(
            F.when(current, F.when(good, "PASS_QP").otherwise("DROP_QP")).otherwise(reply["decision_qp"]).alias("decision"),
            F.when(current, F.when(~good, reason)).otherwise(reply["reason_code_qp"]).alias("reason"),
            F.when(current, F.coalesce(reply["confidence"], F.coalesce(score, F.lit(0)) / 10.0)).otherwise(reply["confidence"]).alias("confidence"),
            score.alias("score"),
            F.when(current, is_true("source_alone_sufficient")).otherwise(~reply["source_alone_insufficient"]).alias("source_alone_sufficient"),
            check["target_adds_essential_information"].alias("target_adds"),
            check["answer_supported"].alias("answer_supported"),
            check["citation_dependent"].alias("citation_dependent"),
            F.coalesce(reply["judge_schema_version"], F.when(current, "v2").otherwise("v1")).alias("version"),
        ),
    )


def consensus(passes: DataFrame, item: str = "item", order: str = "pass_no", answers: bool = False) -> DataFrame:
    """One verdict per item from passes (decision PASS or DROP, confidence, reason).

    Confidence decides; a tie drops without a reason.  The most frequent reason
    counts, ties by first occurrence; only dropping passes give reasons to a
    judgement, all passes to an answer's.
    """
    says = F.col("decision") == "PASS"
    counted = passes.where(F.col("reason").isNotNull() & (F.lit(answers) | ~says))
    per_reason = counted.groupBy(item, "reason").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    top = per_reason.groupBy(item).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "reason")).alias("top")).select(item, F.col("top.reason").alias("top_reason"))
    sums = passes.groupBy(item).agg(
        F.count("*").alias("n_passes"),
        F.count(F.when(says, 1)).alias("votes_pass"),
        F.count(F.when(~says, 1)).alias("votes_drop"),
        F.sum(F.when(says, F.col("confidence")).otherwise(0.0)).alias("for_pass"),
        F.sum(F.when(~says, F.col("confidence")).otherwise(0.0)).alias("for_drop"),
        F.avg("confidence").alias("confidence_mean"),
    )
    rows = sums.join(top, item, "left")
    total = F.col("for_pass") + F.col("for_drop")
    weighted = F.when(total > 0, F.greatest("for_pass", "for_drop") / total).otherwise(0.0)
    majority = F.greatest("votes_pass", "votes_drop") / F.col("n_passes")
    return rows.select(
        item,
        F.when(F.col("for_pass") > F.col("for_drop"), "PASS").otherwise("DROP").alias("decision"),
        F.when(F.col("for_drop") > F.col("for_pass"), F.col("top_reason")).alias("reason"),
        "n_passes",
        "votes_pass",
        "votes_drop",
        "confidence_mean",
        weighted.alias("weighted_fraction"),
        ((majority < LEAST_MAJORITY) | (weighted < LEAST_WEIGHTED) | (F.col("confidence_mean") < LEAST_CONFIDENCE)).alias("low_consensus"),
    )


def majority(c: Column, strict: bool = True) -> Column:
    """Aggregate: what most known values say; null if none is known."""
    yes, known = F.count(F.when(c, 1)), F.count(c)
    return F.when(known == 0, F.lit(None).cast("boolean")).otherwise(yes * 2 > known if strict else yes * 2 >= known)


def guarded(decision: Column, reason: Column, sufficient: Column, adds: Column, supported: Column, dependent: Column) -> tuple[Column, Column]:
    """A passing verdict is dropped where a majority of checks speaks against it."""
    no = lambda c: F.coalesce(~c, F.lit(False))
    yes = F.coalesce(sufficient, F.lit(False))
    bad = (decision == "PASS") & (yes | no(adds) | no(dependent) | no(supported))
    why = F.when(yes, "QP_NOT_CIT_DEP").when(no(adds), "QP_WRONG_TARGET").when(no(supported), "QP_ILL_FORMED").otherwise("QP_NOT_CIT_DEP")
    return F.when(bad, "DROP").otherwise(decision), F.when(bad, why).otherwise(reason)


def cohorts(judged: DataFrame, answered: DataFrame, items: DataFrame) -> DataFrame:
    """Items that passed the judge, with their cohort: answer_valid, answer_dropped or dependency_valid alone.

    All three inputs are keyed by ``item``; ``judged`` and ``answered`` hold decision PASS or DROP.
    """
    ok = judged.where("decision = 'PASS'").select("item").distinct()
    of_answer = answered.groupBy("item").agg(F.max(F.col("decision") == "PASS").alias("valid"))
    rows = ok.join(of_answer, "item", "left").join(items, "item", "left")
    return rows.withColumn("cohort", F.when(F.col("valid"), "answer_valid").when(~F.col("valid"), "answer_dropped").otherwise("dependency_valid")).drop("valid")


def join_outcomes(answers: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Answers with their retrieval outcome by (item, run), else by item where that has one outcome only; others drop out."""
    diagnostics = diagnostics.withColumn("outcome", normal_outcome(F.col("outcome")))
    exact = diagnostics.select("item", "run", F.col("outcome").alias("exact"))
    single = diagnostics.groupBy("item").agg(F.count("*").alias("n"), F.first("outcome").alias("single")).where("n = 1").select("item", "single")
    rows = answers.join(exact, ["item", "run"], "left").join(single, "item", "left")
    return rows.withColumn("outcome", F.coalesce("exact", "single")).where(F.col("outcome").isNotNull()).drop("exact", "single")


def normal_outcome(c: Column) -> Column:
    """The outcome's usual name; other words stay as they are, nothing is ``unknown``."""
    word = F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_"))
    return F.when(word == "src_only", "source_only").when(word == "tgt_only", "target_only").otherwise(F.coalesce(F.nullif(word, F.lit("")), F.lit("unknown")))


def sample_std(c: str) -> Column:
    """Sample deviation; 0 of one value, null of none."""
    return F.coalesce(F.stddev_samp(c), F.when(F.count(c) == 1, 0.0))


def quality_by_outcome(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per group, outcome and metric: count, mean, deviation, median, and the mean of ``both`` minus that of the others."""
    stacked = rows.select(*keys, "outcome", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, "outcome", "x.*")
    each = stacked.groupBy(*keys, "outcome", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), sample_std("value").alias("std"), F.percentile("value", 0.5).alias("median"))
    both = F.avg(F.when(F.col("outcome") == "both", F.col("value")))
    rest = F.avg(F.when(F.col("outcome") != "both", F.col("value")))
    contrast = stacked.groupBy(*keys, "metric").agg((both - rest).alias("contrast"))
    return each.join(contrast, [*keys, "metric"])


def label_majority(labels: DataFrame) -> DataFrame:
    """Per (item, criterion): yes, no and n labels, the majority (null on a tie) and the largest share."""
    rows = labels.where(F.col("label").isNotNull()).groupBy("item", "criterion").agg(F.count(F.when(F.col("label"), 1)).alias("yes"), F.count("*").alias("n"))
    no = F.col("n") - F.col("yes")
    return rows.select("item", "criterion", "yes", no.alias("no"), "n", F.when(F.col("yes") > no, True).when(F.col("yes") < no, False).alias("majority"), (F.greatest(F.col("yes"), no) / F.col("n")).alias("share"))


def percent_agreement(labels: DataFrame) -> DataFrame:
    """Per criterion, the mean largest share over items with two labels or more."""
    return label_majority(labels).where("n >= 2").groupBy("criterion").agg(F.count("*").alias("items"), F.avg("share").alias("agreement"))


def cohen_kappa(labels: DataFrame) -> DataFrame:
    """Per criterion, over items that exactly two annotators labelled."""
    known = labels.where(F.col("label").isNotNull() & F.col("annotator").isNotNull())
    pairs = known.groupBy("item", "criterion").agg(F.count("*").alias("n"), F.countDistinct("annotator").alias("who"), F.min(F.struct("annotator", "label")).alias("a"), F.max(F.struct("annotator", "label")).alias("b")).where("n = 2 and who = 2")
    a, b = F.col("a.label").cast("int"), F.col("b.label").cast("int")
    rows = pairs.groupBy("criterion").agg(F.count("*").alias("items"), F.avg((a == b).cast("double")).alias("observed"), F.avg(a).alias("pa"), F.avg(b).alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(expected >= 1.0, F.when(F.col("observed") >= 1.0, 1.0).otherwise(0.0)).otherwise((F.col("observed") - expected) / (1.0 - expected))
    return rows.select("criterion", "items", "observed", kappa.alias("kappa"))


def split(items: DataFrame, key: str, group: list[str], seed: int = 42, train: float = 0.70, dev: float = 0.15, existing: str | None = None) -> DataFrame:
    """train, dev and test by a pseudo-random order in each group, or the existing split where every row has one."""
    if existing is not None and items.where(T.absent(F.col(existing))).isEmpty():
        return items.where(F.col(existing).isin("train", "dev", "test")).withColumn("split", F.col(existing))
    placed = numbered(items, group, [T.draw(seed, F.col(key)).alias("_draw"), F.col(key)])
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * dev)
    return placed.withColumn("split", F.when(F.col("_at") <= a, "train").when(F.col("_at") <= a + b, "dev").otherwise("test")).drop("_at", "_n")


def numbered(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``_at``, their place in their group by the order, and ``_n``, the group's size.

    Rows are dealt by ranges of the order, not by group: places within a range
    are added to the sizes of the group's earlier ranges, so a group with most
    of the rows is sorted by many tasks.
    """
    tagged = rows.select("*", *[c.alias(f"_o{k}") for k, c in enumerate(order)])
    names = [f"_o{k}" for k in range(len(order))]
    dealt, _ = written(tagged.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "ranges")
    same = " AND ".join([f"l.{g} <=> r.{g}" for g in group])
    sizes = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_m"))
    w = W.partitionBy(*group).orderBy("_part")
    before = sizes.withColumn("_before", F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_m")).withColumn("_n", F.sum("_m").over(W.partitionBy(*group))).drop("_m")
    inside = dealt.withColumn("_at", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*names)))
    joined = inside.alias("l").join(before.alias("r"), F.expr(f"l._part = r._part AND {same}"))
    return joined.select("l.*", F.col("r._before"), F.col("r._n")).withColumn("_at", F.col("_at") + F.col("_before")).drop("_before", "_part", *names)


def qa_errors(question: Column, answer: Column, pair: Column, source: Column, target: Column, least: int = 50, most: int = 1000, tags: bool = True, no_citations: bool = False, reference: Column | None = None) -> Column:
    """Error codes of a generated question and answer, in order."""
    count = F.size(T.words(answer))
    has_tag = lambda uid: F.coalesce(answer.contains(F.concat(F.lit("[#SRC:"), uid, F.lit("]"))) | answer.contains(F.concat(F.lit("[#TGT:"), uid, F.lit("]"))) | answer.contains(uid), F.lit(False))
    codes = [
        F.when(T.absent(question), "empty_question"),
        F.when(T.absent(answer), "empty_expected_answer"),
        F.when(T.absent(pair), "missing_pair_uid"),
        F.when(T.absent(source) | T.absent(target), "missing_passage_uids"),
        F.when((~has_tag(source) | ~has_tag(target)) & F.lit(tags), "missing_required_tags"),
        F.when((count > 0) & (count < least), F.concat(F.lit("answer_too_short:"), count.cast("string"))),
        F.when(count > most, F.concat(F.lit("answer_too_long:"), count.cast("string"))),
    ]
    if no_citations:
        codes += [
            F.when(T.is_citation_like(question), "citation_in_question"),
            F.when(T.is_citation_like(answer), "citation_in_answer"),
            F.when(F.size(T.leakages(question, reference)) > 0, "question_contains_citation_leakage"),
        ]
    return F.array_compact(F.array(*codes))


def schema_errors(pair: Column, source_uid: Column, target_uid: Column, source: Column, target: Column, hook: Column, citation: Column, is_title: Column, spans: Column, most: int = 3, need_spans: bool = False) -> Column:
    """Error codes of a schema item, in order; spans are structs of start, end and text over the target."""
    n = F.coalesce(F.size(spans), F.lit(0))
    title = F.coalesce(is_title, F.lit(False))
    checked = F.transform(F.slice(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,text:string>>")), 1, most), lambda s, i: F.when(~span_valid(s, target), F.concat(F.lit("invalid_span:"), i.cast("string"))))
    codes = F.array(
        F.when(T.absent(pair), "missing_pair_uid"),
        F.when(T.absent(source_uid) | T.absent(target_uid), "missing_passage_uids"),
        F.when(T.absent(source) | T.absent(target), "empty_source_or_target_text"),
        F.when(T.absent(hook), "missing_semantic_hook"),
        F.when(T.absent(citation), "missing_citation_hook"),
        F.when(n > most, F.concat(F.lit("too_many_spans:"), n.cast("string"))),
        F.when(title & (n > 0), "title_target_should_not_have_spans"),
        F.when(~title & (n == 0) & F.lit(need_spans), "missing_spans_for_non_title_target"),
    )
    return F.array_compact(F.concat(codes, checked))


def span_valid(span: Column, text: Column) -> Column:
    """Zero-based bounds inside the text, and the very text between them."""
    inside = (span["start"] >= 0) & (span["end"] > span["start"]) & (span["end"] <= F.length(text))
    return F.coalesce(inside & (F.substr(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")) == span["text"]), F.lit(False))


SPAN = "struct<start:int,end:int,text:string,type:string>"
# The kinds of answer spans.
SPAN_TYPES = ("DURATION", "DATE", "MONEY", "PERCENT", "TERM", "SECTION", "FREEFORM")


def coerced_spans(spans: Column, text: Column, is_title: Column, most: int = 3) -> Column:
    """A target's answer spans: of the first ``most`` given the valid ones, unknown kinds as FREEFORM, long whole texts left out.

    None for a title; where none is valid, the core clause, else the beginning.
    """
    long = F.length(text) > T.FREEFORM_CHARS
    kind = lambda s: F.when(s["type"].isin(*SPAN_TYPES), s["type"]).otherwise("FREEFORM")
    made = lambda a, b, t, k: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), t.alias("text"), k.alias("type"))
    whole = lambda s: (s["type"] == "FREEFORM") & (s["end"] - s["start"] == F.length(text)) & long
    given = F.transform(F.slice(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), 1, most), lambda s: made(s["start"], s["end"], s["text"], kind(s)))
    valid = F.filter(given, lambda s: span_valid(s, text) & ~whole(s))
    core = T.core_clause(text)
    cut = F.when(core["end"] - core["start"] > T.FREEFORM_CHARS, F.rtrim(F.substr(text, core["start"] + 1, F.lit(T.FREEFORM_CHARS)))).otherwise(core["text"])
    end = F.least(core["end"], core["start"] + T.FREEFORM_CHARS)
    head = F.rtrim(F.substring(text, 1, T.FREEFORM_CHARS))
    fallback = F.when(core.isNotNull(), made(core["start"], end, cut, F.lit("FREEFORM"))).otherwise(made(F.lit(0), F.length(head), head, F.lit("FREEFORM")))
    return F.when(F.coalesce(is_title, F.lit(False)), F.array().cast(f"array<{SPAN}>")).when(F.size(valid) > 0, valid).otherwise(F.array(fallback))


def tags_in(answer: Column, top: Column) -> Column:
    """How many id tags of an answer, repeats included, name one of the retrieved passages."""
    ids = F.transform(F.regexp_extract_all(answer, F.lit(r"\[#(?:SRC|TGT|ID):([^\]]+)\]"), F.lit(1)), lambda x: F.trim(x))
    return F.size(F.filter(ids, lambda x: F.array_contains(top, x)))


def leakage_route(action: str, leaks: Column) -> Column:
    """Where a question goes: the main output, beside it, or out."""
    if action not in ("keep", "filter", "separate"):
        raise ValueError(f"no such action: {action}")
    return F.when(leaks & F.lit(action == "filter"), "dropped").when(leaks & F.lit(action == "separate"), "separate").otherwise("kept")


def cap_kept(rows: DataFrame, keys: list[str], order: str, cap: int, reason: str = "reason") -> DataFrame:
    """The first ``cap`` rows without a drop reason in each group."""
    return rows.where(F.col(reason).isNull()).withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= cap).drop("_n")
