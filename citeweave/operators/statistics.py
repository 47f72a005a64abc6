"""Corpus, graph, generation and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators.curation import sample_std

# Histogram edges, upper ends included.
WORD_EDGES = (25, 50, 100, 200, 400)


def measures(passages: DataFrame) -> DataFrame:
    text = F.col("text")
    return passages.select("doc", "source", F.size(T.words(text)).alias("words"), F.length(F.coalesce(text, F.lit(""))).alias("chars"), T.sentence_count(text).alias("sentences"))


def corpus_stats(passages: DataFrame) -> DataFrame:
    """One row per measure: count, mean, median, least, most and sample deviation."""
    kinds = ("words", "chars", "sentences")
    rows = measures(passages).select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k).cast("double"))])).alias("measure", "value"))
    return rows.groupBy("measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), sample_std("value").alias("std"))


def histogram(values: DataFrame, column: str, edges=WORD_EDGES) -> DataFrame:
    """(upper_edge, n) of each bucket that holds a value; the open bucket has a null edge."""
    edge = F.lit(None).cast("int")
    for e in sorted(edges, reverse=True):
        edge = F.when(F.col(column) <= e, e).otherwise(edge)
    return values.groupBy(edge.alias("upper_edge")).agg(F.count("*").alias("n"))


def vocabulary(passages: DataFrame) -> DataFrame:
    """Tokens, distinct tokens and their ratio; counted by token first, so the distinct count is a sum."""
    tokens = passages.select(F.explode(T.ascii_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("vocabulary"), (F.count("*") / F.sum("n")).alias("type_token_ratio"))


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree statistics."""
    sides = [edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("degree")).withColumn("side", F.lit(name)) for c, name in (("src", "out"), ("dst", "in"))]
    return sides[0].unionByName(sides[1]).groupBy("side").agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean"), F.percentile("degree", 0.5).alias("median"), F.min("degree").alias("least"), F.max("degree").alias("most"))


def coverage(edges: DataFrame, passages: DataFrame) -> DataFrame:
    """Edges, distinct ends, within and across documents, and the share of passages touched."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    nodes = ends.groupBy("node").agg(F.max("s").alias("s"), F.max("t").alias("t")).agg(F.sum("s").alias("sources"), F.sum("t").alias("targets"), F.count("*").alias("touched"))
    counts = edges.agg(F.count("*").alias("edges"), F.count(F.when(F.col("src_doc") == F.col("dst_doc"), 1)).alias("within_doc"), F.count(F.when(F.col("src_doc") != F.col("dst_doc"), 1)).alias("cross_doc"))
    row = nodes.agg(F.struct(*[F.first(c).alias(c) for c in ("sources", "targets", "touched")])).scalar()
    out = counts.withColumn("_n", row).select("*", "_n.*").drop("_n").withColumn("passages", passages.agg(F.count("*")).scalar())
    return out.withColumn("coverage_pct", 100.0 * F.col("touched") / F.col("passages"))


def question_types(questions: DataFrame) -> DataFrame:
    return questions.groupBy(T.question_type(F.col("question")).alias("question_type")).agg(F.count("*").alias("n"))


def duplicate_questions(questions: DataFrame) -> DataFrame:
    each = questions.groupBy(T.question_key(F.col("question")).alias("key")).agg(F.count("*").alias("n"))
    twice = F.col("n") > 1
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.when(~twice, 1)).alias("singletons"),
        F.count(F.when(twice, 1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_rate", F.when(F.col("total") > 0, F.col("duplicate_rows") / F.col("total")).otherwise(0.0))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit order; aggregated before the shuffle."""
    others = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(order, *others)).alias("best"))
    return best.select(*keys, F.col(f"best.{order}").alias(order), *[F.col(f"best.{c}").alias(c) for c in others])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by an explicit order."""
    others = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *others), order).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}").alias(c) for c in (order, *others)])


def first_wins_of_named(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First rows of keys of which no part is empty; rows with an empty part all stay."""
    named = F.lit(True)
    for k in keys:
        named &= ~T.absent(F.col(k).cast("string"))
    return first_wins(rows.where(named), keys, order).select(*rows.columns).unionByName(rows.where(~named))


def label_distribution(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Per group and label: how many, their share of the group, and the mean score of those that have one."""
    each = rows.where(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return each.join(totals, keys).withColumn("share", F.col("n") / F.col("total")).drop("total")


def generation_rates(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and in all: items, and the shares with both tags, with citation-like sides and with leaking questions.

    ``items``: question, answer, source_uid, target_uid and the keys.
    """
    tag = lambda t, uid: F.coalesce(F.col("answer").contains(F.concat(F.lit(f"[#{t}:"), F.col(uid), F.lit("]"))), F.lit(False))
    bare = F.regexp_replace("answer", r"\[#[^\]]*\]", "")
    rows = items.select(*keys, (tag("SRC", "source_uid") & tag("TGT", "target_uid")).alias("both"), T.is_citation_like(F.col("question")).alias("q"), T.is_citation_like(bare).alias("a"), (F.size(T.leakages(F.col("question"))) > 0).alias("leak"))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    return rows.rollup(*keys).agg(F.count("*").alias("n"), share("both").alias("both_tags"), share("q").alias("question_cites"), share("a").alias("answer_cites"), share("leak").alias("leaks"))


def group_counts(records: DataFrame, fields: list[str], cohort: str = "cohort") -> DataFrame:
    """Counts overall, by cohort and by each field within each cohort, in one pass over grouping sets."""
    stacked = records.select(cohort, F.explode(F.array(F.struct(F.lit("cohort").alias("field"), F.lit("all").alias("value")), *[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in fields])).alias("x")).select(cohort, "x.*")
    return stacked.groupBy(cohort, "field", "value").agg(F.count("*").alias("n"))


def length_stats(records: DataFrame, column: str, levels: list[list[str]]) -> DataFrame:
    """Median and quartiles of a text's words at several grouping levels; absent keys read ``all``."""
    keys = sorted({k for level in levels for k in level})
    rows = records.withColumn("_words", F.size(T.words(F.col(column)))).where(~T.absent(F.col(column)))
    parts = []
    for level in levels:
        names = [F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) if k in level else F.lit("all").alias(k) for k in keys]
        parts.append(rows.select(*names, "_words", F.lit("+".join(level) or "overall").alias("level")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("level", *keys).agg(F.count("*").alias("n"), F.percentile("_words", 0.25).alias("q1"), F.percentile("_words", 0.5).alias("median"), F.percentile("_words", 0.75).alias("q3"))


def attrition(stages: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that reach each stage by the keys and rolled up; ``stages`` has a boolean column per stage."""
    return stages.rollup(*keys).agg(F.count("*").alias("generated"), *[F.count(F.when(F.col(s), 1)).alias(s) for s in order])


def answer_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means over all answers; an answer without a metric counts 0."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics])


def top_values(rows: DataFrame, column: str, n: int = 20) -> DataFrame:
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


# The fields by which benchmark records are grouped, and the counts of their construction.
GROUP_FIELDS = ("corpus", "method", "persona", "split", "ir_difficulty_label", "reference_type", "citation_leakage", "answer_validation_passed", "judge_schema_version")
FLAG_FIELDS = ("citation_leakage", "answer_validation_passed")


def benchmark_groups(records: DataFrame, fields=GROUP_FIELDS) -> DataFrame:
    """(stat, field, value, cohort, n): records overall, by cohort, and by each field within a cohort; absent values read ``missing``."""
    cohort = F.coalesce(F.nullif(F.col("cohort"), F.lit("")), F.lit("input"))

    def value(f):
        if f in FLAG_FIELDS:
            flag = T.tri_state(F.col(f))
            return F.when(flag, "true").when(~flag, "false").otherwise("missing")
        return F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("missing"))

    row = lambda stat, field, v, c: F.struct(F.lit(stat).alias("stat"), F.lit(field).alias("field"), v.alias("value"), c.alias("cohort"))
    each = [row("cohort_count", "overall", F.lit("all"), F.lit("all")), row("cohort_count", "cohort", cohort, cohort), *[row("group_count", f, value(f), cohort) for f in fields if f in records.columns]]
    return records.select(F.explode(F.array(*each)).alias("x")).select("x.*").groupBy("stat", "field", "value", "cohort").agg(F.count("*").alias("n"))


def construction_counts(records: DataFrame) -> DataFrame:
    """One row: how many records each step left; carried counts are the largest seen."""
    of = lambda c: F.count(F.when(F.col("cohort") == c, 1))
    carried = lambda c: F.max(F.col(c).try_cast("long")) if c in records.columns else F.lit(None).cast("long")
    valid, failed, dependency = of("answer_valid"), of("answer_failed"), of("dependency_valid")
    return records.agg(
        carried("generated_count").alias("generated_count"),
        carried("structurally_valid_count").alias("structurally_valid_count"),
        F.count(F.when(T.tri_state(F.col("citation_leakage")), 1)).alias("citation_leakage_count"),
        F.when(dependency > 0, dependency).otherwise(valid + failed).alias("citation_dependency_passed_count"),
        valid.alias("answer_validation_passed_count"),
        failed.alias("answer_validation_failed_count"),
        dependency.alias("final_dependency_valid_count"),
        valid.alias("final_answer_valid_count"),
        failed.alias("final_answer_failed_count"),
    )


def difficulty_rows(records: DataFrame) -> DataFrame:
    """Per cohort and label: count, share of the cohort, median lengths and overlap, and the rate of known passes."""
    cohort = F.coalesce(F.nullif(F.col("cohort"), F.lit("")), F.lit("input")).alias("cohort")
    label = F.coalesce(F.nullif(F.col("ir_difficulty_label"), F.lit("")), F.lit("missing")).alias("ir_difficulty_label")
    words = lambda c: F.nullif(F.size(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), F.lit(0))
    measured = F.coalesce(F.col("source_target_overlap").try_cast("double"), T.word_overlap(F.col("source_text"), F.col("target_text"))) if "source_target_overlap" in records.columns else T.word_overlap(F.col("source_text"), F.col("target_text"))
    rows = records.select(cohort, label, words("question").alias("q"), words("gold_answer").alias("a"), measured.alias("overlap"), T.tri_state(F.col("answer_validation_passed")).cast("double").alias("passed"))
    each = rows.groupBy("cohort", "ir_difficulty_label").agg(F.count("*").alias("n"), F.percentile("q", 0.5).alias("question_median"), F.percentile("a", 0.5).alias("answer_median"), F.percentile("overlap", 0.5).alias("overlap_median"), F.avg("passed").alias("pass_rate"))
    totals = each.groupBy("cohort").agg(F.sum("n").alias("total"))
    return each.join(totals, "cohort").withColumn("share", F.col("n") / F.col("total")).drop("total")


def qa_word_stats(items: DataFrame) -> DataFrame:
    """Per method and over all: items, and mean, least and most words of questions and answers."""
    rows = items.select(F.coalesce("method", F.lit("unknown")).alias("method"), F.size(T.words(F.col("question"))).alias("q"), F.size(T.words(F.col("answer"))).alias("a"))
    numbers = [f(c).alias(f"{n}_{name}") for c, n in (("q", "question"), ("a", "answer")) for f, name in ((lambda x: F.round(F.avg(x), 1), "mean"), (F.min, "least"), (F.max, "most"))]
    return rows.rollup("method").agg(F.count("*").alias("n"), *numbers).withColumn("method", F.coalesce("method", F.lit("combined")))


def percent(part, whole):
    """A share in percent; 0 of nothing."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def corpus_table(passages: DataFrame, pairs: DataFrame) -> DataFrame:
    """The corpus and its resolved pairs in one row; pairs have ref_type, both texts' words and title_like."""
    of = lambda kind: F.count(F.when(F.lower("ref_type") == kind, 1))
    total = F.count("*")
    docs = passages.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("passages"))
    rows = pairs.agg(total.alias("pairs"), of("internal").alias("internal"), of("external").alias("external"), percent(of("internal"), total).alias("internal_pct"), percent(of("external"), total).alias("external_pct"), F.count(F.when(F.col("title_like"), 1)).alias("title_targets"), F.round(F.avg("source_words"), 2).alias("source_words"), F.round(F.avg("target_words"), 2).alias("target_words"))
    return docs.select(F.lit(1).alias("one"), "*").join(rows.select(F.lit(1).alias("one"), "*"), "one").drop("one").withColumn("title_pct", percent(F.col("title_targets"), F.col("pairs")))


def yield_table(outcomes: DataFrame) -> DataFrame:
    """Per method: rows seen, kept and dropped by reason, with the share kept; ``reason`` is null for kept rows."""
    kept = F.count(F.when(F.col("reason").isNull(), 1))
    head = outcomes.groupBy("method").agg(F.count("*").alias("seen"), kept.alias("kept"), F.round(percent(kept, F.count("*")), 2).alias("kept_pct"))
    per = outcomes.where("reason is not null").groupBy("method", "reason").agg(F.count("*").alias("n"))
    lists = per.groupBy("method").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "reason", "n"))), lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), "; ").alias("dropped"))
    return head.join(lists, "method", "left").withColumn("dropped", F.coalesce("dropped", F.lit("")))


def quality_table(items: DataFrame) -> DataFrame:
    """Per method: items, and the shares with both tags, with citation-like questions and with citation-like answers."""
    share = lambda c: F.round(percent(F.count(F.when(F.col(c), 1)), F.count("*")), 2)
    return items.groupBy("method").agg(F.count("*").alias("items"), share("both_tags").alias("both_tags_pct"), share("question_cites").alias("question_cites_pct"), share("answer_cites").alias("answer_cites_pct"))


def pilot_rates(items: DataFrame) -> DataFrame:
    """Items by method and in all, with rates of leakage, judge passes and answer passes; no rate of nothing."""
    flag = lambda c: F.count(F.when(F.col(c), 1))
    known = lambda c: F.count(F.col(c))
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4))
    out = items.rollup("method").agg(F.count("*").alias("n"), flag("leaks").alias("n_leaks"), rate(flag("leaks"), F.count("*")).alias("leak_rate"), flag("judged").alias("judge_passed"), rate(flag("judged"), known("judged")).alias("judge_rate"), flag("answered").alias("answer_passed"), rate(flag("answered"), known("answered")).alias("answer_rate"))
    return out.withColumn("method", F.coalesce("method", F.lit("all")))


def reason_counts(rows: DataFrame, column: str = "reason") -> DataFrame:
    """How often each reason occurs, most frequent first, then by name."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def target_report(refs: DataFrame) -> DataFrame:
    """One row on references' targets: rows, distinct ids, distinct passage suffixes and how many point at the first passage."""
    suffix = F.nullif(F.regexp_extract("target_id", T.PASSAGE_SUFFIX, 1), F.lit(""))
    return refs.agg(F.count("*").alias("rows"), F.countDistinct(F.nullif(F.trim("target_id"), F.lit(""))).alias("targets"), F.countDistinct(suffix).alias("suffixes"), F.count(F.when(suffix == "000001", 1)).alias("to_first"))


def report(tables: dict[str, DataFrame]) -> str:
    """Small tables as one JSON document of lists of records."""
    import json

    return json.dumps({name: [r.asDict(recursive=True) for r in rows.collect()] for name, rows in tables.items()}, indent=2, default=str, ensure_ascii=False)


def _small(rows: DataFrame, most: int) -> list:
    """A result's rows, if it has no more than ``most``: a report is whole or fails."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write the table instead")
    return found


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as Markdown; more than ``most`` rows are an error."""
    found = _small(rows, most)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)])


def latex_table(rows: DataFrame, most: int = 1000) -> str:
    """A small result as LaTeX; more than ``most`` rows are an error."""
    found = _small(rows, most)
    escape = lambda v: "" if v is None else str(v).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&").replace("#", r"\#")
    body = [" & ".join(map(escape, r)) + r" \\" for r in found]
    head = " & ".join(map(escape, rows.columns)) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(rows.columns) + "}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])
