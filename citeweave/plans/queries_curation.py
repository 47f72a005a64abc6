"""Registered queries of verdicts, cohorts, annotators, answers, statistics and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import curation, html, links, statistics, xrefs
from citeweave.plans import bindings as B
from citeweave.plans.queries import NORMAL, WORDS, _list, query

# ---------------------------------------------------------------- verdicts

_CONSENSUS = f"""{B.VERDICTS}, reasons AS (SELECT item, reason, count(*) AS n, min(pass_no) AS first FROM verdicts WHERE reason IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT item, reason FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, first) AS k FROM reasons) WHERE k = 1),
    sums AS (SELECT item, count(*) AS n_passes, count(*) FILTER (decision = 'PASS') AS votes_pass, count(*) FILTER (decision = 'DROP') AS votes_drop,
        coalesce(sum(confidence) FILTER (decision = 'PASS'), 0) AS p, coalesce(sum(confidence) FILTER (decision = 'DROP'), 0) AS d, avg(confidence) AS mean FROM verdicts GROUP BY 1),
    consensus AS (SELECT sums.item, CASE WHEN p > d THEN 'PASS' ELSE 'DROP' END AS decision, CASE WHEN d > p THEN reason END AS reason, n_passes, votes_pass, votes_drop, mean,
        CASE WHEN p + d > 0 THEN greatest(p, d) / (p + d) ELSE 0 END AS weighted, greatest(votes_pass, votes_drop) / n_passes AS majority FROM sums LEFT JOIN top USING (item))"""
_CONSENSUS_OUT = f"""WITH {_CONSENSUS} SELECT item, decision, reason, n_passes, votes_pass, votes_drop, round(mean, 6) AS confidence_mean, round(weighted, 6) AS weighted_fraction,
    majority < 0.67 OR weighted < 0.70 OR mean < 0.75 AS low_consensus FROM consensus"""


@query(_CONSENSUS_OUT)
def judge_consensus(spark, sf):
    return curation.consensus(B.verdicts(spark, sf))


@query(_CONSENSUS_OUT)
def answer_consensus(spark, sf):
    return curation.consensus(B.verdicts(spark, sf), answers=True)


@query(f"""WITH {_CONSENSUS} SELECT decision, coalesce(reason, 'none') AS reason, count(*) AS n, round(avg(mean), 6) AS mean_confidence,
    count(*) FILTER (majority < 0.67 OR weighted < 0.70 OR mean < 0.75) AS n_low FROM consensus GROUP BY 1, 2""")
def judge_stats(spark, sf):
    rows = curation.consensus(B.verdicts(spark, sf))
    return rows.groupBy("decision", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.avg("confidence_mean").alias("mean_confidence"), F.count(F.when(F.col("low_consensus"), 1)).alias("n_low"))


_PASSES = "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END"


@query("""SELECT doc_id AS item, CASE WHEN doc_id % 5 = 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'PASS_QP' ELSE 'DROP_QP' END
        WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 AND doc_id % 11 >= 7 THEN 'PASS_QP' ELSE 'DROP_QP' END AS decision,
    CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 AND doc_id % 11 >= 7 THEN NULL
        WHEN doc_id % 3 = 0 THEN 'QP_NOT_CIT_DEP' WHEN doc_id % 2 = 1 THEN 'QP_WRONG_TARGET' ELSE 'QP_ILL_FORMED' END AS reason,
    CASE WHEN doc_id % 5 = 4 THEN 0.5 ELSE (doc_id % 11) / 10.0 END AS confidence, CASE WHEN doc_id % 5 = 4 THEN 'v1' ELSE 'v2' END AS version FROM documents""")
def judge_parse(spark, sf):
    d = F.col("doc_id")
    flag = lambda c: F.when(c, "true").otherwise("false")
    checks = F.concat(F.lit('{"source_relevant": "yes", "target_relevant": true, "answer_supported": 1, "citation_dependent": true, "source_alone_sufficient": '), flag(d % 3 == 0), F.lit(', "target_adds_essential_information": '), flag(d % 2 == 0), F.lit("}"))
    new = F.concat(F.lit("Here is my verdict:\n```json\n{\"final_score\": "), (d % 11).cast("string"), F.lit(', "binary_checks": '), checks, F.lit("}\n```"))
    old = F.concat(F.lit('{"decision_qp": "'), F.when(d % 2 == 0, "PASS_QP").otherwise("DROP_QP"), F.lit('", "confidence": 0.5, "source_alone_insufficient": true}'))
    raw = B.table(spark, sf, "documents").select(d.alias("item"), F.when(d % 5 == 4, old).otherwise(new).alias("raw"))
    return raw.withColumn("j", curation.parse_judgement(F.col("raw"))).select("item", "j.decision", "j.reason", "j.confidence", "j.version")


_COHORT = f"""{_CONSENSUS}, answered AS (SELECT item, decision = 'PASS' AS valid FROM consensus WHERE item % 3 <> 0),
    cohorts AS (SELECT c.item, CASE WHEN valid THEN 'answer_valid' WHEN NOT valid THEN 'answer_dropped' ELSE 'dependency_valid' END AS cohort
        FROM (SELECT item FROM consensus WHERE n_passes % 4 <> 0 AND (decision = 'PASS' OR item % 2 = 0)) c LEFT JOIN answered USING (item))"""


def _cohorts(spark, sf):
    c = curation.consensus(B.verdicts(spark, sf))
    judged = c.select("item", F.when((F.col("n_passes") % 4 != 0) & ((F.col("decision") == "PASS") | (F.col("item") % 2 == 0)), "PASS").otherwise("DROP").alias("decision"))
    answered = c.where("item % 3 <> 0").select("item", "decision")
    return curation.cohorts(judged, answered, c.select("item", "n_passes"))


@query(f"WITH {_COHORT} SELECT item, cohort FROM cohorts")
def final_cohorts(spark, sf):
    return _cohorts(spark, sf).select("item", "cohort")


@query(f"WITH {_COHORT} SELECT cohort, count(*) AS n, min(item) AS first_item FROM cohorts GROUP BY 1")
def final_benchmark_stats(spark, sf):
    return _cohorts(spark, sf).groupBy("cohort").agg(F.count("*").alias("n"), F.min("item").alias("first_item"))


@query(f"""WITH {_COHORT} SELECT item % 5 AS bucket, count(*) AS judged, count(*) FILTER (cohorts.item IS NOT NULL) AS kept FROM consensus LEFT JOIN cohorts USING (item) GROUP BY 1""")
def cohort_overlap(spark, sf):
    c = curation.consensus(B.verdicts(spark, sf)).select("item")
    kept = _cohorts(spark, sf).select("item", F.lit(1).alias("kept"))
    return c.join(kept, "item", "left").groupBy((F.col("item") % 5).alias("bucket")).agg(F.count("*").alias("judged"), F.count("kept").alias("kept"))


# ---------------------------------------------------------------- generated questions and answers

_ERRORS = f"""CONCAT_WS(',', CASE WHEN trim(question) = '' THEN 'empty_question' END, CASE WHEN trim(answer) = '' THEN 'empty_expected_answer' END,
    CASE WHEN item % 7 = 0 THEN 'missing_pair_uid' END, CASE WHEN NOT contains(answer, 'the') THEN 'missing_required_tags' END,
    CASE WHEN len({WORDS.format('answer')}) BETWEEN 1 AND 19 THEN concat('answer_too_short:', len({WORDS.format('answer')})) END,
    CASE WHEN len({WORDS.format('answer')}) > 40 THEN concat('answer_too_long:', len({WORDS.format('answer')})) END)"""


def _checked(spark, sf):
    errors = curation.qa_errors(F.col("question"), F.col("answer"), F.when(F.col("item") % 7 != 0, "p"), F.lit("the"), F.lit("the"), 20, 40)
    return B.turns(spark, sf).withColumn("errors", F.array_join(errors, ","))


@query(f"WITH {B.TURNS} SELECT item, {_ERRORS} AS errors FROM turns")
def qa_validation(spark, sf):
    return _checked(spark, sf).select("item", "errors")


@query(f"""WITH {B.TURNS} SELECT method, persona, item FROM (SELECT *, row_number() OVER (PARTITION BY method, persona ORDER BY item) AS k FROM turns WHERE {_ERRORS} = '') WHERE k <= 5""")
def qa_persona_cap(spark, sf):
    rows = _checked(spark, sf).withColumn("reason", F.nullif("errors", F.lit("")))
    return curation.cap_kept(rows, ["method", "persona"], "item", 5).select("method", "persona", "item")


@query(f"""WITH {B.TURNS} SELECT method, CASE WHEN {_ERRORS} = '' THEN 'kept' ELSE split_part(split_part({_ERRORS}, ',', 1), ':', 1) END AS outcome, count(*) AS n FROM turns GROUP BY 1, 2""")
def generation_yield(spark, sf):
    first = F.split(F.split("errors", ",")[0], ":")[0]
    return _checked(spark, sf).groupBy("method", F.when(F.col("errors") == "", "kept").otherwise(first).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""WITH {B.TURNS} SELECT coalesce(method, 'all') AS method, coalesce(persona, 'all') AS persona, count(*) AS generated, count(*) FILTER ({_ERRORS} = '') AS valid, count(*) FILTER (item % 3 <> 0 AND {_ERRORS} = '') AS judged
    FROM turns GROUP BY ROLLUP (method, persona)""")
def pipeline_attrition(spark, sf):
    rows = _checked(spark, sf).withColumn("valid", F.col("errors") == "").withColumn("judged", F.col("valid") & (F.col("item") % 3 != 0))
    return statistics.attrition(rows, ["method", "persona"], ["valid", "judged"]).select(F.coalesce("method", F.lit("all")).alias("method"), F.coalesce("persona", F.lit("all")).alias("persona"), "generated", "valid", "judged")


@query(f"WITH {B.TURNS} SELECT method, persona, count(*) AS n, round(avg(len({WORDS.format('answer')})), 6) AS answer_words, round(avg(CAST(contains(answer, 'the') AS INT)), 6) AS tag_rate FROM turns GROUP BY 1, 2")
def generation_stats(spark, sf):
    return B.turns(spark, sf).groupBy("method", "persona").agg(F.count("*").alias("n"), F.avg(F.size(T.words(F.col("answer")))).alias("answer_words"), F.avg(F.col("answer").contains("the").cast("int")).alias("tag_rate"))


@query(f"WITH {B.TURNS} SELECT method, count(*) AS n, count(*) FILTER (item % 7 <> 0) AS with_ids, round(count(*) FILTER (item % 7 <> 0) / count(*), 6) AS share FROM turns GROUP BY 1")
def split_validation(spark, sf):
    ok = F.count(F.when(F.col("item") % 7 != 0, 1))
    return B.turns(spark, sf).groupBy("method").agg(F.count("*").alias("n"), ok.alias("with_ids"), (ok / F.count("*")).alias("share"))


_KEY = "trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH {B.TURNS} SELECT {_KEY} AS question_key, min(item) AS item, count(*) AS n FROM turns GROUP BY 1")
def question_dedup(spark, sf):
    return B.turns(spark, sf).groupBy(T.question_key(F.col("question")).alias("question_key")).agg(F.min("item").alias("item"), F.count("*").alias("n"))


@query(f"""WITH {B.TURNS}, k AS (SELECT count(*) AS n FROM turns GROUP BY {_KEY}) SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 1) AS duplicate_groups,
    CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS duplicate_rate FROM k""")
def duplicate_questions(spark, sf):
    return statistics.duplicate_questions(B.turns(spark, sf))


@query(f"""WITH {B.TURNS}, f AS (SELECT regexp_extract(lower(question), '[a-z0-9]+') AS w FROM turns) SELECT CASE WHEN w IN ({_list(T.QUESTION_WORDS)}) THEN w ELSE 'other' END AS question_type, count(*) AS n FROM f GROUP BY 1""")
def question_types(spark, sf):
    return statistics.question_types(B.turns(spark, sf))


_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(f"WITH {B.TURNS} SELECT item, round(CASE WHEN len(list_distinct(a)) = 0 THEN 0 ELSE len(list_intersect(a, q)) / len(list_distinct(a)) END, 6) AS overlap FROM (SELECT item, {_TOK.format('answer')} AS a, {_TOK.format('question')} AS q FROM turns)")
def passage_overlap(spark, sf):
    a, q = F.array_distinct(T.ascii_tokens(F.col("answer"))), T.ascii_tokens(F.col("question"))
    return B.turns(spark, sf).select("item", F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, q)) / F.size(a)).alias("overlap"))


@query()
def rouge_l(spark, sf):
    a, q = T.ascii_tokens(F.col("answer")), T.ascii_tokens(F.col("question"))
    return B.turns(spark, sf).select("item", T.f1(T.lcs_length(a, q), F.size(a), F.size(q)).alias("rouge_l"))


@query(f"WITH {B.REGULATED}, t AS (SELECT doc, unnest(regexp_extract_all(text, 'Section ([0-9]+)', 1)) AS tag FROM regulated) SELECT tag AS value, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def top_tagged_uids(spark, sf):
    rows = B.regulated(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit("Section ([0-9]+)"), F.lit(1))).alias("tag"))
    return statistics.top_values(rows, "tag")


@query(f"""WITH {B.TURNS} SELECT method, count(*) AS n, round(avg(len({WORDS.format('answer')})), 6) AS words, round(avg(CASE WHEN item % 4 = 0 THEN 0.0 ELSE len({_TOK.format('question')}) END), 6) AS score FROM turns GROUP BY 1""")
def answer_eval_summary(spark, sf):
    rows = B.turns(spark, sf).withColumn("words", F.size(T.words(F.col("answer")))).withColumn("score", F.when(F.col("item") % 4 != 0, F.size(T.ascii_tokens(F.col("question")))))
    return statistics.answer_summary(rows, ["method"], ["words", "score"])


@query("""SELECT doc_id AS item, doc_id % 4 < 3 AS valid FROM documents""")
def span_validation(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    start = F.when(d % 4 == 0, 0).otherwise(0)
    good = F.substring(text, 1, 3)
    span = F.struct(start.alias("start"), F.length(good).alias("end"), F.when(d % 4 < 3, good).otherwise(F.concat(good, F.lit("?"))).alias("text"))
    return B.table(spark, sf, "documents").select(d.alias("item"), curation.span_valid(span, text).alias("valid"))


@query("""SELECT doc_id AS item, concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'missing_pair_uid' END, CASE WHEN doc_id % 5 = 0 THEN 'missing_semantic_hook' END,
    CASE WHEN doc_id % 3 = 0 THEN 'title_target_should_not_have_spans' END, CASE WHEN doc_id % 4 = 3 THEN 'invalid_span:0' END) AS errors FROM documents""")
def schema_validation(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    good = F.substring(text, 1, 3)
    spans = F.array(F.struct(F.lit(0).alias("start"), F.length(good).alias("end"), F.when(d % 4 < 3, good).otherwise(F.concat(good, F.lit("?"))).alias("text")))
    errors = curation.schema_errors(F.when(d % 6 != 0, "p"), F.lit("s"), F.lit("t"), text, text, F.when(d % 5 != 0, "hook"), F.lit("Rule"), d % 3 == 0, spans)
    return B.table(spark, sf, "documents").select(d.alias("item"), F.array_join(errors, ",").alias("errors"))


@query(f"""WITH {B.TURNS} SELECT item, len(regexp_extract_all(answer, '\\[#(SRC|TGT):[^\\]]+\\]')) AS n_tags, regexp_matches(regexp_replace(answer, '\\[#[^\\]]*\\]', '', 'g'), '{T.CITATION}') AS citation_like
    FROM (SELECT item, concat(answer, ' [#SRC:a] [#TGT:b]') AS answer FROM turns)""")
def answer_tags(spark, sf):
    rows = B.turns(spark, sf).withColumn("answer", F.concat("answer", F.lit(" [#SRC:a] [#TGT:b]")))
    return rows.select("item", F.size(F.regexp_extract_all("answer", F.lit(r"\[#(SRC|TGT):[^\]]+\]"), F.lit(0))).alias("n_tags"), T.is_citation_like(F.regexp_replace("answer", r"\[#[^\]]*\]", "")).alias("citation_like"))


@query(f"WITH {B.TURNS} SELECT item, method FROM turns UNION ALL SELECT doc_id, 'label' FROM labels")
def merge_items(spark, sf):
    lab = B.table(spark, sf, "labels").select(F.col("doc_id").alias("item"), F.lit("label").alias("method"))
    return B.turns(spark, sf).unionByName(lab, allowMissingColumns=True).select("item", "method")


# ---------------------------------------------------------------- annotators, outcomes, splits

_MAJ = f"""{B.ANNOTATIONS}, maj AS (SELECT item, criterion, count(*) FILTER (label) AS yes, count(*) FILTER (NOT label) AS no, count(*) AS n,
    CASE WHEN count(*) FILTER (label) > count(*) FILTER (NOT label) THEN true WHEN count(*) FILTER (label) < count(*) FILTER (NOT label) THEN false END AS majority,
    greatest(count(*) FILTER (label), count(*) FILTER (NOT label)) / count(*) AS share FROM annotations GROUP BY 1, 2)"""


@query(f"WITH {_MAJ} SELECT item, criterion, yes, no, n, majority, round(share, 6) AS share FROM maj")
def audit_majority(spark, sf):
    return curation.label_majority(B.annotations(spark, sf))


@query(f"WITH {_MAJ} SELECT criterion, count(*) AS items, round(avg(share), 6) AS agreement FROM maj WHERE n >= 2 GROUP BY 1")
def audit_agreement(spark, sf):
    return curation.percent_agreement(B.annotations(spark, sf))


@query(f"""WITH {B.ANNOTATIONS} SELECT coalesce(criterion, 'all') AS criterion, coalesce(annotator, 'all') AS annotator, count(*) AS n, round(100.0 * count(*) FILTER (label) / count(*), 6) AS pct_yes
    FROM annotations GROUP BY GROUPING SETS ((), (criterion), (annotator), (criterion, annotator))""")
def audit_summary(spark, sf):
    rows = B.annotations(spark, sf)
    out = rows.groupingSets([[], ["criterion"], ["annotator"], ["criterion", "annotator"]], "criterion", "annotator").agg(F.count("*").alias("n"), (100.0 * F.count(F.when(F.col("label"), 1)) / F.count("*")).alias("pct_yes"))
    return out.select(F.coalesce("criterion", F.lit("all")).alias("criterion"), F.coalesce("annotator", F.lit("all")).alias("annotator"), "n", "pct_yes")


@query("""SELECT criterion, items, round(observed, 6) AS observed, round(CASE WHEN e >= 1 THEN CASE WHEN observed >= 1 THEN 1.0 ELSE 0.0 END ELSE (observed - e) / (1 - e) END, 6) AS kappa FROM (
    SELECT concat('c', doc_id % 3) AS criterion, count(*) AS items, avg(CAST(quality = toxic AS INT)) AS observed, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS e FROM labels GROUP BY 1)""")
def cohen_kappa(spark, sf):
    return curation.cohen_kappa(B.annotations(spark, sf))


@query(f"""WITH {B.TURNS}, pool AS (SELECT method, persona, count(*) AS c FROM turns GROUP BY 1, 2), exact AS (SELECT *, CAST(20 AS DOUBLE) * c / (SELECT sum(c) FROM pool) AS x FROM pool),
    base AS (SELECT *, greatest(floor(x), 1) AS least FROM exact), share AS (SELECT *, least + CAST(row_number() OVER (ORDER BY x - least DESC, method DESC, persona DESC) <= 20 - (SELECT sum(least) FROM base) AS INT) AS take FROM base),
    picked AS (SELECT item, t.method, t.persona FROM (SELECT *, row_number() OVER (PARTITION BY method, persona ORDER BY md5(concat('13|', item)), item) AS k FROM turns) t JOIN share s ON s.method = t.method AND s.persona = t.persona WHERE k <= take)
    SELECT format('HA-{{:06d}}', row_number() OVER (ORDER BY method, persona, item)) AS audit_id, item, method, persona FROM picked""")
def stratified_audit_sample(spark, sf):
    rows = B.turns(spark, sf).select("item", "method", "persona")
    return xrefs.stratified_sample(rows, ["method", "persona"], 20, 13, "item")[0].select("audit_id", "item", "method", "persona")


@query(f"""WITH {B.TURNS} SELECT method, persona, item FROM (SELECT *, row_number() OVER (PARTITION BY method, persona ORDER BY md5(concat('42|', item)), item) AS k FROM turns) WHERE k <= 3""")
def human_eval_table(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("method", "persona").orderBy(T.draw(42, F.col("item")), "item")
    return B.turns(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3").select("method", "persona", "item")


@query(f"""WITH {B.TURNS} SELECT item, method, CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.15) THEN 'dev' ELSE 'test' END AS split FROM (
    SELECT item, method, row_number() OVER (PARTITION BY method ORDER BY md5(concat('42|', item)), item) AS k, count(*) OVER (PARTITION BY method) AS n FROM turns)""")
def finalize_split(spark, sf):
    return curation.split(B.turns(spark, sf).select("item", "method"), "item", ["method"])


_OUTCOMES = f"""{B.TURNS}, answers AS (SELECT item, method AS run, len({WORDS.format('answer')}) AS words, CASE WHEN item % 5 <> 0 THEN len({WORDS.format('question')}) END AS score FROM turns),
    diag AS (SELECT item, run, CASE item % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'source_only' WHEN 2 THEN 'target_only' ELSE 'neither' END AS outcome FROM answers WHERE item % 3 <> 0),
    joined AS (SELECT answers.*, outcome FROM answers JOIN diag USING (item, run))"""


def _outcomes(spark, sf):
    answers = B.turns(spark, sf).select("item", F.col("method").alias("run"), F.size(T.words(F.col("answer"))).alias("words"), F.when(F.col("item") % 5 != 0, F.size(T.words(F.col("question")))).alias("score"))
    kind = F.element_at(F.array(*map(F.lit, ("both", "source_only", "target_only", "neither"))), (F.col("item") % 4 + 1).cast("int"))
    diag = answers.where("item % 3 <> 0").select("item", "run", kind.alias("outcome"))
    return curation.join_outcomes(answers, diag)


@query(f"WITH {_OUTCOMES} SELECT item, run, CAST(words AS BIGINT) AS words, CAST(score AS BIGINT) AS score, outcome FROM joined")
def answer_quality_join(spark, sf):
    return _outcomes(spark, sf)


@query(f"""WITH {_OUTCOMES}, s AS (SELECT run, outcome, 'words' AS metric, words AS value FROM joined UNION ALL SELECT run, outcome, 'score', score FROM joined),
    c AS (SELECT run, metric, avg(value) FILTER (outcome = 'both') - avg(value) FILTER (outcome <> 'both') AS contrast FROM s GROUP BY 1, 2)
    SELECT run, outcome, metric, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), CASE WHEN count(value) = 1 THEN 0.0 END), 6) AS std, round(CAST(quantile_cont(value, 0.5) AS DOUBLE), 6) AS median, round(any_value(contrast), 6) AS contrast
    FROM s JOIN c USING (run, metric) GROUP BY 1, 2, 3""")
def answer_quality_summary(spark, sf):
    return curation.quality_by_outcome(_outcomes(spark, sf), ["run"], ["words", "score"])


# ---------------------------------------------------------------- corpus and benchmark statistics

_MEASURES = f"""m AS (SELECT doc_id, len({WORDS.format('text')}) AS words, length(text) AS chars,
    len(string_split_regex(text, '[.!?]+')) - CAST(regexp_matches(text, '[.!?]$') AS INT) AS sentences FROM documents)"""


@query(f"""WITH {_MEASURES}, s AS (SELECT 'words' AS measure, words AS v FROM m UNION ALL SELECT 'chars', chars FROM m UNION ALL SELECT 'sentences', sentences FROM m)
    SELECT measure, count(*) AS n, round(avg(v), 6) AS mean, CAST(quantile_cont(v, 0.5) AS DOUBLE) AS median, CAST(min(v) AS DOUBLE) AS least, CAST(max(v) AS DOUBLE) AS most, round(stddev_samp(v), 6) AS std FROM s GROUP BY 1""")
def corpus_stats(spark, sf):
    return statistics.corpus_stats(B.passages(spark, sf))


@query(f"""WITH {_MEASURES} SELECT CASE WHEN words <= 25 THEN 25 WHEN words <= 50 THEN 50 WHEN words <= 100 THEN 100 WHEN words <= 200 THEN 200 WHEN words <= 400 THEN 400 END AS upper_edge, count(*) AS n FROM m GROUP BY 1""")
def corpus_histograms(spark, sf):
    return statistics.histogram(statistics.measures(B.passages(spark, sf)), "words")


@query(f"""WITH t AS (SELECT unnest({_TOK.format('text')}) AS w FROM documents) SELECT count(*) AS tokens, count(DISTINCT w) AS vocabulary, round(count(DISTINCT w) / count(*), 6) AS type_token_ratio FROM t""")
def vocab_stats(spark, sf):
    return statistics.vocabulary(B.passages(spark, sf))


_RECORDS = "r AS (SELECT item, method, persona, question, answer, CASE WHEN item % 3 = 0 THEN 'train' ELSE 'test' END AS cohort FROM turns)"


def _records(spark, sf):
    return B.turns(spark, sf).withColumn("cohort", F.when(F.col("item") % 3 == 0, "train").otherwise("test"))


@query(f"""WITH {B.TURNS}, {_RECORDS} SELECT cohort, field, value, count(*) AS n FROM (SELECT cohort, 'cohort' AS field, 'all' AS value FROM r UNION ALL SELECT cohort, 'method', method FROM r UNION ALL SELECT cohort, 'persona', persona FROM r) GROUP BY 1, 2, 3""")
def benchmark_group_counts(spark, sf):
    return statistics.group_counts(_records(spark, sf), ["method", "persona"])


_L = WORDS.format("question")


@query(f"""WITH {B.TURNS}, {_RECORDS}, w AS (SELECT cohort, method, len({_L}) AS words FROM r WHERE trim(question) <> '')
    SELECT level, cohort, method, count(*) AS n, CAST(quantile_cont(words, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont(words, 0.5) AS DOUBLE) AS median, CAST(quantile_cont(words, 0.75) AS DOUBLE) AS q3 FROM (
        SELECT 'overall' AS level, 'all' AS cohort, 'all' AS method, words FROM w UNION ALL SELECT 'cohort', cohort, 'all', words FROM w UNION ALL SELECT 'cohort+method', cohort, method, words FROM w) GROUP BY 1, 2, 3""")
def benchmark_length_stats(spark, sf):
    return statistics.length_stats(_records(spark, sf), "question", [[], ["cohort"], ["cohort", "method"]])


@query(f"""WITH {B.TURNS}, {_RECORDS} SELECT persona AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share, round(CAST(quantile_cont(len({_L}), 0.5) AS DOUBLE), 6) AS median_words,
    round(avg(CASE item % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END), 6) AS pass_rate FROM r GROUP BY 1""")
def difficulty_stats(spark, sf):
    rows = _records(spark, sf).withColumn("passed", T.tri_state(F.when(F.col("item") % 5 == 0, "yes").when(F.col("item") % 5 == 1, "no").otherwise("?")))
    each = rows.groupBy(F.col("persona").alias("label")).agg(F.count("*").alias("n"), F.percentile(F.size(T.words(F.col("question"))), 0.5).alias("median_words"), F.avg(F.col("passed").cast("double")).alias("pass_rate"))
    return each.join(F.broadcast(each.agg(F.sum("n").alias("total")))).select("label", "n", (F.col("n") / F.col("total")).alias("share"), "median_words", "pass_rate")


@query(f"""WITH {B.TURNS} SELECT method, count(*) AS items, count(*) FILTER (item % 3 <> 0) AS judged, count(*) FILTER (item % 3 <> 0 AND item % 5 <> 0) AS passed FROM turns GROUP BY 1""")
def curation_funnel(spark, sf):
    t = B.turns(spark, sf)
    judged = t.where("item % 3 <> 0").select("item", F.lit(1).alias("judged"))
    passed = t.where("item % 5 <> 0").select("item", F.lit(1).alias("passed"))
    rows = t.join(judged, "item", "left").join(passed, "item", "left")
    return rows.groupBy("method").agg(F.count("*").alias("items"), F.count("judged").alias("judged"), F.count(F.when(F.col("judged") == 1, F.col("passed"))).alias("passed"))


@query(f"""WITH {B.TURNS} SELECT method, persona, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY method), 6) AS pct FROM turns GROUP BY 1, 2""")
def curation_analysis(spark, sf):
    each = B.turns(spark, sf).groupBy("method", "persona").agg(F.count("*").alias("n"))
    total = each.groupBy("method").agg(F.sum("n").alias("total"))
    return each.join(total, "method").select("method", "persona", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


@query(f"""WITH {B.TURNS} SELECT outcome, item, k FROM (SELECT CASE WHEN {_ERRORS} = '' THEN 'ok' ELSE 'bad' END AS outcome, item, row_number() OVER (PARTITION BY {_ERRORS} = '' ORDER BY item) AS k FROM turns) WHERE k <= 5""")
def pilot_report(spark, sf):
    from pyspark.sql import Window as W

    rows = _checked(spark, sf).withColumn("outcome", F.when(F.col("errors") == "", "ok").otherwise("bad"))
    return rows.withColumn("k", F.row_number().over(W.partitionBy("outcome").orderBy("item"))).where("k <= 5").select("outcome", "item", "k")


# ---------------------------------------------------------------- pages


# In SQL: the given pages hold their content as paragraphs of one article, some of them unclosed, under one heading.
_NO_MARKUP = "trim(regexp_replace(regexp_replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"
_PARAGRAPHS = f"""articles AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS article FROM {{pages}}),
    parts AS (SELECT page_id, {_NO_MARKUP.format("regexp_extract(article, '<h1>(.*?)</h1>', 1, 's')")} AS headings, (string_split(article, '<p>'))[2:] AS parts FROM articles),
    chunks AS (SELECT page_id, headings, unnest(range(len(parts))) AS k, unnest(parts) AS part FROM parts),
    blocks AS (SELECT page_id, headings, k, part, {_NO_MARKUP.format("regexp_replace(part, '</p>.*', '', 's')")} AS text FROM chunks),
    kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS position FROM blocks
        WHERE length(text) >= 25 AND len(string_split(text, ' ')) >= 4 AND NOT regexp_matches(text, '\\.{{{{4,}}}}')
        AND NOT regexp_matches(text, '^(legal instruments that change this (part|rule|chapter)\\b|parts?\\b|policy statements?\\b|annex(es)?\\b|appendix\\b)', 'i'))"""


@query(f"""WITH {_PARAGRAPHS.format(pages="pages")}
    SELECT page_id, CAST(position AS INT) AS position, 'p' AS tag, format('p{{:06d}}', position + 1) AS anchor, headings, text FROM kept""")
def html_passages(spark, sf):
    rows = html.passages(B.table(spark, sf, "pages"))
    return rows.select("page_id", "position", "tag", "anchor", F.array_join("headings", " > ").alias("headings"), "text")


@query(f"""WITH linked AS (SELECT page_id, replace(html, '<br>', concat(' <a href="../to/', page_id, '#x">page <i>', page_id, '</i></a> ')) AS html FROM pages), {_PARAGRAPHS.format(pages="linked")}
    SELECT page_id, CAST(position AS INT) AS position, concat('../to/', page_id, '#x') AS href, concat('https://h.example/to/', page_id, '#x') AS absolute, concat('page ', page_id) AS text
    FROM kept WHERE contains(part, '<a href')""")
def html_links(spark, sf):
    """The pages' own content with a link in place of each line break."""
    link = F.concat(F.lit(' <a href="../to/'), "page_id", F.lit('#x">page <i>'), "page_id", F.lit("</i></a> "))
    pages = B.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://h.example/from/"), "page_id").alias("url"), F.replace("html", F.lit("<br>"), link).alias("html"))
    return html.links(pages)


def _normal(c: str) -> str:
    bare = f"regexp_replace(trim({c}), '[#?].*$', '')"
    head = f"regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/]*')"
    return f"(lower({head}) || regexp_replace(substr({bare}, length({head}) + 1), '/+$', ''))"


_UNDATED = "regexp_replace({}, '/\\d{{2}}-\\d{{2}}-\\d{{4}}/?$', '')"
_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/:?#]*)', 1))"


@query(f"""WITH links AS (SELECT p.page_id AS ref, p.url AS page_url, CASE WHEN p.page_id % 11 = 0 THEN 'mailto:a@b.c' WHEN p.page_id % 13 = 0 THEN 'https://elsewhere.example/x'
        ELSE regexp_replace(t.url, '#.*$', '') || ['#Sec-1', '#SEC-2', '#Sec%2D3', '#nowhere', ''][CAST(p.page_id % 5 + 1 AS INT)] END AS href
        FROM pages p JOIN pages t ON t.page_id = (p.page_id * 7 + 3) % (SELECT count(*) FROM pages)),
    known AS (SELECT page_id, {_normal("url")} AS k FROM pages), exact AS (SELECT k, min(page_id) AS doc FROM known WHERE k <> '' GROUP BY 1),
    undated AS (SELECT {_UNDATED.format("k")} AS k, min(page_id) AS doc FROM known WHERE k <> '' GROUP BY 1),
    asked AS (SELECT *, coalesce(trim(href) = '' OR regexp_matches(lower(trim(href)), '^(mailto:|javascript:|tel:|data:|#$)'), true) AS bad, {_normal("href")} AS k, regexp_extract(href, '#(.*)$', 1) AS f FROM links),
    found AS (SELECT a.*, CASE WHEN NOT bad THEN coalesce(e.doc, u.doc) END AS doc, list_position(['Sec-0', 'Sec-1', 'Sec-2', 'Sec-3'], f) - 1 AS p1, list_position(['sec-0', 'sec-1', 'sec-2', 'sec-3'], lower(f)) - 1 AS p2,
        list_position(['sec0', 'sec1', 'sec2', 'sec3'], regexp_replace(lower(url_decode(f)), '[^a-z0-9]+', '', 'g')) - 1 AS p3 FROM asked a LEFT JOIN exact e ON e.k = a.k LEFT JOIN undated u ON u.k = {_UNDATED.format("a.k")}),
    hosts AS (SELECT *, {_HOST.format("href")} = '' OR {_HOST.format("href")} = {_HOST.format("page_url")} AS same FROM found)
    SELECT ref, doc, CASE WHEN doc IS NOT NULL THEN doc * 10 + coalesce(p1, p2, p3, 0) END AS passage,
        CASE WHEN bad THEN 'bad_href' WHEN doc IS NULL AND NOT same THEN 'off_site' WHEN doc IS NULL THEN 'unknown_document' WHEN p1 IS NOT NULL THEN 'exact' WHEN p2 IS NOT NULL THEN 'lower' WHEN p3 IS NOT NULL THEN 'normalised' ELSE 'document' END AS reason,
        CASE WHEN bad THEN 'bad' WHEN doc IS NOT NULL AND k = {_normal("page_url")} THEN 'internal' WHEN doc IS NOT NULL THEN 'external' WHEN same THEN 'outsource_same_host' ELSE 'outsource' END AS kind FROM hosts""")
def link_resolution(spark, sf):
    pages = B.table(spark, sf, "pages")
    n = pages.count()
    p = F.col("page_id")
    fragment = F.element_at(F.array(F.lit("#Sec-1"), F.lit("#SEC-2"), F.lit("#Sec%2D3"), F.lit("#nowhere"), F.lit("")), (p % 5 + 1).cast("int"))
    target = pages.select(p.alias("to"), F.regexp_replace("url", "#.*$", "").alias("to_url"))
    refs = pages.withColumn("to", (p * 7 + 3) % n).join(target, "to").select(p.alias("ref"), F.col("url").alias("page_url"), F.when(p % 11 == 0, "mailto:a@b.c").when(p % 13 == 0, "https://elsewhere.example/x").otherwise(F.concat("to_url", fragment)).alias("href"))
    documents = pages.select(p.alias("doc"), "url", p.alias("load_order"))
    anchors = pages.select(p.alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("position")).select("doc", F.concat(F.lit("Sec-"), F.col("position").cast("string")).alias("anchor"), (F.col("doc") * 10 + F.col("position")).alias("passage"), "position")
    return links.resolve(refs, documents, anchors)
