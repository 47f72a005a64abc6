"""Registered queries of full verdicts, cohort records, queues, replies, samples and tables for reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import records, replies, sampling, statistics
from citeweave.plans import bindings as B
from citeweave.plans.queries import WORDS, query
from citeweave.sources import layout

# ---------------------------------------------------------------- verdicts of several passes


def _passes(spark, sf):
    """Events as passes: unlike the plain verdicts, passing rows carry reasons too, and there are checks."""
    e = B.table(spark, sf, "events")
    d = F.col("event_id")
    ok = F.col("event_type").isin("click", "view", "purchase")
    return e.select(
        F.col("user_id").alias("item"), d.alias("pass_no"), F.when(ok, "PASS").otherwise("DROP").alias("decision"),
        F.when(~ok, F.col("event_type")).when(d % 3 == 0, "late_note").alias("reason"), F.least(F.lit(1.0), F.col("value") / 490.02).alias("confidence"),
        (d % 11).alias("score"), (d % 3 == 0).alias("source_alone_sufficient"), (d % 4 == 1).alias("target_alone_sufficient"), (d % 5 != 0).alias("target_adds"),
        F.when(d % 7 > 0, d % 7 != 1).alias("citation_dependent"), (d % 2 == 0).alias("answer_supported"),
        (d % 2 == 0).alias("answer_responsive"), (d % 3 != 1).alias("tags_present_for_both"), F.when(d % 6 > 1, d % 4 == 0).alias("hallucination_detected"),
    )


_PASSES = """passes AS (SELECT user_id AS item, event_id AS d, event_type IN ('click', 'view', 'purchase') AS ok,
        CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN event_type WHEN event_id % 3 = 0 THEN 'late_note' END AS reason, least(1.0, value / 490.02) AS confidence FROM events),
    sums AS (SELECT item, count(*) AS n_passes, count(*) FILTER (ok) AS votes_pass, count(*) FILTER (NOT ok) AS votes_drop,
        coalesce(sum(confidence) FILTER (ok), 0) AS p, coalesce(sum(confidence) FILTER (NOT ok), 0) AS n, avg(confidence) AS mean FROM passes GROUP BY 1)"""
_LOW = "greatest(votes_pass, votes_drop) / n_passes < 0.67 OR CASE WHEN p + n > 0 THEN greatest(p, n) / (p + n) ELSE 0 END < 0.70 OR mean < 0.75"


def _top(where: str) -> str:
    return f"top AS (SELECT item, arg_min(reason, (-k, first)) AS reason FROM (SELECT item, reason, count(*) AS k, min(d) AS first FROM passes WHERE reason IS NOT NULL AND {where} GROUP BY 1, 2) GROUP BY 1)"


def _more(c: str, sign: str = ">") -> str:
    return f"CASE WHEN count({c}) > 0 THEN 2 * count(*) FILTER ({c}) {sign} count({c}) END"


@query(f"""WITH {_PASSES}, {_top("NOT ok")}, checks AS (SELECT item, CAST(round_even(avg(d % 11), 0) AS BIGINT) AS final_score, {_more("(d % 3 = 0)")} AS suff, {_more("(d % 4 = 1)")} AS tsuff, {_more("(d % 5 <> 0)")} AS adds,
        {_more("CASE WHEN d % 7 > 0 THEN d % 7 <> 1 END")} AS dep, {_more("(d % 2 = 0)")} AS sup FROM passes GROUP BY 1),
    j AS (SELECT *, p > n AND (coalesce(suff, false) OR adds = false OR dep = false OR sup = false) AS guard FROM sums JOIN checks USING (item) LEFT JOIN top USING (item))
    SELECT item, CASE WHEN p > n AND NOT coalesce(guard, false) THEN 'PASS' ELSE 'DROP' END AS decision,
        CASE WHEN coalesce(guard, false) THEN CASE WHEN suff THEN 'QP_NOT_CIT_DEP' WHEN adds = false THEN 'QP_WRONG_TARGET' WHEN sup = false THEN 'QP_ILL_FORMED' ELSE 'QP_NOT_CIT_DEP' END WHEN n > p THEN reason END AS reason,
        n_passes, votes_pass, votes_drop, round(mean, 3) AS confidence_mean, round(CASE WHEN p + n > 0 THEN greatest(p, n) / (p + n) ELSE 0 END, 3) AS weighted_fraction, {_LOW} AS low_consensus, final_score,
        suff AS source_alone_sufficient, tsuff AS target_alone_sufficient, adds AS target_adds, dep AS citation_dependent, sup AS answer_supported,
        coalesce(suff, false) AS fails_source_alone, coalesce(NOT adds, false) AS fails_target_not_necessary, coalesce(NOT sup, false) AS fails_unsupported_answer FROM j""")
def judge_verdicts(spark, sf):
    return records.judge_verdicts(_passes(spark, sf))


_ANSWERS = f"""{_PASSES}, {_top("true")}, checks AS (SELECT item, {_more("(d % 2 = 0)", ">=")} AS responsive, {_more("(d % 2 = 0)", ">=")} AS supported, {_more("(d % 3 <> 1)", ">=")} AS tags,
        {_more("CASE WHEN d % 6 > 1 THEN d % 4 = 0 END", ">=")} AS invented FROM passes GROUP BY 1),
    answers AS (SELECT item, CASE WHEN p > n THEN 'PASS' ELSE 'DROP' END AS decision, CASE WHEN n > p THEN reason END AS reason, n_passes, votes_pass, votes_drop, round(mean, 3) AS confidence_mean,
        round(CASE WHEN p + n > 0 THEN greatest(p, n) / (p + n) ELSE 0 END, 3) AS weighted_fraction, {_LOW} AS low_consensus, responsive AS answer_responsive, supported AS answer_supported, tags AS tags_present_for_both, invented AS hallucination_detected
        FROM sums JOIN checks USING (item) LEFT JOIN top USING (item))"""


@query(f"WITH {_ANSWERS} SELECT * FROM answers")
def answer_verdicts(spark, sf):
    return records.answer_verdicts(_passes(spark, sf))


@query(f"""WITH {_ANSWERS} SELECT count(*) AS total, count(*) FILTER (decision = 'PASS') AS passed, count(*) FILTER (decision = 'DROP') AS dropped, count(*) FILTER (low_consensus) AS low_consensus,
    round(avg(confidence_mean), 3) AS confidence_mean, round(avg(weighted_fraction), 3) AS weighted_fraction FROM answers""")
def answer_stats(spark, sf):
    return records.verdict_stats(records.answer_verdicts(_passes(spark, sf)))


@query("""SELECT doc_id AS item, CASE WHEN doc_id % 4 = 0 THEN 'DROP' ELSE 'PASS' END AS decision, CASE WHEN doc_id % 4 = 0 THEN 'QP_ILL_FORMED' END AS reason,
    CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 0.9 END AS confidence, CASE WHEN doc_id % 4 = 0 THEN false ELSE doc_id % 2 = 0 END AS answer_supported, doc_id % 4 = 0 AS failed FROM documents""")
def failure_rows(spark, sf):
    d = F.col("doc_id")
    expected = B.table(spark, sf, "documents").select(d.alias("item"), F.lit(1).alias("pass_no"))
    got = B.table(spark, sf, "documents").where(d % 4 != 0).select(d.alias("item"), F.lit(1).alias("pass_no"), F.lit("PASS").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(0.9).alias("confidence"), (d % 2 == 0).alias("answer_supported"))
    return records.with_failures(expected, got, "QP_ILL_FORMED", ("answer_supported",)).drop("pass_no")


# ---------------------------------------------------------------- cohort records

LABELS = ("easy", "medium", "hard", "source_only", "target_only", "neither")


def _cohort_records(spark, sf):
    t, i = B.turns(spark, sf), F.col("item")
    src, tgt = F.concat(F.lit("s"), (i % 10).cast("string")), F.concat(F.lit("t"), (i % 10).cast("string"))
    judge_passed = t.select("item", F.when(i % 3 != 0, "PASS").otherwise("DROP").alias("decision"), F.lit("v1").alias("judge_schema_version"), (i % 2 == 0).alias("source_alone_sufficient"))
    judge_all = t.where(i % 5 != 0).select("item", (i % 4 == 0).alias("source_alone_sufficient"), F.lit(True).alias("citation_dependent"))
    answer = t.select("item", F.when((i % 7).isin(1, 2, 3), "PASS").when((i % 7).isin(4, 5), "DROP").alias("decision"), F.when(i % 7 <= 3, 0.9).otherwise(0.2).alias("confidence_mean"), F.when(i % 7 >= 4, "ANS_X").alias("reason"))
    run = lambda reason, notes: F.struct(F.lit(reason).alias("reason"), notes.alias("notes"))
    runs = F.when(i % 7 >= 4, F.array(run("ANS_Y", F.concat(F.lit("note "), (i % 2).cast("string"))), run("ANS_X", F.lit(None).cast("string"))))
    answer_all = t.where((i % 7).isin(1, 4)).select("item", F.lit(0.5).alias("confidence_mean"), (i % 2 == 0).alias("answer_grounded_in_passages"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), (i % 6 + 1).cast("int"))
    ir = t.select("item", F.concat(F.lit("ir "), F.col("question")).alias("question"), src.alias("source_passage_id"), tgt.alias("target_passage_id"), F.lit("ir").alias("persona"), (i % 4).alias("source_vote_count"), label.alias("ir_difficulty_label"))
    gen = t.where(i % 11 != 0).select("item", "question", F.concat("answer", F.lit(" [#SRC:"), src, F.lit("]")).alias("gold_answer"), "method", "persona", (i % 13 == 0).alias("citation_leakage"))
    return records.cohort_records(judge_passed.where("decision = 'PASS'"), judge_all, answer.where("decision = 'PASS'").withColumn("runs", runs), answer.where("decision = 'DROP'").withColumn("runs", runs), answer_all, ir, gen, {"benchmark_role": "dependent questions"})


_RECORDS = f"""{B.TURNS}, rec AS (SELECT item, CASE WHEN item % 11 <> 0 THEN question ELSE concat('ir ', question) END AS question, CASE WHEN item % 11 <> 0 THEN method ELSE '' END AS method, CASE WHEN item % 11 <> 0 THEN persona ELSE 'ir' END AS persona,
        concat('s', item % 10) AS source_passage_id, item % 11 <> 0 AND item % 13 = 0 AS citation_leakage, ['easy', 'medium', 'hard', 'source_only', 'target_only', 'neither'][CAST(item % 6 + 1 AS INT)] AS ir_difficulty_label,
        CASE WHEN item % 6 < 2 THEN 'retrievable' ELSE 'challenging' END AS difficulty_tier, item % 4 AS source_vote_count, item % 7 IN (1, 2, 3) AS answer_validation_passed,
        CASE WHEN item % 7 IN (1, 4) THEN 0.5 WHEN item % 7 IN (2, 3) THEN 0.9 WHEN item % 7 = 5 THEN 0.2 END AS answer_validation_score,
        CASE WHEN item % 7 IN (4, 5) THEN concat('ANS_X|ANS_Y|note ', item % 2) ELSE '' END AS reasons, item % 11 = 0 AS missing_source_tag, true AS missing_target_tag, 'v1' AS judge_schema_version,
        CASE WHEN item % 5 <> 0 THEN item % 4 = 0 ELSE item % 2 = 0 END AS source_alone_sufficient, CASE WHEN item % 5 <> 0 THEN true END AS citation_dependent, CASE WHEN item % 7 IN (1, 4) THEN item % 2 = 0 END AS answer_supported,
        CASE WHEN item % 7 IN (1, 2, 3) THEN 'answer_valid' WHEN item % 7 IN (4, 5) THEN 'answer_failed' ELSE 'dependency_valid' END AS cohort, 'dependent questions' AS benchmark_role
    FROM turns WHERE item % 3 <> 0)"""


@query(f"WITH {_RECORDS} SELECT * FROM rec")
def cohort_records(spark, sf):
    return _cohort_records(spark, sf).select("item", "question", "method", "persona", "source_passage_id", "citation_leakage", "ir_difficulty_label", "difficulty_tier", "source_vote_count", "answer_validation_passed", "answer_validation_score", F.array_join("answer_validation_reasons", "|").alias("reasons"), "missing_source_tag", "missing_target_tag", "judge_schema_version", "source_alone_sufficient", "citation_dependent", "answer_supported", "cohort", "benchmark_role")


@query(f"""WITH {_RECORDS}, f AS (SELECT * FROM rec WHERE answer_validation_passed) SELECT 'cohort' AS kind, 'dependency_valid' AS value, count(*) AS n FROM rec UNION ALL SELECT 'cohort', 'answer_valid', count(*) FILTER (cohort = 'answer_valid') FROM rec
    UNION ALL SELECT 'cohort', 'answer_failed', count(*) FILTER (cohort = 'answer_failed') FROM rec UNION ALL SELECT 'tier', difficulty_tier, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'label', ir_difficulty_label, count(*) FROM f GROUP BY 2""")
def cohort_stats(spark, sf):
    return records.cohort_stats(_cohort_records(spark, sf))


@query(f"""WITH {_RECORDS}, v AS (SELECT cohort, unnest([{{'field': 'method', 'value': method}}, {{'field': 'persona', 'value': persona}}, {{'field': 'ir_difficulty_label', 'value': ir_difficulty_label}}, {{'field': 'reference_type', 'value': ''}},
        {{'field': 'citation_leakage', 'value': CAST(citation_leakage AS VARCHAR)}}, {{'field': 'answer_validation_passed', 'value': CAST(answer_validation_passed AS VARCHAR)}}, {{'field': 'judge_schema_version', 'value': judge_schema_version}},
        {{'field': 'corpus', 'value': CASE WHEN item % 2 = 0 THEN 'a' ELSE 'b' END}}, {{'field': 'split', 'value': CASE item % 3 WHEN 1 THEN 'train' ELSE 'test' END}}]) AS x FROM rec)
    SELECT 'cohort_count' AS stat, 'overall' AS field, 'all' AS value, 'all' AS cohort, count(*) AS n FROM rec UNION ALL SELECT 'cohort_count', 'cohort', cohort, cohort, count(*) FROM rec GROUP BY cohort
    UNION ALL SELECT 'group_count', x.field, coalesce(nullif(x.value, ''), 'missing'), cohort, count(*) FROM v GROUP BY 2, 3, 4""")
def benchmark_statistics(spark, sf):
    rows = _cohort_records(spark, sf).withColumn("corpus", F.when(F.col("item") % 2 == 0, "a").otherwise("b")).withColumn("split", F.when(F.col("item") % 3 == 1, "train").otherwise("test"))
    return statistics.benchmark_groups(rows)


@query(f"""WITH {_RECORDS} SELECT CAST(max(item % 50) AS BIGINT) AS generated_count, CAST(NULL AS BIGINT) AS structurally_valid_count, count(*) FILTER (citation_leakage) AS citation_leakage_count, count(*) FILTER (cohort = 'dependency_valid') AS citation_dependency_passed_count,
    count(*) FILTER (cohort = 'answer_valid') AS answer_validation_passed_count, count(*) FILTER (cohort = 'answer_failed') AS answer_validation_failed_count, count(*) FILTER (cohort = 'dependency_valid') AS final_dependency_valid_count,
    count(*) FILTER (cohort = 'answer_valid') AS final_answer_valid_count, count(*) FILTER (cohort = 'answer_failed') AS final_answer_failed_count FROM rec""")
def construction_counts(spark, sf):
    return statistics.construction_counts(_cohort_records(spark, sf).withColumn("generated_count", (F.col("item") % 50).cast("string")))


_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(rf"""WITH {B.TURNS}, r AS (SELECT CASE WHEN item % 2 = 0 THEN 'a' ELSE 'b' END AS cohort, persona AS label, item, list_distinct({_W.format("question")}) AS x, list_distinct({_W.format("answer")}) AS y, len({_W.format("question")}) AS q, len({_W.format("answer")}) AS a FROM turns),
    e AS (SELECT cohort, label, count(*) AS n, quantile_cont(nullif(q, 0), 0.5) AS q, quantile_cont(nullif(a, 0), 0.5) AS a, quantile_cont(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 0.5) AS o,
        avg(CASE item % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END) AS pass FROM r GROUP BY 1, 2)
    SELECT cohort, label AS ir_difficulty_label, n, CAST(q AS DOUBLE) AS question_median, CAST(a AS DOUBLE) AS answer_median, round(o, 6) AS overlap_median, round(pass, 6) AS pass_rate, round(n / sum(n) OVER (PARTITION BY cohort), 6) AS share FROM e""")
def difficulty_rows(spark, sf):
    i = F.col("item")
    rows = B.turns(spark, sf).select(F.when(i % 2 == 0, "a").otherwise("b").alias("cohort"), F.col("persona").alias("ir_difficulty_label"), "question", F.col("answer").alias("gold_answer"), F.col("question").alias("source_text"), F.col("answer").alias("target_text"), F.when(i % 5 == 0, "valid").when(i % 5 == 1, "No").otherwise("?").alias("answer_validation_passed"))
    return statistics.difficulty_rows(rows)


# ---------------------------------------------------------------- queues and joins


def _passages(spark, sf):
    return B.passages(spark, sf).select(F.col("doc").cast("string").alias("key"), "text")


def _items(spark, sf):
    n = B.table(spark, sf, "documents").agg(F.count("*")).scalar()
    i = F.col("item")
    return B.turns(spark, sf).select("item", "question", F.col("answer").alias("gold_answer"), F.when(i % 9 != 0, (i % n).cast("string")).alias("source_passage_id"), ((i * 7 + 1) % n).cast("string").alias("target_passage_id"), F.when(i % 2 == 0, "own text").otherwise("").alias("source_text"), F.lit(None).cast("string").alias("target_text"), F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "JUDGE_IR").otherwise("KEEP").alias("decision_ir"), F.when(i % 8 == 0, "JUDGE").otherwise("DROP").alias("decision"), "method", "persona")


_ITEMS = f"""{B.TURNS}, items AS (SELECT item, question, answer AS gold_answer, CASE WHEN item % 9 <> 0 THEN item % n END AS s, (item * 7 + 1) % n AS t, item % 2 = 0 AS own,
        CASE WHEN item % 4 = 0 THEN CASE WHEN item % 8 = 0 THEN 'JUDGE' ELSE 'DROP' END WHEN item % 4 = 1 THEN 'JUDGE_IR' ELSE 'KEEP' END AS decision, method, persona FROM turns, (SELECT count(*) AS n FROM documents))"""


@query(f"""WITH {_ITEMS} SELECT item, CASE WHEN own THEN 8 ELSE length(a.text) END AS source_chars, length(b.text) AS target_chars FROM items JOIN documents a ON a.doc_id = s JOIN documents b ON b.doc_id = t WHERE decision IN ('JUDGE', 'JUDGE_IR') AND question <> ''""")
def judge_queue(spark, sf):
    rows = records.judge_queue(_items(spark, sf), _passages(spark, sf))
    return rows.select("item", F.length("source_text").alias("source_chars"), F.length("target_text").alias("target_chars"))


@query(f"""WITH {_ITEMS} SELECT item, length(a.text) AS source_chars, length(b.text) AS target_chars FROM items JOIN documents a ON a.doc_id = s JOIN documents b ON b.doc_id = t WHERE item % 3 <> 0""")
def answer_queue(spark, sf):
    items = _items(spark, sf)
    verdicts = items.select("item", F.when(F.col("item") % 3 != 0, "PASS").otherwise("DROP").alias("decision"))
    rows = records.answer_queue(verdicts.unionByName(verdicts), items, _passages(spark, sf))
    return rows.select("item", F.length("source_text").alias("source_chars"), F.length("target_text").alias("target_chars"))


@query(f"WITH {_ITEMS} SELECT DISTINCT x AS key FROM (SELECT s AS x FROM items UNION ALL SELECT t FROM items) WHERE x IS NOT NULL")
def passages_needed(spark, sf):
    return records.passages_needed(_items(spark, sf), _passages(spark, sf)).select(F.col("key").cast("long").alias("key"))


@query(f"""WITH {_ITEMS}, refs AS (SELECT item % 50 AS a, item % 60 AS b, min(item) AS seq FROM items GROUP BY 1, 2), r AS (SELECT item, s, t, question, method, persona FROM items WHERE item % 4 < 2)
    SELECT r.item, method, coalesce(length(d.text), 0) AS source_chars, coalesce(d.source, '') AS source_doc, coalesce(e.source, '') AS target_doc,
        CASE WHEN r.s % 2 = 0 THEN concat('id ', r.s) WHEN r.s IS NOT NULL THEN concat('uid ', r.s) ELSE '' END AS ref_text
    FROM r LEFT JOIN documents d ON d.doc_id = r.s LEFT JOIN documents e ON e.doc_id = r.t""")
def human_eval_join(spark, sf):
    """References by passage ids for even sources, by uids for odd ones; later ones of a pair never win."""
    items = _items(spark, sf)
    sample = items.where("item % 4 < 2").select("item", "method", F.lit("test").alias("split"), "persona")
    passages = B.passages(spark, sf).select(F.col("doc").cast("string").alias("key"), F.concat(F.lit("u"), F.col("doc").cast("string")).alias("uid"), F.col("source").alias("doc"), "text")
    pairs = items.where("source_passage_id is not null").select(F.col("source_passage_id").alias("s"), F.col("target_passage_id").alias("t")).distinct()
    even = F.col("s").cast("long") % 2 == 0
    uid = lambda c: F.concat(F.lit("u"), F.col(c))
    first = pairs.select(F.when(even, F.col("s")).otherwise("").alias("source_id"), F.when(even, F.col("t")).otherwise("").alias("target_id"), uid("s").alias("source_uid"), uid("t").alias("target_uid"), F.concat(F.when(even, "id ").otherwise("uid "), F.col("s")).alias("ref_text"), F.lit("Internal").alias("ref_type"), F.lit(1).alias("seq"))
    later = first.withColumn("ref_text", F.lit("late")).withColumn("seq", F.lit(2))
    rows = records.human_eval(sample, items, passages, first.unionByName(later))
    return rows.select("item", "method", F.length("source_text").alias("source_chars"), "source_doc", "target_doc", "ref_text")


@query(f"""WITH {B.BM25}, {B.TEXT_GOLD}, found AS (SELECT qid, string_agg(text, '\n\n' ORDER BY rank) AS context, count(*) AS n FROM text_run JOIN documents ON doc_id = doc WHERE rank <= 5 AND qid % 4 <> 0 GROUP BY 1),
    pair AS (SELECT g.qid, string_agg(text, '\n\n' ORDER BY CASE WHEN doc_id = src THEN 0 ELSE 1 END) AS context, count(*) AS n FROM text_gold g JOIN documents ON doc_id = src OR doc_id = tgt GROUP BY 1)
    SELECT g.qid, md5(coalesce(f.context, p.context, '')) AS context_md5, coalesce(f.n, p.n, 0) AS n_passages, f.qid IS NULL AS fallback FROM text_gold g LEFT JOIN found f USING (qid) LEFT JOIN pair p USING (qid)""")
def rag_context(spark, sf):
    """The texts of the first five passages found; every fourth query found nothing and gets its gold pair's."""
    run = B.text_run(spark, sf).where("qid % 4 <> 0")
    out = records.rag_context(run, B.passages(spark, sf), B.text_gold(spark, sf), k=5)
    return out.select("qid", F.md5("context").alias("context_md5"), "n_passages", "fallback")


@query("""SELECT doc_id AS item, CASE WHEN a >= b AND a >= c THEN 'contradiction' WHEN b >= c THEN 'neutral' ELSE 'entailment' END AS label, round(greatest(a, b, c), 6) AS confidence
    FROM (SELECT doc_id, (n - length(replace(t, 'e', ''))) / greatest(n, 1) AS a, (n - length(replace(t, 'n', ''))) / greatest(n, 1) AS b, (n - length(replace(t, 't', ''))) / greatest(n, 1) AS c
        FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents))""")
def nli_argmax(spark, sf):
    """Three scores of every text: its shares of three letters."""
    text = F.coalesce("text", F.lit(""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / F.greatest(F.length(text), F.lit(1))
    label, top = records.nli_argmax(F.array(share("e"), share("n"), share("t")))
    return B.table(spark, sf, "documents").select(F.col("doc_id").alias("item"), label.alias("label"), top.alias("confidence"))


@query(f"""WITH {B.TURNS}, ir AS (SELECT method, avg(item % 10) AS recall FROM turns GROUP BY 1), a AS (SELECT method, avg(item % 3) AS score FROM turns WHERE method = 'direct' GROUP BY 1)
    SELECT method, round(recall, 6) AS recall, round(score, 6) AS score FROM ir LEFT JOIN a USING (method)""")
def eval_summary(spark, sf):
    t = B.turns(spark, sf)
    return records.eval_summary(t.groupBy("method").agg(F.avg(F.col("item") % 10).alias("recall")), t.where("method = 'direct'").groupBy("method").agg(F.avg(F.col("item") % 3).alias("score")))


# ---------------------------------------------------------------- samples, replies, tables


@query(f"""WITH {B.PAIRS}, f AS (SELECT target_id % 100 AS target_id, min(seq) AS seq FROM refs GROUP BY 1) SELECT target_id, seq FROM f ORDER BY md5(concat('13|', target_id)), target_id LIMIT 20""")
def sample_unique_targets(spark, sf):
    refs = B.references(spark, sf).select((F.col("target_id") % 100).alias("target_id"), "seq", "source_id")
    return sampling.unique_targets(refs, 20).select("target_id", "seq")


@query(f"""WITH {B.PAIRS}, f AS (SELECT seq, target_id % 4 = 0 AS a, source_id % 6 = 0 AS b FROM refs) SELECT seq FROM f WHERE a OR b ORDER BY seq LIMIT 30""")
def capped_union(spark, sf):
    """References that any of two flags holds for, the first thirty."""
    rows = B.references(spark, sf).withColumn("a", F.col("target_id") % 4 == 0).withColumn("b", F.col("source_id") % 6 == 0)
    return sampling.capped(rows.where(sampling.any_of("a", "b")), 30).select("seq")


@query(f"WITH {B.PAIRS} SELECT count(*) AS candidates, 50 AS sampled FROM refs")
def sample_dispatch(spark, sf):
    """What each sampling mode reports; all take fifty."""
    rows = B.text_features(spark, sf)
    reports = [sampling.sample(rows, 50, mode)[1] for mode in sampling.MODES]
    return spark.createDataFrame([(r["candidates"], r["sampled"]) for r in reports], "candidates long, sampled long").distinct()


@query("""SELECT pair_uid, persona, place, coalesce(reason, 'kept') AS reason FROM (
    SELECT concat('p', doc_id) AS pair_uid, persona, place, CASE WHEN place = 1 AND doc_id % 2 = 0 THEN 'invalid' WHEN place = 2 AND doc_id % 3 = 0 THEN 'missing_tags' WHEN place = 3 THEN 'duplicate' WHEN place = 4 AND (doc_id % 2 <> 0 AND doc_id % 3 <> 0) THEN 'over_cap' END AS reason
    FROM documents, (SELECT unnest(['analyst', 'lawyer']) AS persona), (SELECT unnest([0, 1, 2, 3, 4]) AS place) WHERE doc_id % 7 <> 0)""")
def extract_questions(spark, sf):
    """Replies of five questions for two personas; every seventh reply is no JSON, an unknown persona is ignored."""
    d = F.col("doc_id").cast("string")
    tags = F.lit(" [#SRC:s] [#TGT:t]")
    qa = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))

    def block(who):
        ask = lambda n: F.concat(F.lit(f"{who} asks {n} of "), d, F.lit("?"))
        return F.array(qa(ask("first"), F.concat(F.lit("a"), tags)), qa(F.when(F.col("doc_id") % 2 == 0, " ").otherwise(ask("second")), F.concat(F.lit("b"), tags)), qa(ask("third"), F.when(F.col("doc_id") % 3 == 0, "no tags").otherwise(F.concat(F.lit("c"), tags))), qa(F.concat(ask("FIRST"), F.lit("  ")), F.concat(F.lit("d"), tags)), qa(ask("fifth"), F.concat(F.lit("e"), tags)))

    body = F.concat(F.lit("Here you are:\n"), F.to_json(F.struct(block("analyst").alias("analyst"), block("lawyer").alias("lawyer"), block("cook").alias("cook"))))
    rows = B.table(spark, sf, "documents").select(F.concat(F.lit("p"), d).alias("pair_uid"), F.lit("s").alias("source_uid"), F.lit("t").alias("target_uid"), F.when(F.col("doc_id") % 7 != 0, body).otherwise("sorry").alias("content"))
    out = replies.extract_questions(rows, ("analyst", "lawyer"), cap=3)
    return out.select("pair_uid", "persona", "place", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"""WITH {B.TURNS} SELECT item, CASE WHEN item % 4 = 0 THEN 'SCHEMA' WHEN item % 4 = 1 THEN 'DPEL' ELSE method END AS method, CASE WHEN item % 3 = 0 THEN 'unknown' ELSE persona END AS persona, CASE WHEN item % 5 = 0 THEN 's__t' WHEN item % 5 = 1 THEN NULL ELSE 'p' END AS pair_uid FROM turns""")
def inferred_fields(spark, sf):
    i = F.col("item")
    return B.turns(spark, sf).select("item", replies.method_of(F.when(i % 4 > 1, F.col("method")).otherwise(" "), F.when(i % 4 == 0, "hook")).alias("method"), replies.persona_of(F.when(i % 3 != 0, F.col("persona"))).alias("persona"), replies.pair_of(F.when(i % 5 > 1, " p "), F.when(i % 5 != 1, "s"), F.lit("t")).alias("pair_uid"))


@query(f"""WITH {B.TURNS}, w AS (SELECT method, len({WORDS.format("question")}) AS q, len({WORDS.format("answer")}) AS a FROM turns)
    SELECT coalesce(method, 'combined') AS method, count(*) AS n, round(avg(q), 1) AS question_mean, min(q) AS question_least, max(q) AS question_most, round(avg(a), 1) AS answer_mean, min(a) AS answer_least, max(a) AS answer_most FROM w GROUP BY ROLLUP (method)""")
def qa_word_stats(spark, sf):
    return statistics.qa_word_stats(B.turns(spark, sf))


@query(f"""WITH {B.PAIRS}, p AS (SELECT ref_type, len({WORDS.format("source_text")}) AS s, len({WORDS.format("target_text")}) AS t, target_id % 10 = 0 AS title FROM pairs)
    SELECT (SELECT count(DISTINCT source) FROM documents) AS documents, (SELECT count(*) FROM documents) AS passages, count(*) AS pairs, count(*) FILTER (ref_type = 'Internal') AS internal, count(*) FILTER (ref_type = 'External') AS external,
        round(100.0 * count(*) FILTER (ref_type = 'Internal') / count(*), 6) AS internal_pct, round(100.0 * count(*) FILTER (ref_type = 'External') / count(*), 6) AS external_pct, count(*) FILTER (title) AS title_targets,
        round(avg(s), 2) AS source_words, round(avg(t), 2) AS target_words, round(100.0 * count(*) FILTER (title) / count(*), 6) AS title_pct FROM p""")
def paper_table_corpus(spark, sf):
    words = B.passages(spark, sf).select("doc", F.size(T.words(F.col("text"))).alias("w"))
    pairs = B.references(spark, sf).join(words.select(F.col("doc").alias("source_id"), F.col("w").alias("source_words")), "source_id").join(words.select(F.col("doc").alias("target_id"), F.col("w").alias("target_words")), "target_id").withColumn("title_like", F.col("target_id") % 10 == 0)
    return statistics.corpus_table(B.passages(spark, sf).select(F.col("source").alias("doc_id")), pairs)


@query(f"""WITH {B.TURNS}, o AS (SELECT method, CASE WHEN item % 5 = 0 THEN 'empty' WHEN item % 7 = 0 THEN 'dupe' END AS reason FROM turns),
    d AS (SELECT method, string_agg(concat(reason, '=', n), '; ' ORDER BY n DESC, reason) AS dropped FROM (SELECT method, reason, count(*) AS n FROM o WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
    SELECT method, count(*) AS seen, count(*) FILTER (reason IS NULL) AS kept, round(100.0 * count(*) FILTER (reason IS NULL) / count(*), 2) AS kept_pct, coalesce(any_value(dropped), '') AS dropped FROM o LEFT JOIN d USING (method) GROUP BY method""")
def paper_table_yield(spark, sf):
    return statistics.yield_table(B.turns(spark, sf).select("method", F.when(F.col("item") % 5 == 0, "empty").when(F.col("item") % 7 == 0, "dupe").alias("reason")))


@query(f"""WITH {B.TURNS} SELECT method, count(*) AS items, round(100.0 * count(*) FILTER (item % 3 = 0) / count(*), 2) AS both_tags_pct, round(100.0 * count(*) FILTER (item % 4 = 0) / count(*), 2) AS question_cites_pct, round(100.0 * count(*) FILTER (item % 5 = 0) / count(*), 2) AS answer_cites_pct FROM turns GROUP BY 1""")
def paper_table_quality(spark, sf):
    i = F.col("item")
    return statistics.quality_table(B.turns(spark, sf).select("method", (i % 3 == 0).alias("both_tags"), (i % 4 == 0).alias("question_cites"), (i % 5 == 0).alias("answer_cites")))


@query(f"""WITH {B.TURNS}, r AS (SELECT method, item % 6 = 0 AS leaks, CASE WHEN item % 2 = 0 THEN item % 4 = 0 END AS judged, CASE WHEN item % 4 = 0 AND method = 'direct' THEN item % 8 = 0 END AS answered FROM turns)
    SELECT coalesce(method, 'all') AS method, count(*) AS n, count(*) FILTER (leaks) AS n_leaks, round(count(*) FILTER (leaks) / count(*), 4) AS leak_rate, count(*) FILTER (judged) AS judge_passed, CASE WHEN count(judged) > 0 THEN round(count(*) FILTER (judged) / count(judged), 4) END AS judge_rate,
        count(*) FILTER (answered) AS answer_passed, CASE WHEN count(answered) > 0 THEN round(count(*) FILTER (answered) / count(answered), 4) END AS answer_rate FROM r GROUP BY ROLLUP (method)""")
def pilot_rates(spark, sf):
    i = F.col("item")
    rows = B.turns(spark, sf).select("method", (i % 6 == 0).alias("leaks"), F.when(i % 2 == 0, i % 4 == 0).alias("judged"), F.when((i % 4 == 0) & (F.col("method") == "direct"), i % 8 == 0).alias("answered"))
    return statistics.pilot_rates(rows)


_TARGETS = "CASE doc_id % 6 WHEN 0 THEN 'Parts and more of them.' WHEN 1 THEN '' WHEN 2 THEN 'Policy statement 3 on this' WHEN 3 THEN 'ABC DEF' WHEN 4 THEN 'a plain sentence.' ELSE 'Supervisory Statements' END"


@query(rf"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, '(?i)^legal instruments that change this part\b') THEN '^legal instruments that change this part\b' WHEN regexp_matches(t, '(?i)^parts?\b') THEN '^parts?\b'
    WHEN regexp_matches(t, '(?i)^policy statements?\b') THEN '^policy statements?\b' WHEN regexp_matches(t, '(?i)^supervisory statements?\b') THEN '^supervisory statements?\b' WHEN NOT regexp_matches(t, '[.;:!?]') AND length(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')) < 3 THEN 'titlecase_no_punct' END AS reason
    FROM (SELECT {_TARGETS} AS t FROM documents)) WHERE reason IS NOT NULL GROUP BY 1""")
def navigation_reasons(spark, sf):
    options = F.array(*map(F.lit, ("Parts and more of them.", "", "Policy statement 3 on this", "ABC DEF", "a plain sentence.", "Supervisory Statements")))
    rows = B.table(spark, sf, "documents").select(T.navigation_reason(F.element_at(options, (F.col("doc_id") % 6 + 1).cast("int"))).alias("reason"))
    return statistics.reason_counts(rows)


@query(f"""WITH {B.PAIRS}, t AS (SELECT CASE WHEN target_id % 8 = 0 THEN '' WHEN target_id % 8 = 1 THEN concat('d', target_id) ELSE concat('d', target_id % 50, '::p', lpad(CAST(target_id % 4 AS VARCHAR), 6, '0')) END AS id FROM refs)
    SELECT count(*) AS rows, count(DISTINCT nullif(id, '')) AS targets, count(DISTINCT nullif(regexp_extract(id, '::p([0-9]{{6}})$', 1), '')) AS suffixes, count(*) FILTER (id LIKE '%::p000001') AS to_first FROM t""")
def target_report(spark, sf):
    t = F.col("target_id")
    numbered = F.concat(F.lit("d"), (t % 50).cast("string"), F.lit("::p"), F.lpad((t % 4).cast("string"), 6, "0"))
    return statistics.target_report(B.references(spark, sf).select(F.when(t % 8 == 0, "").when(t % 8 == 1, F.concat(F.lit("d"), t.cast("string"))).otherwise(numbered).alias("target_id")))


@query("""SELECT doc_id AS passage_uid, length(text) AS chars, concat('doc_', source) AS doc, 'rules' AS source_tag, 0 AS n_refs FROM documents""")
def canonical_passages(spark, sf):
    raw = B.table(spark, sf, "documents").select(F.col("doc_id").alias("pid"), "text", F.col("source").alias("document_id"), F.col("doc_id").alias("passage_id"))
    out = layout.canonical_passages(raw, "doc_", "rules")
    return out.select("passage_uid", F.length("passage").alias("chars"), F.col("doc_id").alias("doc"), "source_tag", F.size("refs").alias("n_refs"))


@query(f"""WITH {B.PAIRS} SELECT CAST(source_id AS VARCHAR) AS "SourceID", CAST(target_id AS VARCHAR) AS "TargetID", NULL AS "ReferenceText", CASE WHEN source_id % 4 = 0 THEN 'External' ELSE 'Internal' END AS "ReferenceType", '' AS "SourcePassage" FROM refs""")
def canonical_references(spark, sf):
    raw = B.references(spark, sf).select(F.col("source_id").alias("sourceid"), F.col("target_id").alias("TargetID"), F.col("ref_type").alias("ReferenceType"), F.lit(1).alias("other"))
    return layout.canonical_references(raw).select("SourceID", "TargetID", F.col("ReferenceText"), "ReferenceType", "SourcePassage")


@query("""SELECT DISTINCT concat('https://rules.example', CASE WHEN page_id % 2 = 0 THEN '/pra-rules/' ELSE '/guidance/' END, 'r', page_id % 40, '/01-02-2024') AS url FROM pages WHERE page_id % 5 <> 0 AND page_id % 40 % 3 <> 0""")
def discovered_pages(spark, sf):
    """Links of all pages to dated pages of two sections, those fetched already left out."""
    p = F.col("page_id")
    pages = B.table(spark, sf, "pages").select("page_id")
    good = F.concat(F.lit("https://rules.example"), F.when(p % 2 == 0, "/pra-rules/").otherwise("/guidance/"), F.lit("r"), (p % 40).cast("string"), F.lit("/01-02-2024"))
    href = F.when(p % 5 == 0, "https://elsewhere.example/guidance/x/01-02-2024").otherwise(F.concat(good, F.lit("?q=1#top")))
    dated = pages.select("page_id", F.regexp_replace(href, r"[?#].*$", "").alias("absolute"))
    found = layout.discovered(pages, dated, "rules.example", ("pra-rules", "guidance"))
    log = pages.where(p % 40 % 3 == 0).select(good.alias("url"), F.lit(True).alias("ok"))
    return layout.to_fetch(found, log)


@query(r"""SELECT doc_id AS doc, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s?]', ' ', 'g'), '\s+', ' ', 'g')) AS unicode_key, regexp_replace(regexp_replace(trim(lower(text)), '[^a-z0-9\s?]', ' ', 'g'), '\s+', ' ', 'g') AS ascii_key FROM
    (SELECT doc_id, concat('What''s (rule) 4.', doc_id % 9, ' – é? ', doc_id % 4, '!') AS text FROM documents)""")
def question_keys(spark, sf):
    d = F.col("doc_id")
    text = F.concat(F.lit("What's (rule) 4."), (d % 9).cast("string"), F.lit(" – é? "), (d % 4).cast("string"), F.lit("!"))
    return B.table(spark, sf, "documents").select(d.alias("doc"), T.question_key_unicode(text).alias("unicode_key"), T.question_key_ascii(text).alias("ascii_key"))
