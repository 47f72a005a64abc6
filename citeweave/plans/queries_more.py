"""Registered queries of spans, tags, deduplication, metrics over answered queries, and page links."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.operators import curation, html, retrieval, statistics, xrefs
from citeweave.plans import bindings as B
from citeweave.plans.queries import query


@query(f"""WITH {B.PAIRS}, c AS (SELECT seq, source_id % 100 AS s, CASE WHEN target_id % 9 = 0 THEN -1 ELSE target_id % 100 END AS t FROM refs)
    SELECT seq FROM (SELECT seq, s, t, min(seq) OVER (PARTITION BY s, t) AS first FROM c) WHERE t <> -1 AND s <> t AND seq = first ORDER BY seq LIMIT 40""")
def xref_clean_topk(spark, sf):
    """The first forty references that cleaning keeps."""
    refs = B.references(spark, sf).select("seq", (F.col("source_id") % 100).alias("source_id"), F.when(F.col("target_id") % 9 == 0, -1).otherwise(F.col("target_id") % 100).alias("target_id"))
    return xrefs.kept_references(refs, spark.range(100).select(F.col("id").alias("uid")), top_k=40).select("seq")


@query(f"WITH {B.PAIRS} SELECT s AS source_id, arg_max(t, seq) AS target_id, max(seq) AS seq FROM (SELECT source_id % 70 AS s, target_id AS t, seq FROM refs) GROUP BY 1")
def last_wins_dedup(spark, sf):
    return statistics.last_wins(B.references(spark, sf).select((F.col("source_id") % 70).alias("source_id"), "target_id", "seq"), ["source_id"], "seq")


@query(f"""WITH {B.PAIRS}, r AS (SELECT CASE WHEN source_id % 5 = 0 THEN '' ELSE CAST(source_id % 70 AS VARCHAR) END AS s, CAST(target_id % 9 AS VARCHAR) AS t, seq FROM refs)
    SELECT s, t, seq FROM r WHERE s = '' UNION ALL SELECT s, t, min(seq) FROM r WHERE s <> '' GROUP BY 1, 2""")
def named_dedup(spark, sf):
    """References without one id are never taken for repeats."""
    rows = B.references(spark, sf).select(F.when(F.col("source_id") % 5 == 0, "").otherwise((F.col("source_id") % 70).cast("string")).alias("s"), (F.col("target_id") % 9).cast("string").alias("t"), "seq")
    return statistics.first_wins_of_named(rows, ["s", "t"], "seq")


@query(f"""WITH {B.BM25}, {B.TEXT_GOLD}, best AS (SELECT qid, min(doc) AS doc FROM text_run WHERE rank = 1 GROUP BY 1), top AS (SELECT qid, list(doc) AS docs FROM text_run WHERE rank <= 5 GROUP BY 1)
    SELECT qid, 2 * CAST(list_contains(docs, best.doc) AS INT) + CAST(list_contains(docs, src) AS INT) + CAST(list_contains(docs, tgt) AS INT) AS n_in_top FROM text_gold JOIN top USING (qid) JOIN best USING (qid)""")
def answer_tags_in_top(spark, sf):
    """Answers that cite the best passage found, twice, and the gold pair; how many of the tags name one of the first five."""
    run, gold = B.text_run(spark, sf).where("rank <= 5"), B.text_gold(spark, sf)
    found = run.groupBy("qid").agg(F.collect_list(F.col("doc").cast("string")).alias("docs"), F.min(F.when(F.col("rank") == 1, F.col("doc"))).alias("best"))
    answer = F.concat(F.lit("It must [#SRC:"), "src", F.lit("] be so [#ID: "), "best", F.lit(" ], see [#TGT:"), "tgt", F.lit("] [#ID:"), "best", F.lit("]."))
    return gold.join(found, "qid").select("qid", curation.tags_in(answer, F.col("docs")).alias("n_in_top"))


@query("""SELECT doc_id AS item, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'TERM:Firms|FREEFORM:must' WHEN doc_id % 3 = 1 THEN 'FREEFORM:must' ELSE concat('FREEFORM:Firms must report ', doc_id, '.') END AS spans FROM documents""")
def coerced_spans(spark, sf):
    """Two valid spans, one of an unknown kind, none valid (the core clause stands in), and titles without any."""
    d = F.col("doc_id")
    text = F.concat(F.lit("Firms must report "), d.cast("string"), F.lit(". Then more."))
    span = lambda a, b, t, k: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"), F.lit(k).alias("type"))
    two = F.array(span(0, 5, "Firms", "TERM"), span(6, 10, "must", "FREEFORM"), span(0, 5, "firms", "TERM"))
    spans = F.when(d % 3 == 0, two).when(d % 3 == 1, F.array(span(6, 10, "must", "ODD"), span(9, 4, "x", "TERM"))).otherwise(F.array(span(0, 900, "Firms", "TERM")))
    out = curation.coerced_spans(spans, text, d % 5 == 0)
    return B.table(spark, sf, "documents").select(d.alias("item"), F.array_join(F.transform(out, lambda s: F.concat(s["type"], F.lit(":"), s["text"])), "|").alias("spans"))


@query(f"""WITH {B.TURNS}, r AS (SELECT method, CASE item % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' WHEN 2 THEN 'contradiction' END AS label, CASE WHEN item % 3 <> 0 THEN (item % 10) / 10.0 END AS score FROM turns)
    SELECT method, label, count(*) AS n, round(avg(score), 6) AS mean_score, round(count(*) / any_value(total), 6) AS share FROM r JOIN (SELECT method, count(*) AS total FROM r GROUP BY 1) USING (method) WHERE label IS NOT NULL GROUP BY 1, 2""")
def answer_labels(spark, sf):
    i = F.col("item")
    rows = B.turns(spark, sf).select("method", F.when(i % 4 == 0, "entailment").when(i % 4 == 1, "neutral").when(i % 4 == 2, "contradiction").alias("label"), F.when(i % 3 != 0, (i % 10) / 10.0).alias("score"))
    return statistics.label_distribution(rows, ["method"], "label", "score")


@query(f"""WITH {B.TURNS} SELECT coalesce(method, 'all') AS method, count(*) AS n, round(avg(CAST(item % 3 <> 0 AS INT)), 6) AS both_tags, round(avg(CAST(item % 4 = 0 AS INT)), 6) AS question_cites, round(avg(CAST(item % 5 = 0 AS INT)), 6) AS answer_cites, round(avg(CAST(item % 4 = 0 AS INT)), 6) AS leaks FROM turns GROUP BY ROLLUP (method)""")
def generation_rates(spark, sf):
    """Both tags in two of three answers, a section in every fourth question and a rule in every fifth answer."""
    i = F.col("item")
    question = F.when(i % 4 == 0, "What does Section 12 ask?").otherwise("What is asked here?")
    answer = F.concat(F.when(i % 5 == 0, "By Rule 4.2.1 that. ").otherwise("That. "), F.when(i % 3 != 0, "[#SRC:s] [#TGT:t]").otherwise("[#SRC:s]"))
    rows = B.turns(spark, sf).select("method", question.alias("question"), answer.alias("answer"), F.lit("s").alias("source_uid"), F.lit("t").alias("target_uid"))
    return statistics.generation_rates(rows, ["method"]).withColumn("method", F.coalesce("method", F.lit("all")))


@query(f"""WITH {B.RUNS}, {B.GOLD}, rel AS (SELECT DISTINCT qid, doc FROM (SELECT qid, src AS doc FROM gold UNION ALL SELECT qid, tgt FROM gold)), total AS (SELECT qid, count(*) AS r FROM rel GROUP BY 1),
    top AS (SELECT run, qid, doc, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc DESC) AS rank FROM runs),
    hits AS (SELECT run, qid, rank, row_number() OVER (PARTITION BY run, qid ORDER BY rank) AS nth FROM top JOIN rel USING (qid, doc) WHERE rank <= 3),
    each AS (SELECT run, qid, count(*) AS found, sum(nth / rank) AS precisions, sum(1.0 / log2(rank + 1)) AS gain FROM hits GROUP BY 1, 2)
    SELECT run, count(*) AS n_queries, round(avg(coalesce(found, 0) / r), 6) AS recall, round(avg(coalesce(precisions, 0) / r), 6) AS map,
        round(avg(coalesce(gain, 0) / CASE r WHEN 1 THEN 1.0 ELSE 1.0 + 1.0 / log2(3) END), 6) AS ndcg, round(avg(coalesce(found, 0) / 3.0), 6) AS precision
    FROM (SELECT DISTINCT run, qid FROM runs) JOIN total USING (qid) LEFT JOIN each USING (run, qid) GROUP BY run""")
def ir_metrics_answered(spark, sf):
    """Means over the queries a run answers, ties by falling document."""
    return retrieval.metrics(B.runs(spark, sf), retrieval.qrels(B.gold(spark, sf)), 3, all_queries=False, descending_ties=True)


def _marked_pages(spark, sf):
    """Each page's number in small marked-up pages: two paragraphs in the content, one link each, and furniture around them."""
    p = F.col("page_id").cast("string")
    body = F.concat(F.lit("<nav><p>Skip all of this navigation text here</p></nav><main><h2>Chapter "), p, F.lit("</h2><p id='a'>First paragraph of page number "), p, F.lit(" with a <a href='../x/"), p, F.lit("#s'>link "), p, F.lit("</a></p><div class='cookie'><p>We use some cookies on all of these pages</p></div><ul><li>Second block of page number "), p, F.lit(" and <a href='#a'>back</a></li></ul><p>short</p></main>"))
    return B.table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://h.example/d/"), p).alias("url"), body.alias("html"))


@query("""SELECT page_id, position, tag, anchor, concat('Chapter ', page_id) AS headings, text FROM (
    SELECT page_id, 0 AS position, 'p' AS tag, 'a' AS anchor, concat('First paragraph of page number ', page_id, ' with a link ', page_id) AS text FROM pages
    UNION ALL SELECT page_id, 1, 'li', 'p000001', concat('Second block of page number ', page_id, ' and back') FROM pages)""")
def html_blocks(spark, sf):
    return html.passages(_marked_pages(spark, sf)).select("page_id", "position", "tag", "anchor", F.array_join("headings", " > ").alias("headings"), "text")


@query("""SELECT page_id, 0 AS position, concat('../x/', page_id, '#s') AS href, concat('https://h.example/x/', page_id, '#s') AS absolute, concat('link ', page_id) AS text FROM pages
    UNION ALL SELECT page_id, 1, '#a', concat('https://h.example/d/', page_id, '#a'), 'back' FROM pages""")
def html_block_links(spark, sf):
    return html.links(_marked_pages(spark, sf))
