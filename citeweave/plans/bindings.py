"""How the driver's tables stand in for passages, cross-references, runs, verdicts and annotations.

Every derivation is arithmetic on keys, so the SQL twins repeat it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source", "text")


def references(spark, sf) -> DataFrame:
    """(seq, source_id, target_id, ref_type): one or two references of each document."""
    docs = table(spark, sf, "documents").select("doc_id")
    n = docs.agg(F.count("*")).scalar()
    one = docs.select((F.col("doc_id") * 2).alias("seq"), F.col("doc_id").alias("source_id"), ((F.col("doc_id") * 7 + 13) % n).alias("target_id"))
    two = docs.where("doc_id % 3 = 0").select((F.col("doc_id") * 2 + 1).alias("seq"), F.col("doc_id").alias("source_id"), ((F.col("doc_id") * 11 + 5) % n).alias("target_id"))
    return one.unionByName(two).withColumn("ref_type", F.when(F.col("source_id") % 4 == 0, "External").otherwise("Internal"))


def pairs(spark, sf) -> DataFrame:
    """References with both texts; the reference text is the target's first three words."""
    docs = table(spark, sf, "documents")
    side = lambda p: docs.select(F.col("doc_id").alias(f"{p}_id"), F.col("text").alias(f"{p}_text"), F.col("source").alias(f"{p}_doc"))
    rows = references(spark, sf).join(side("source"), "source_id").join(side("target"), "target_id")
    return rows.withColumn("ref_text", F.array_join(F.slice(F.split("target_text", " "), 1, 3), " "))


PAIRS = """
    n AS (SELECT count(*) AS n FROM documents),
    refs AS (
        SELECT doc_id * 2 AS seq, doc_id AS source_id, (doc_id * 7 + 13) % n AS target_id FROM documents, n
        UNION ALL SELECT doc_id * 2 + 1, doc_id, (doc_id * 11 + 5) % n FROM documents, n WHERE doc_id % 3 = 0
    ),
    pairs AS (
        SELECT seq, source_id, target_id, CASE WHEN source_id % 4 = 0 THEN 'External' ELSE 'Internal' END AS ref_type,
               s.text AS source_text, s.source AS source_doc, t.text AS target_text, t.source AS target_doc,
               array_to_string(list_slice(string_split(t.text, ' '), 1, 3), ' ') AS ref_text
        FROM refs JOIN documents s ON s.doc_id = source_id JOIN documents t ON t.doc_id = target_id
    )"""


def regulated(spark, sf) -> DataFrame:
    """(doc, text): every fifth document begins with a rule, so that rule and citation operators find something."""
    d = F.col("doc_id")
    rule = F.concat(F.lit("Rule "), (d % 9).cast("string"), F.lit("."), (d % 7).cast("string"), F.lit(" applies. A firm must not act unless it is required to notify within 30 days under Section "), (d % 11).cast("string"), F.lit(". "), F.col("text"))
    return table(spark, sf, "documents").select(d.alias("doc"), F.when(d % 5 == 0, rule).otherwise(F.col("text")).alias("text"))


REGULATED = """
    regulated AS (
        SELECT doc_id AS doc, CASE WHEN doc_id % 5 = 0 THEN concat('Rule ', doc_id % 9, '.', doc_id % 7,
            ' applies. A firm must not act unless it is required to notify within 30 days under Section ', doc_id % 11, '. ', text) ELSE text END AS text
        FROM documents
    )"""


def runs(spark, sf) -> DataFrame:
    """(run, qid, doc, score): three runs over orders, from line items."""
    lines = table(spark, sf, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("run"), F.col("l_orderkey").alias("qid"), F.col("l_partkey").alias("doc")).agg(F.max("l_extendedprice").alias("score"))


RUNS = """
    runs AS (SELECT l_returnflag AS run, l_orderkey AS qid, l_partkey AS doc, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc) AS rank FROM runs)"""


def gold(spark, sf) -> DataFrame:
    """(qid, src, tgt): a source and a target document of each order."""
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qid")).join(parts, "qid", "left")
    q = F.col("qid")
    src = F.col("a") - F.when(q % 5 == 0, 1).otherwise(0)
    tgt = F.col("b") + F.when(q % 3 == 0, 1).otherwise(0)
    return rows.select("qid", F.coalesce(src, F.lit(-1)).alias("src"), F.coalesce(tgt, F.lit(-2)).alias("tgt"))


GOLD = """
    gold AS (
        SELECT o_orderkey AS qid, coalesce(a - CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END, -1) AS src,
               coalesce(b + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, -2) AS tgt
        FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    )"""


def verdicts(spark, sf) -> DataFrame:
    """(item, pass_no, decision, reason, confidence): events as passes of users."""
    e = table(spark, sf, "events")
    ok = F.col("event_type").isin("click", "view", "purchase")
    return e.select(F.col("user_id").alias("item"), F.col("event_id").alias("pass_no"), F.when(ok, "PASS").otherwise("DROP").alias("decision"), F.when(~ok, F.col("event_type")).alias("reason"), F.least(F.lit(1.0), F.col("value") / 490.02).alias("confidence"))


VERDICTS = """
    verdicts AS (
        SELECT user_id AS item, event_id AS pass_no, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'PASS' ELSE 'DROP' END AS decision,
               CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN event_type END AS reason, least(1.0, value / 490.02) AS confidence
        FROM events
    )"""


def annotations(spark, sf) -> DataFrame:
    """(item, criterion, annotator, label): both label columns as two annotators of one criterion by the document's rest."""
    lab = table(spark, sf, "labels")
    each = lambda c, who: lab.select(F.col("doc_id").alias("item"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("criterion"), F.lit(who).alias("annotator"), (F.col(c) == 1).alias("label"))
    return each("quality", "a").unionByName(each("toxic", "b"))


ANNOTATIONS = """
    annotations AS (
        SELECT doc_id AS item, concat('c', doc_id % 3) AS criterion, 'a' AS annotator, quality = 1 AS label FROM labels
        UNION ALL SELECT doc_id, concat('c', doc_id % 3), 'b', toxic = 1 FROM labels
    )"""


def turns(spark, sf) -> DataFrame:
    """(item, question, answer, method): user turns with the reply that follows."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    rows = user.groupBy("conv_id", "turn").agg(F.min("question").alias("question")).join(reply.groupBy("conv_id", "turn").agg(F.min("answer").alias("answer")), ["conv_id", "turn"])
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("item"), "question", "answer", F.when(F.col("conv_id") % 2 == 0, "direct").otherwise("schema").alias("method"), F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("persona"))


TURNS = """
    turns AS (
        SELECT u.conv_id * 1000 + u.turn AS item, question, answer, CASE WHEN u.conv_id % 2 = 0 THEN 'direct' ELSE 'schema' END AS method,
               concat('p', u.conv_id % 3) AS persona
        FROM (SELECT conv_id, turn, min(text) AS question FROM conversations WHERE role = 'user' GROUP BY 1, 2) u
        JOIN (SELECT conv_id, turn - 1 AS turn, min(text) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1, 2) a
          ON u.conv_id = a.conv_id AND u.turn = a.turn
    )"""


def text_run(spark, sf, k: int = 20) -> DataFrame:
    """BM25 results of the benchmark's passages over all documents."""
    from citeweave.operators import retrieval

    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25(passages(spark, sf), queries, k)


BM25 = """
    words AS (SELECT doc_id AS doc, list_filter(string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents),
    tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM words) GROUP BY 1, 2),
    dl AS (SELECT doc, len(w) AS dl FROM words WHERE len(w) > 0),
    size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, size GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT item_id AS qid, term, count(*) AS times FROM (
        SELECT item_id, unnest(list_filter(string_split_regex(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) AS term FROM benchmark) GROUP BY 1, 2),
    scored AS (SELECT qid, doc, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM tf JOIN asked USING (term) JOIN idf USING (term) JOIN dl USING (doc), size GROUP BY 1, 2),
    text_run AS (SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM scored) WHERE rank <= 20)"""


def edges(spark, sf) -> DataFrame:
    """Distinct reference edges without loops, with both documents; no text is read for them."""
    docs = table(spark, sf, "documents")
    side = lambda end: docs.select(F.col("doc_id").alias(end), F.col("source").alias(f"{end}_doc"))
    refs = references(spark, sf).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).where("src <> dst").distinct()
    return refs.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", "src_doc", "dst_doc")


EDGES = PAIRS + """,
    edges AS (SELECT DISTINCT source_id AS src, target_id AS dst, source_doc AS src_doc, target_doc AS dst_doc FROM pairs WHERE source_id <> target_id)"""


def text_gold(spark, sf) -> DataFrame:
    """(qid, src, tgt) of the benchmark's items over the documents."""
    n = table(spark, sf, "documents").agg(F.count("*")).scalar()
    src = (F.col("item_id") * 97) % n
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), src.alias("src"), ((src * 7 + 13) % n).alias("tgt"))


TEXT_GOLD = """
    text_gold AS (SELECT item_id AS qid, (item_id * 97) % n AS src, ((item_id * 97) % n * 7 + 13) % n AS tgt FROM benchmark, (SELECT count(*) AS n FROM documents))"""


def dense_run(spark, sf, k: int = 20) -> DataFrame:
    """Cosine results over the embeddings as passages of the same number; an item asks with the vector of thrice its number."""
    from citeweave.operators import retrieval

    vectors = table(spark, sf, "embeddings")
    n = vectors.agg(F.count("*")).scalar()
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), ((F.col("item_id") * 3) % n).alias("vec_id"))
    queries = asked.join(vectors, "vec_id").select("qid", F.col("embedding").alias("vector"))
    return retrieval.dense_topk(vectors.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), queries, k)


DENSE = """
    dense_run AS (SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (
        SELECT item_id AS qid, p.vec_id AS doc, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score
        FROM benchmark JOIN embeddings q ON q.vec_id = (item_id * 3) % (SELECT count(*) FROM embeddings), embeddings p)) WHERE rank <= 20)"""


def text_features(spark, sf) -> DataFrame:
    """References with their features; texts are read once for each document, never for each reference.

    The features are written, for samples read them several times.
    """
    from citeweave.operators import tables, xrefs

    refs = references(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("origin"))
    of_docs = xrefs.document_features(docs)
    first = docs.select(F.col("doc").alias("target_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("ref_text"))
    return tables.written(xrefs.features_of_references(refs.join(first, "target_id"), of_docs, docs), "features")[0]
