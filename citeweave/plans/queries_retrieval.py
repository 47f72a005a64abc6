"""Registered queries of the retrieval step as a whole: seven runs, reranking, diagnostics and votes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeweave.operators import kept_index, retrieval
from citeweave.plans import bindings as B
from citeweave.operators.tables import shared_root
from citeweave.plans.queries import TOKENS, query

_QRELS = "wanted AS (SELECT DISTINCT qid, doc FROM (SELECT qid, src AS doc FROM text_gold UNION ALL SELECT qid, tgt FROM text_gold))"
_NEAR = "near AS (SELECT src AS seed, dst AS doc FROM edges UNION SELECT dst, src FROM edges)"


def _queries(spark, sf):
    return B.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(f"""WITH {B.EDGES}, {B.BM25}, {B.TEXT_GOLD}, {_QRELS}, {_NEAR}, seeds AS (SELECT qid, doc AS seed, rank FROM text_run WHERE rank <= 10),
    reached AS (SELECT qid, near.doc, min(rank) AS by_rank FROM seeds JOIN near USING (seed) GROUP BY 1, 2),
    added AS (SELECT r.qid, r.doc FROM reached r LEFT JOIN seeds s ON s.qid = r.qid AND s.seed = r.doc WHERE s.rank IS NULL OR s.rank > by_rank),
    every AS (SELECT qid, doc, max(score) AS score FROM (SELECT qid, doc, score FROM text_run WHERE rank <= 10
        UNION ALL SELECT t.qid, near.doc, t.score * 0.8 FROM text_run t JOIN near ON near.seed = t.doc WHERE t.rank <= 10) GROUP BY 1, 2),
    final AS (SELECT qid, doc FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM every) WHERE rank <= 20)
    SELECT q.qid, q.n AS n_seeds, (SELECT count(*) FROM added a WHERE a.qid = q.qid) AS n_added,
        (SELECT count(*) FROM seeds s JOIN wanted w ON w.qid = s.qid AND w.doc = s.seed WHERE s.qid = q.qid) AS gold_in_seeds,
        (SELECT count(*) FROM added a JOIN wanted w USING (qid, doc) WHERE a.qid = q.qid) AS gold_added,
        (SELECT count(*) FROM final f JOIN wanted w USING (qid, doc) WHERE f.qid = q.qid) AS gold_in_final
    FROM (SELECT qid, count(*) AS n FROM seeds GROUP BY 1) q""")
def xref_expand_diagnostics(spark, sf):
    gold = retrieval.qrels(B.text_gold(spark, sf))
    run, _ = retrieval.written(B.text_run(spark, sf), "run")
    return retrieval.expansion_diagnostics(run, B.edges(spark, sf), gold, seed_k=10)


@query(f"WITH {B.BM25} SELECT qid, doc, round(score, 6) AS score, rank FROM text_run")
def bm25_kept_index(spark, sf):
    """The benchmark's passages searched in a kept index of blocks, in two generations, with block maxima."""
    docs = B.passages(spark, sf)
    path = f"{shared_root(spark)}/citeweave/index-{uuid.uuid4().hex}"
    first = F.crc32(F.col("doc").cast("string")) % 4 > 0
    index = kept_index.build(docs.where(first), path).append(docs.where(~first))
    return index.search(_queries(spark, sf), 20).select("qid", "doc", "score", "rank")


_WORKFLOW = f"""{B.EDGES}, {B.BM25}, {B.DENSE}, {B.TEXT_GOLD}, {_QRELS}, {_NEAR},
    two AS (SELECT 'bm25' AS run, qid, doc, score, rank FROM text_run UNION ALL SELECT 'dense', qid, doc, score, rank FROM dense_run),
    shared AS (SELECT qid FROM two GROUP BY 1 HAVING count(DISTINCT run) = 2),
    fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM (SELECT qid, doc, sum(1.0 / (60 + rank)) AS score FROM two SEMI JOIN shared USING (qid) GROUP BY 1, 2)),
    base AS (SELECT * FROM two UNION ALL SELECT 'rrf_bm25_dense', qid, doc, score, rank FROM fused),
    wide AS (SELECT run, qid, doc, max(score) AS score FROM (SELECT run, qid, doc, score FROM base WHERE rank <= 20
        UNION ALL SELECT run, qid, near.doc, score * 0.8 FROM base JOIN near ON near.seed = base.doc WHERE rank <= 20) GROUP BY 1, 2, 3),
    expanded AS (SELECT replace(run, 'rrf_bm25_dense', 'rrf') || '_xref_expand' AS run, qid, doc, score, row_number() OVER (PARTITION BY run, qid ORDER BY score DESC, doc) AS rank FROM wide),
    candidates AS (SELECT DISTINCT qid, doc FROM two SEMI JOIN shared USING (qid) WHERE rank <= 200),
    ce AS (SELECT qid, doc, len(list_intersect(q, p)) / greatest(1, len(q)) AS score FROM (
        SELECT qid, doc, {TOKENS.format("b.text")} AS q, {TOKENS.format("d.text")} AS p FROM candidates JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = doc)),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM ce),
    wf AS (SELECT * FROM base UNION ALL SELECT * FROM expanded WHERE rank <= 20 UNION ALL SELECT 'ce_rerank_union', * FROM reranked WHERE rank <= 20)"""


def _workflow(spark, sf):
    return retrieval.workflow(B.text_run(spark, sf), B.dense_run(spark, sf), B.edges(spark, sf), _queries(spark, sf), B.passages(spark, sf), B.text_gold(spark, sf))


@query(f"WITH {_WORKFLOW} SELECT qid, doc, round(score, 6) AS score, rank FROM reranked WHERE rank <= 20")
def ce_rerank_standin(spark, sf):
    """The candidates of both searches, reranked by the stand-in."""
    return _workflow(spark, sf)["runs"].where("run = 'ce_rerank_union'").select("qid", "doc", "score", "rank")


@query(f"""WITH {_WORKFLOW}, first_ten AS (SELECT qid FROM candidates GROUP BY 1 ORDER BY 1 LIMIT 10)
    SELECT a.qid, g.src, g.tgt, coalesce(bool_or(c.doc = g.src), false) AS source_in_union, coalesce(bool_or(c.doc = g.tgt), false) AS target_in_union, count(DISTINCT c.doc) AS n_candidates,
        (SELECT string_agg(doc, ',' ORDER BY rank) FROM reranked r WHERE r.qid = a.qid AND rank <= 10) AS top_docs,
        (SELECT min(rank) FROM reranked r WHERE r.qid = a.qid AND r.doc = g.src AND rank <= 20) AS source_rank, (SELECT min(rank) FROM reranked r WHERE r.qid = a.qid AND r.doc = g.tgt AND rank <= 20) AS target_rank
    FROM first_ten a JOIN text_gold g USING (qid) JOIN candidates c USING (qid) GROUP BY a.qid, g.src, g.tgt""")
def ce_rerank_debug(spark, sf):
    """Where the gold pairs of ten queries stand before and after reranking."""
    out = _workflow(spark, sf)["rerank_debug"]
    return out.select("qid", "src", "tgt", "source_in_union", "target_in_union", "n_candidates", F.array_join(F.transform("top_docs", lambda d: d.cast("string")), ",").alias("top_docs"), "source_rank", "target_rank")


@query(f"""WITH {_WORKFLOW}, per AS (SELECT g.qid, run, bool_or(doc = src) AS s, bool_or(doc = tgt) AS t FROM wf JOIN text_gold g USING (qid) WHERE doc = src OR doc = tgt GROUP BY 1, 2),
    counted AS (SELECT g.qid, count(*) FILTER (s) AS source_votes, count(*) FILTER (t) AS target_votes, count(*) FILTER (s AND t) AS both_votes FROM text_gold g LEFT JOIN per USING (qid) GROUP BY 1)
    SELECT *, 7 AS n_runs, CASE WHEN source_votes >= 4 AND target_votes >= 4 THEN 'KEEP' WHEN source_votes = 3 OR target_votes = 3 THEN 'JUDGE' ELSE 'DROP' END AS decision FROM counted""")
def retrieval_votes(spark, sf):
    """Votes of the seven runs and what they decide."""
    return _workflow(spark, sf)["votes"].select("qid", "source_votes", "target_votes", "both_votes", "n_runs", "decision")


_RANKS = """found AS (SELECT run, qid, min(rank) FILTER (doc = src) AS s, min(rank) FILTER (doc = tgt) AS t FROM wf JOIN text_gold USING (qid) WHERE doc = src OR doc = tgt GROUP BY 1, 2),
    names AS (SELECT DISTINCT run FROM wf),
    diag AS (SELECT run, qid, CASE WHEN s <= 10 AND t <= 10 THEN 'both' WHEN s <= 10 THEN 'src_only' WHEN t <= 10 THEN 'tgt_only' ELSE 'neither' END AS outcome,
        coalesce(1.0 / CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN greatest(s, t) END, 0.0) AS rr FROM text_gold CROSS JOIN names LEFT JOIN found USING (run, qid))"""


@query(f"""WITH {_WORKFLOW}, {_RANKS} SELECT run, count(*) AS n_queries, {", ".join(f"round(avg(CAST(outcome = '{o}' AS INT)), 6) AS {o}" for o in ("both", "src_only", "tgt_only", "neither"))}, round(avg(rr), 6) AS pair_mrr FROM diag GROUP BY run""")
def retrieval_pipeline(spark, sf):
    """Both searches, their fusion, three graph expansions and the reranked union over all documents, judged as pairs at 10."""
    runs = _workflow(spark, sf)["runs"].drop("rank")
    return retrieval.pair_metrics(retrieval.pair_diagnostics(runs, B.text_gold(spark, sf)))


@query(f"""WITH {_WORKFLOW}, {_RANKS} SELECT qid, count(*) AS n_runs, count(*) FILTER (outcome = 'neither') AS n_neither FROM diag GROUP BY qid HAVING count(*) FILTER (outcome = 'neither') = count(*) ORDER BY md5(concat('13|', qid)), qid LIMIT 10""")
def neither_sample(spark, sf):
    """Ten queries of which no run finds either document among its first 10."""
    runs = _workflow(spark, sf)["runs"].drop("rank")
    diagnostics = retrieval.pair_diagnostics(runs, B.text_gold(spark, sf))
    return retrieval.neither_sample(diagnostics, 10, 10)


@query(f"""WITH {B.BM25}, {B.DENSE}, two AS (SELECT 'bm25' AS run, qid, doc, score, rank FROM text_run UNION ALL SELECT 'dense', qid, doc, score, rank FROM dense_run),
    shared AS (SELECT qid FROM two GROUP BY 1 HAVING count(DISTINCT run) = 2),
    every AS (SELECT run, qid, doc, rank FROM two UNION ALL SELECT 'rrf', qid, doc, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) FROM (SELECT qid, doc, sum(1.0 / (60 + rank)) AS score FROM two SEMI JOIN shared USING (qid) GROUP BY 1, 2))
    SELECT run, count(DISTINCT qid) AS n_queries, count(*) AS n_rows, max(rank) AS depth FROM every GROUP BY 1""")
def multi_run(spark, sf):
    """Several searches at depth 200 and their fusion, as one table of runs."""
    runs = retrieval.all_runs({"bm25": B.text_run(spark, sf), "dense": B.dense_run(spark, sf)})
    return runs.groupBy("run").agg(F.countDistinct("qid").alias("n_queries"), F.count("*").alias("n_rows"), F.max("rank").alias("depth"))
