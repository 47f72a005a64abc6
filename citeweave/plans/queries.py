"""The registered queries of the reference operators, each with its SQL twin where SQL can express it.

Results are tidied for comparison: integers are long, doubles have six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import curation, graph, html, links, retrieval, statistics, xrefs
from citeweave.plans import bindings as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind in ("double", "float"):
            c = F.round(c.cast("double"), 6)
        columns.append(c.alias(name))
    return df.select(*columns)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf: tidy(f(spark, sf))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# SQL text of the shared text expressions
TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda w: len(w) > 1 AND w NOT IN ({_list(T.CONTENT_STOPWORDS)})))"
NORMAL = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
WORDS = r"list_filter(string_split_regex(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
JACCARD = "CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END"


def _phrases(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(concat(' ', lower({c}), ' '), ' {p} ')" for p in phrases) + ")"


TITLE_RATIO = r"len(list_filter({w}, lambda w: regexp_matches(w, '^\p{{Lu}}[\p{{Ll}}\P{{L}}]*\p{{Ll}}[\p{{Ll}}\P{{L}}]*$'))) / greatest(1, len({w}))"


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


# ---------------------------------------------------------------- text


@query(rf"""SELECT doc_id AS doc, round(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(1, length(t)), 6) AS letters,
    round((length(t) - length(replace(t, '.', ''))) / greatest(1, length(t)), 6) AS dots, round({TITLE_RATIO.format(w="w")}, 6) AS titlecase
    FROM (SELECT doc_id, {NORMAL.format("text")} AS t, {WORDS.format("text")} AS w FROM documents)""")
def text_ratios(spark, sf):
    t = T.normal(F.col("text"))
    return B.passages(spark, sf).select("doc", T.letter_ratio(t).alias("letters"), T.dot_ratio(t).alias("dots"), T.titlecase_ratio(F.col("text")).alias("titlecase"))


_TITLE = rf"""(CASE WHEN length(t) <= 80 AND length(t) - length(replace(t, ' ', '')) <= 12 THEN 2 ELSE 0 END
    + CASE WHEN NOT regexp_matches(t, '[.!?]$') THEN 1 ELSE 0 END
    + CASE WHEN len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z][a-zA-Z0-9\-]*$'))) / greatest(1, len(w)) >= 0.4 THEN 1 ELSE 0 END
    + CASE WHEN len(list_filter(regexp_extract_all(lower(regexp_replace(t, '[^\x00-\x7F]', ' ', 'g')), '[a-z]+'), lambda x: x IN ({_list(T.TITLE_STOPWORDS)}))) / greatest(1, len(regexp_extract_all(t, '[a-zA-Z]+'))) <= 0.18 THEN 1 ELSE 0 END
    + CASE WHEN NOT regexp_matches(t, '[,;:]') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{T.HEADING}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(t, '{T.RULE_PREFIX}') THEN 2 ELSE 0 END)"""


@query(f"""SELECT doc_id AS doc, CAST({_TITLE} AS BIGINT) AS score, {_TITLE} >= 3 AS title_like
    FROM (SELECT doc_id, {NORMAL.format("text")} AS t, {WORDS.format("text")} AS w FROM documents) WHERE t <> ''
    UNION ALL SELECT doc_id, 10, true FROM documents WHERE coalesce({NORMAL.format("text")}, '') = ''""")
def title_like_filter(spark, sf):
    return B.passages(spark, sf).select("doc", T.title_score(F.col("text")).alias("score")).withColumn("title_like", F.col("score") >= 3)


_QUALITY = rf"""CASE WHEN t = '' THEN 'empty_or_null' WHEN length(t) < 40 THEN 'too_short' WHEN length(t) > 12000 THEN 'too_long'
    WHEN length(t) < 90 AND regexp_matches(trim(t, ' .'), '{T.PLACEHOLDER}') THEN 'keyword_placeholder'
    WHEN regexp_matches(t, '\.{{4,}}') THEN 'contains_dot_leader'
    WHEN (length(t) - length(replace(t, '.', ''))) / greatest(1, length(t)) > 0.22 THEN 'high_dot_density'
    WHEN length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / greatest(1, length(t)) < 0.35 THEN 'low_alpha_ratio' ELSE 'ok' END"""


@query(f"SELECT doc_id AS doc, {_QUALITY} AS reason FROM (SELECT doc_id, coalesce({NORMAL.format('text')}, '') AS t FROM documents)")
def hard_quality_gate(spark, sf):
    return B.passages(spark, sf).select("doc", T.quality_reason(F.col("text")).alias("reason"))


@query()
def nav_title_penalty(spark, sf):
    return B.passages(spark, sf).select("doc", T.looks_like_navigation(F.col("text")).alias("navigation"))


_STRIPPED = r"regexp_replace(regexp_replace(trim({0}), '^[ \t\r\n\-–—|]+', ''), '[ \t\r\n\-–—|]+$', '')"
_NAV = rf"""(b = '' OR regexp_matches(b, '{_re(T.NAV_PREFIX)}') OR (regexp_matches(b, '{T.POLICY_ID}') AND length(b) < 240 AND NOT duty)
    OR (length(b) < 180 AND regexp_matches(b, '{T.MENU_SEPARATOR}') AND NOT duty)
    OR (length(b) < 240 AND titlecase >= 0.65 AND NOT duty AND NOT regexp_matches(b, '[.;:]')))"""
_SIGNAL_BASE = rf"""base AS (SELECT *, {_phrases("b", T.OBLIGATIONS)} AS duty, {TITLE_RATIO.format(w="bw")} AS titlecase
    FROM (SELECT *, {WORDS.format("b")} AS bw FROM (SELECT *, {_STRIPPED.format("t")} AS b FROM (SELECT doc, text, {NORMAL.format("text")} AS t FROM regulated))))"""
_SIGNAL = rf"""CASE WHEN t = '' THEN -999 ELSE 8 * CAST({_phrases("t", T.PROHIBITIONS)} AS INT) + 6 * CAST({_phrases("t", T.MODALS)} AS INT)
    + 4 * CAST({_phrases("t", T.REQUIREMENTS)} AS INT) + 2 * CAST({_phrases("t", T.DEFINITIONS)} AS INT) + CAST({_phrases("t", T.ACTIONS)} AS INT)
    + CAST(regexp_matches(t, '[.;:]') AS INT) + CAST(length(t) >= 200 AS INT) + CAST(length(t) >= 400 AS INT) + CAST(length(t) >= 800 AS INT) - 10 * CAST({_NAV} AS INT) END"""


@query(f"WITH {B.REGULATED}, {_SIGNAL_BASE} SELECT doc, CAST({_SIGNAL} AS BIGINT) AS score FROM base")
def rule_signal_score(spark, sf):
    return B.regulated(spark, sf).select("doc", T.rule_signal_score(F.col("text"), repeated_tail=False).alias("score"))


@query(f"""WITH {B.PAIRS}, {B.REGULATED}, {_SIGNAL_BASE}, scored AS (SELECT doc, t, {_SIGNAL} AS score, {_phrases("text", T.OBLIGATIONS)} AS has_duty FROM base)
    SELECT seq, CAST(s.score + d.score + CASE WHEN s.has_duty AND d.has_duty THEN 6 WHEN s.has_duty OR d.has_duty THEN 1 ELSE -5 END
        + CAST(regexp_matches(s.t, '[.;:]') AND regexp_matches(d.t, '[.;:]') AS INT) - 5 * CAST(s.t <> '' AND s.t = d.t AS INT) AS BIGINT) AS score
    FROM refs JOIN scored s ON s.doc = source_id JOIN scored d ON d.doc = target_id ORDER BY score DESC, seq LIMIT 100""")
def xref_rank_topk(spark, sf):
    of = B.regulated(spark, sf).select("doc", T.row_signals(F.col("text"), repeated_tail=False).alias("x"))
    rows = B.references(spark, sf).join(of.select(F.col("doc").alias("source_id"), F.col("x").alias("s")), "source_id").join(of.select(F.col("doc").alias("target_id"), F.col("x").alias("t")), "target_id")
    scored = rows.select("seq", T.score_of_signals(F.lit(""), F.col("s"), F.col("t"), "both").alias("score"))
    return scored.orderBy(F.desc("score"), "seq").limit(100)


_LEAK = " UNION ALL ".join(f"SELECT doc, {k} AS place, '{kind}' AS kind, unnest(list_distinct(regexp_extract_all(text, '{_re(p)}'))) AS span FROM regulated" for k, (kind, p) in enumerate(T.LEAKAGE))
_LEAKS = f"leaks AS (SELECT * FROM ({_LEAK}) WHERE kind <> 'corpus_code' OR regexp_extract(span, '^[A-Z]+') NOT IN ({_list(T.CURRENCIES)}))"


@query(f"WITH {B.REGULATED}, {_LEAKS} SELECT doc, kind, span FROM leaks")
def citation_leakage(spark, sf):
    return B.regulated(spark, sf).select("doc", F.explode(T.leakages(F.col("text"))).alias("x")).select("doc", "x.kind", "x.span")


@query(f"WITH {B.REGULATED}, {_LEAKS} SELECT kind, count(*) AS n_spans, count(DISTINCT doc) AS n_docs FROM leaks GROUP BY kind")
def leakage_by_type(spark, sf):
    return citation_leakage(spark, sf).groupBy("kind").agg(F.count("*").alias("n_spans"), F.countDistinct("doc").alias("n_docs"))


@query(f"""WITH {B.REGULATED}, {_LEAKS}, n AS (SELECT doc, count(*) AS n FROM leaks GROUP BY doc)
    SELECT CASE WHEN coalesce(n, 0) > 0 THEN 'separate' ELSE 'kept' END AS route, count(*) AS n FROM regulated LEFT JOIN n USING (doc) GROUP BY 1""")
def leakage_routing(spark, sf):
    leaks = F.size(T.leakages(F.col("text"))) > 0
    return B.regulated(spark, sf).groupBy(curation.leakage_route("separate", leaks).alias("route")).agg(F.count("*").alias("n"))


@query(f"WITH {B.REGULATED} SELECT doc % 5 = 0 AS ruled, count(*) AS n, round(avg(CAST(regexp_matches(text, '{_re(T.CITATION)}') AS INT)), 6) AS citation_like FROM regulated GROUP BY 1")
def citation_like_rates(spark, sf):
    rows = B.regulated(spark, sf)
    return rows.groupBy((F.col("doc") % 5 == 0).alias("ruled")).agg(F.count("*").alias("n"), F.avg(T.is_citation_like(F.col("text")).cast("int")).alias("citation_like"))


@query(rf"""WITH {B.REGULATED}, m AS (SELECT doc, coalesce(text, '') AS t, trim(regexp_extract(coalesce(text, ''), '(?i)(?:^|[.]\s+)((?:[^.]{{10,220}}?)\b(?:must|shall|may|is\s+required\s+to|subject\s+to|provided\s+that)\b[^.]{{0,220}})(?:[.]|$)', 1)) AS modal FROM regulated),
    f AS (SELECT *, rtrim(substr(regexp_extract(trim(t), '(?s)^[^.?!]*[.?!]?'), 1, 220)) AS first FROM m), c AS (SELECT *, CASE WHEN modal <> '' THEN modal ELSE nullif(first, '') END AS clause FROM f)
    SELECT doc, CASE WHEN clause IS NOT NULL THEN CASE WHEN modal <> '' THEN instr(t, modal) - 1 ELSE 0 END END AS start, CASE WHEN clause IS NOT NULL THEN CASE WHEN modal <> '' THEN instr(t, modal) - 1 ELSE 0 END + length(clause) END AS "end", clause AS text FROM c""")
def core_clause(spark, sf):
    return B.regulated(spark, sf).select("doc", T.core_clause(F.col("text")).alias("c")).select("doc", "c.start", "c.end", "c.text")


@query(rf"""WITH {B.REGULATED}, a AS (SELECT doc, regexp_replace(trim(coalesce(text, '')), '(?i)\s*\(?(?:see|per|under|subject to)\s+[^)]*\)?$', '', 'g') AS t FROM regulated),
    b AS (SELECT doc, regexp_replace(regexp_replace(t, '(?i)(?:\b(?:rule|section|part|chapter|appendix|schedule)\b\s*[:\-]?\s*(?:\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)(?:\s*[a-z])?)|\bFSMR\b|\b\d+(?:\.\d+)+(?:\([^)]+\))*\b', '', 'g'), '\s+', ' ', 'g') AS t FROM a),
    c AS (SELECT doc, regexp_replace(regexp_replace(t, '^[ ,.;:\-]+', ''), '[ ,.;:\-]+$', '') AS t FROM b) SELECT doc, array_to_string(list_slice(list_filter(string_split(t, ' '), lambda w: w <> ''), 1, 12), ' ') AS hook FROM c""")
def semantic_hook(spark, sf):
    return B.regulated(spark, sf).select("doc", T.semantic_hook(F.col("text")).alias("hook"))


@query(f"""WITH {B.PAIRS}, s AS (SELECT doc_id, w, min(pos) AS pos FROM (SELECT doc_id, unnest(r) AS w, unnest(range(len(r))) AS pos
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS r FROM documents)) WHERE len(w) > 1 AND w NOT IN ({_list(T.CONTENT_STOPWORDS)}) GROUP BY 1, 2),
    own AS (SELECT seq, s.w, s.pos FROM refs JOIN s ON s.doc_id = source_id ANTI JOIN s t ON t.doc_id = target_id AND t.w = s.w),
    k AS (SELECT seq, w, row_number() OVER (PARTITION BY seq ORDER BY pos) AS k FROM own)
    SELECT refs.seq, coalesce(string_agg(w, ' ' ORDER BY k), '') AS hints FROM refs LEFT JOIN k ON k.seq = refs.seq AND k <= 5 GROUP BY 1""")
def source_only_hints(spark, sf):
    return B.pairs(spark, sf).select("seq", F.array_join(T.source_only_hints(F.col("source_text"), F.col("target_text")), " ").alias("hints"))


@query(r"""WITH u AS (SELECT page_id, url, regexp_replace(trim(url), '[#?].*$', '') AS bare FROM pages), n AS (SELECT *, regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*') AS head FROM u),
    f AS (SELECT page_id, url, lower(head) || regexp_replace(substr(bare, length(head) + 1), '/+$', '') AS normal FROM n)
    SELECT page_id, normal, regexp_replace(normal, '/\d{2}-\d{2}-\d{4}/?$', '') AS undated, regexp_replace(lower(url_decode(replace(regexp_extract(url, '#(.*)$', 1), '+', '%2B'))), '[^a-z0-9]+', '', 'g') AS anchor FROM f""")
def url_normalize(spark, sf):
    url = F.col("url")
    return B.table(spark, sf, "pages").select("page_id", T.normal_url(url).alias("normal"), T.undated_url(T.normal_url(url)).alias("undated"), T.anchor_key(F.regexp_extract("url", "#(.*)$", 1)).alias("anchor"))


# ---------------------------------------------------------------- pairs and features

_FEATURES = B.PAIRS + f""",
    sets AS (SELECT *, {TOKENS.format('source_text')} AS a, {TOKENS.format('target_text')} AS b FROM pairs),
    feats AS (SELECT seq, source_id, target_id, {JACCARD} AS jaccard, count(*) OVER (PARTITION BY source_id) AS out_refs, count(*) OVER (PARTITION BY target_id) AS in_refs,
        len({WORDS.format('source_text')}) AS source_words, len({WORDS.format('target_text')}) AS target_words,
        {", ".join(f"regexp_matches(target_text, '{_re(p)}') AS has_{k}" for k, p in T.CUES.items())},
        trim(ref_text) <> '' AND contains(lower(source_text), lower(trim(ref_text))) AS ref_in_source, source_doc, target_doc, source_doc <> target_doc AS cross_doc FROM sets)"""
_CASTS = "seq, source_id, target_id, out_refs, in_refs, CAST(source_words AS BIGINT) AS source_words, CAST(target_words AS BIGINT) AS target_words, has_definition, has_duration, has_threshold, has_exception, ref_in_source, cross_doc"


def _features(spark, sf):
    return B.text_features(spark, sf)


@query(f"WITH {_FEATURES} SELECT {_CASTS}, round(jaccard, 6) AS jaccard, jaccard < 0.15 AS low_overlap FROM feats")
def xref_features(spark, sf):
    return _features(spark, sf).select("seq", "source_id", "target_id", "out_refs", "in_refs", "source_words", "target_words", *[f"has_{k}" for k in T.CUES], "ref_in_source", "cross_doc", "jaccard", "low_overlap")


@query(f"WITH {_FEATURES} SELECT seq, round(jaccard, 6) AS jaccard FROM feats")
def xref_jaccard(spark, sf):
    rows = B.pairs(spark, sf)
    return rows.select("seq", T.jaccard(T.content_tokens(F.col("source_text")), T.content_tokens(F.col("target_text"))).alias("jaccard"))


@query(f"""WITH {_FEATURES} SELECT count(*) AS n, round(avg(jaccard), 6) AS mean, round(min(jaccard), 6) AS least, round(max(jaccard), 6) AS most, round(quantile_cont(jaccard, 0.5), 6) AS median,
    count(*) FILTER (jaccard < 0.15) AS n_low_overlap, count(*) FILTER (out_refs > 1) AS n_multi_ref, {", ".join(f"count(*) FILTER (has_{k}) AS n_{k}" for k in T.CUES)}, count(*) FILTER (ref_in_source) AS n_ref_in_source FROM feats""")
def xref_feature_summary(spark, sf):
    return xrefs.feature_summary(_features(spark, sf))


_HARD = "round(0.6 * (1.0 - jaccard) + 0.25 * least(1.0, greatest(0.0, ((source_words + target_words) / 2.0 - 20.0) / 280.0)) + 0.15 * CASE WHEN cross_doc THEN 1.0 ELSE 0.0 END, 6)"


@query(f"WITH {_FEATURES} SELECT seq, {_HARD} AS hard_score FROM feats")
def hard_enriched_score(spark, sf):
    return xrefs.hard_score(_features(spark, sf)).select("seq", "hard_score")


@query(f"""WITH {_FEATURES}, h AS (SELECT seq, {_HARD} AS hard_score, source_doc, target_doc FROM feats),
    p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_doc ORDER BY hard_score DESC, seq) = 1 OR row_number() OVER (PARTITION BY target_doc ORDER BY hard_score DESC, seq) = 1 THEN 0 ELSE 1 END AS picked FROM h)
    SELECT seq, hard_score, source_doc, target_doc FROM p ORDER BY picked, hard_score DESC, seq LIMIT 50""")
def sample_hard_enriched(spark, sf):
    return xrefs.sample_hard(_features(spark, sf), 50, "seq").select("seq", "hard_score", "source_doc", "target_doc")


@query(f"WITH {B.PAIRS} SELECT seq, source_id, target_id FROM refs ORDER BY md5(concat('13|', seq)), seq LIMIT 50")
def sample_random(spark, sf):
    return xrefs.sample_random(B.references(spark, sf), 50, 13, "seq").select("seq", "source_id", "target_id")


@query(f"WITH {_FEATURES} SELECT seq, round(jaccard, 6) AS jaccard FROM feats ORDER BY feats.jaccard, seq LIMIT 50")
def sample_low_overlap(spark, sf):
    return xrefs.sample_low_overlap(_features(spark, sf), 50, "seq").select("seq", "jaccard")


@query(f"WITH {_FEATURES} SELECT seq, out_refs FROM feats ORDER BY CASE WHEN out_refs > 1 THEN 0 ELSE 1 END, md5(concat('13|', seq)), seq LIMIT 50")
def sample_multi_ref(spark, sf):
    return xrefs.sample_matching(_features(spark, sf), F.col("out_refs") > 1, 50, 13, "seq").select("seq", "out_refs")


@query(f"WITH {_FEATURES} SELECT seq, has_definition, has_exception FROM feats ORDER BY CASE WHEN has_definition OR has_exception THEN 0 ELSE 1 END, md5(concat('13|', seq)), seq LIMIT 50")
def sample_definition(spark, sf):
    return xrefs.sample_matching(_features(spark, sf), F.col("has_definition") | F.col("has_exception"), 50, 13, "seq").select("seq", "has_definition", "has_exception")


@query(f"""WITH {_FEATURES}, b AS (SELECT seq, CASE WHEN jaccard < 0.15 THEN 'low_overlap' WHEN out_refs > 1 THEN 'multi_ref' WHEN has_definition OR has_exception THEN 'definition_condition' ELSE 'random' END AS bucket FROM feats),
    pool AS (SELECT k.bucket, w, pos, (SELECT count(*) FROM b WHERE b.bucket = k.bucket) AS n FROM (VALUES ('low_overlap', 0.3, 1), ('multi_ref', 0.2, 3), ('definition_condition', 0.3, 2), ('random', 0.2, 4)) k(bucket, w, pos)),
    floors AS (SELECT *, least(n, CAST(floor(50 * w) AS BIGINT)) AS f FROM pool), short AS (SELECT *, least(50, (SELECT sum(n) FROM pool)) - (SELECT sum(f) FROM floors) AS spare FROM floors),
    shares AS (SELECT bucket, f + greatest(0, least(n - f, spare - coalesce(sum(n - f) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM short)
    SELECT seq, bucket FROM (SELECT seq, bucket, take, row_number() OVER (PARTITION BY bucket ORDER BY md5(concat('13|', seq)), seq) AS k FROM b JOIN shares USING (bucket)) WHERE k <= take""")
def sample_mixed_difficulty(spark, sf):
    return xrefs.sample_mixed(_features(spark, sf), 50, 13, "seq").select("seq", "bucket")


@query(f"""WITH {B.PAIRS} SELECT substr(sha256(concat(ref_type, '||', source_id, '||', target_id)), 1, 16) AS pair_uid, seq, source_id, target_id, ref_type,
    source_id % 50 <> 0 AND target_id % 50 <> 0 AS resolved, length(CASE WHEN source_id % 50 <> 0 AND target_id % 50 <> 0 THEN source_text ELSE concat('inline ', source_id) END) AS source_chars
    FROM pairs WHERE (source_id % 50 <> 0 AND target_id % 50 <> 0 AND trim(source_text) <> '' AND trim(target_text) <> '') OR source_id % 50 = 0 OR target_id % 50 = 0""")
def pair_build(spark, sf):
    known = B.passages(spark, sf).where("doc % 50 <> 0").select(F.col("doc").alias("uid"), "text")
    refs = B.references(spark, sf).select("seq", "ref_type", F.col("source_id").alias("source_uid"), F.col("target_id").alias("target_uid"), F.concat(F.lit("inline "), F.col("source_id").cast("string")).alias("source_inline"), F.concat(F.lit("inline "), F.col("target_id").cast("string")).alias("target_inline"))
    out = xrefs.build_pairs(refs, known)
    return out.select(T.uid(F.col("ref_type"), F.col("source_uid"), F.col("target_uid")).alias("pair_uid"), "seq", F.col("source_uid").alias("source_id"), F.col("target_uid").alias("target_id"), "ref_type", "resolved", F.length("source_text").alias("source_chars"))


_PAIR_REASON = f"""CASE WHEN trim(source_text) = '' OR trim(target_text) = '' THEN 'empty_text' WHEN ref_type NOT IN ('Internal') THEN 'reference_type'
    WHEN {_TITLE} >= 3 THEN 'title_target' WHEN source_id = target_id OR {NORMAL.format('source_text')} = t THEN 'degenerate' ELSE 'kept' END"""
_PAIR_T = f"(SELECT *, {NORMAL.format('target_text')} AS t, {WORDS.format('target_text')} AS w FROM pairs)"


@query(f"WITH {B.PAIRS} SELECT {_PAIR_REASON} AS reason, count(*) AS n FROM {_PAIR_T} GROUP BY 1")
def pair_filter_report(spark, sf):
    reason = xrefs.pair_drop_reason(F.col("source_text"), F.col("target_text"), F.col("ref_type"), F.col("source_id"), F.col("target_id"), ("Internal",))
    return B.pairs(spark, sf).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {B.PAIRS} SELECT CASE WHEN trim(source_text) = '' OR trim(target_text) = '' THEN 'empty_text' WHEN target_id % 10 = 0 OR {_TITLE} >= 3 THEN 'title_target'
    WHEN target_id % 7 = 0 THEN 'missing_spans' WHEN source_id = target_id OR {NORMAL.format('source_text')} = t THEN 'degenerate' ELSE 'kept' END AS reason, count(*) AS n FROM {_PAIR_T} GROUP BY 1""")
def schema_filter_report(spark, sf):
    spans = F.when(F.col("target_id") % 7 != 0, F.array(F.lit(1)))
    reason = xrefs.schema_drop_reason(F.col("source_text"), F.col("target_text"), F.col("target_id") % 10 == 0, spans, F.col("source_id"), F.col("target_id"))
    return B.pairs(spark, sf).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_CLEAN = """cleaned AS (SELECT seq, source_id % 100 AS s, CASE WHEN target_id % 9 = 0 THEN -1 ELSE target_id % 100 END AS t FROM refs),
    verdicts AS (SELECT seq, CASE WHEN t = -1 THEN 'target_missing' WHEN s = t THEN 'self_reference' WHEN seq <> min(seq) OVER (PARTITION BY s, t) THEN 'duplicate' ELSE 'kept' END AS verdict FROM cleaned)"""


def _cleaned(spark, sf):
    refs = B.references(spark, sf).select("seq", (F.col("source_id") % 100).alias("source_id"), F.when(F.col("target_id") % 9 == 0, -1).otherwise(F.col("target_id") % 100).alias("target_id"))
    return xrefs.clean_references(refs, spark.range(100).select(F.col("id").alias("uid")))


@query(f"WITH {B.PAIRS}, {_CLEAN} SELECT verdict, count(*) AS n FROM verdicts GROUP BY 1")
def xref_clean_report(spark, sf):
    return _cleaned(spark, sf).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH {B.PAIRS}, {_CLEAN} SELECT verdict, seq, n FROM (SELECT verdict, seq, row_number() OVER (PARTITION BY verdict ORDER BY seq) AS n FROM verdicts WHERE verdict <> 'kept') WHERE n <= 3")
def rejection_examples(spark, sf):
    from pyspark.sql import Window as W

    return _cleaned(spark, sf).where("verdict <> 'kept'").withColumn("n", F.row_number().over(W.partitionBy("verdict").orderBy("seq"))).where("n <= 3").select("verdict", "seq", "n")


@query(f"WITH {B.PAIRS} SELECT s AS source_id, t AS target_id, min(seq) AS seq FROM (SELECT source_id % 100 AS s, target_id % 100 AS t, seq FROM refs) GROUP BY 1, 2")
def first_wins_dedup(spark, sf):
    return statistics.first_wins(B.references(spark, sf).select((F.col("source_id") % 100).alias("source_id"), (F.col("target_id") % 100).alias("target_id"), "seq"), ["source_id", "target_id"], "seq")


@query(f"WITH {B.PAIRS} SELECT seq FROM refs WHERE source_id % 4 <> 1")
def resume_anti_join(spark, sf):
    refs = B.references(spark, sf)
    return xrefs.resume(refs, refs.where("source_id % 4 = 1"), "seq").select("seq")


@query(f"""WITH {B.PAIRS}, d AS (SELECT target_id % 20 AS v, count(*) AS n FROM refs GROUP BY 1) SELECT CAST(v AS VARCHAR) AS value, n FROM d ORDER BY n DESC, value LIMIT 10""")
def target_diagnostics(spark, sf):
    return statistics.top_values(B.references(spark, sf).withColumn("suffix", (F.col("target_id") % 20).cast("string")), "suffix", 10)


@query(f"""WITH {B.PAIRS} SELECT ref_type, count(*) AS n, count(DISTINCT (source_id, target_id)) AS unique_pairs, round(avg(len({WORDS.format('source_text')})), 6) AS mean_words FROM pairs GROUP BY 1""")
def adapter_stats(spark, sf):
    rows = B.pairs(spark, sf).withColumn("w", F.size(T.words(F.col("source_text"))))
    return rows.groupBy("ref_type").agg(F.count("*").alias("n"), F.countDistinct("source_id", "target_id").alias("unique_pairs"), F.avg("w").alias("mean_words"))


# ---------------------------------------------------------------- graph


@query(f"""WITH {B.EDGES} SELECT src, dst FROM edges WHERE src % 10 <> 0 AND dst % 10 <> 0""")
def xref_graph_edges(spark, sf):
    refs = B.references(spark, sf).select(F.col("source_id"), F.lit(None).cast("long").alias("source_passage_id"), F.col("target_id"), F.lit(None).cast("long").alias("target_passage_id"))
    active = B.passages(spark, sf).where("doc % 10 <> 0").select(F.col("doc").alias("id"))
    return retrieval.graph_edges(refs, active)


@query(f"""WITH {B.EDGES}, deg AS (SELECT 'out' AS side, count(*) AS d FROM edges GROUP BY src UNION ALL SELECT 'in', count(*) FROM edges GROUP BY dst)
    SELECT side, count(*) AS nodes, round(avg(d), 6) AS mean, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median, min(d) AS least, max(d) AS most FROM deg GROUP BY 1""")
def xref_degree_stats(spark, sf):
    return statistics.degrees(B.edges(spark, sf))


@query(f"""WITH {B.EDGES}, ends AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
    SELECT (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE src_doc = dst_doc) AS within_doc, (SELECT count(*) FROM edges WHERE src_doc <> dst_doc) AS cross_doc,
        (SELECT count(DISTINCT src) FROM edges) AS sources, (SELECT count(DISTINCT dst) FROM edges) AS targets, (SELECT count(*) FROM ends) AS touched, (SELECT count(*) FROM documents) AS passages,
        round(100.0 * (SELECT count(*) FROM ends) / (SELECT count(*) FROM documents), 6) AS coverage_pct""")
def xref_coverage(spark, sf):
    return statistics.coverage(B.edges(spark, sf), B.passages(spark, sf))


@query(f"""WITH RECURSIVE {B.EDGES}, sides AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach(node, other) AS (SELECT DISTINCT a, a FROM sides UNION SELECT reach.node, sides.b FROM reach JOIN sides ON reach.other = sides.a)
    SELECT node, min(other) AS component FROM reach GROUP BY node""")
def xref_components(spark, sf):
    return graph.connected_components(B.edges(spark, sf))


# ---------------------------------------------------------------- retrieval


@query(f"WITH {B.BM25} SELECT qid, doc, round(score, 6) AS score FROM text_run")
def bm25_topk(spark, sf):
    return B.text_run(spark, sf).select("qid", "doc", "score")


@query("""SELECT qid, doc, round(score, 6) AS score FROM (
    SELECT q.vec_id AS qid, p.vec_id AS doc, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) DESC, p.vec_id) AS rank
    FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def dense_topk(spark, sf):
    """Every vector is searched; every id divisible by 100 asks."""
    rows = B.table(spark, sf, "embeddings")
    found = retrieval.dense_topk(rows, rows.where("vec_id % 100 = 0"), 10, "vec_id", "vec_id", "embedding")
    return found.select("qid", "doc", "score")


@query(f"WITH {B.RUNS} SELECT run, qid, doc, score, rank FROM ranked")
def run_ranking(spark, sf):
    return retrieval.ranked(B.runs(spark, sf)).select("run", "qid", "doc", "score", "rank")


_COMMON = "common AS (SELECT qid FROM ranked GROUP BY qid HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs))"


@query(f"""WITH {B.RUNS}, {_COMMON}, fused AS (SELECT qid, doc, sum(1.0 / (60 + rank)) AS score FROM ranked SEMI JOIN common USING (qid) GROUP BY 1, 2)
    SELECT qid, doc, round(score, 6) AS score FROM fused""")
def rrf_fusion(spark, sf):
    return retrieval.rrf(retrieval.ranked(B.runs(spark, sf))).select("qid", "doc", "score")


@query(f"""WITH {B.RUNS}, {_COMMON} SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY run, rank, doc) AS position FROM (
    SELECT qid, doc, run, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY run, rank) AS k FROM ranked SEMI JOIN common USING (qid) WHERE rank <= 2) WHERE k = 1)""")
def union_candidates(spark, sf):
    return retrieval.union_candidates(retrieval.ranked(B.runs(spark, sf)), 2)


def _expand_sql(neigh: str, combine: str) -> str:
    return f"""WITH {B.EDGES}, {B.BM25}, seeds AS (SELECT qid, doc AS seed, score FROM text_run WHERE rank <= 10), near AS ({neigh}),
    every AS (SELECT qid, seed AS doc, score FROM seeds UNION ALL SELECT qid, near.doc, score * 0.8 FROM seeds JOIN near USING (seed)),
    final AS (SELECT qid, doc, {combine}(score) AS score FROM every GROUP BY 1, 2)
    SELECT qid, doc, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM final) WHERE rank <= 20"""


_BOTH = "SELECT src AS seed, dst AS doc FROM edges UNION SELECT dst, src FROM edges"


@query(_expand_sql(_BOTH, "max"))
def xref_expand_max(spark, sf):
    return retrieval.expand(B.text_run(spark, sf), B.edges(spark, sf), seed_k=10).select("qid", "doc", "score")


@query(_expand_sql(_BOTH, "sum"))
def xref_expand_sum(spark, sf):
    return retrieval.expand(B.text_run(spark, sf), B.edges(spark, sf), seed_k=10, mode="sum").select("qid", "doc", "score")


@query(_expand_sql("SELECT dst AS seed, src AS doc FROM edges", "max"))
def xref_expand_incoming(spark, sf):
    return retrieval.expand(B.text_run(spark, sf), B.edges(spark, sf), seed_k=10, direction="incoming").select("qid", "doc", "score")


@query(f"WITH {B.GOLD} SELECT DISTINCT qid, doc, CAST(1 AS BIGINT) AS relevance FROM (SELECT qid, src AS doc FROM gold UNION ALL SELECT qid, tgt FROM gold)")
def qrels(spark, sf):
    return retrieval.qrels(B.gold(spark, sf))


_METRICS = f"""WITH {B.RUNS}, {B.GOLD}, rel AS (SELECT DISTINCT qid, doc FROM (SELECT qid, src AS doc FROM gold UNION ALL SELECT qid, tgt FROM gold)),
    total AS (SELECT qid, count(*) AS r FROM rel GROUP BY 1), names AS (SELECT DISTINCT run FROM runs),
    hits AS (SELECT run, qid, rank, row_number() OVER (PARTITION BY run, qid ORDER BY rank) AS nth FROM ranked JOIN rel USING (qid, doc) WHERE rank <= 10),
    each AS (SELECT run, qid, count(*) AS found, sum(nth / rank) AS precisions, sum(1.0 / log2(rank + 1)) AS gain FROM hits GROUP BY 1, 2)
    SELECT run, count(*) AS n_queries, round(avg(coalesce(found, 0) / r), 6) AS recall, round(avg(coalesce(precisions, 0) / r), 6) AS map,
        round(avg(coalesce(gain, 0) / CASE r WHEN 1 THEN 1.0 ELSE 1.0 + 1.0 / log2(3) END), 6) AS ndcg, round(avg(coalesce(found, 0) / 10.0), 6) AS precision
    FROM total CROSS JOIN names LEFT JOIN each USING (run, qid) GROUP BY run"""


@query(_METRICS)
def ir_metrics_at_k(spark, sf):
    return retrieval.metrics(B.runs(spark, sf), retrieval.qrels(B.gold(spark, sf)), 10)


def _out(k):
    return f"CASE WHEN s <= {k} AND t <= {k} THEN 'both' WHEN s <= {k} THEN 'src_only' WHEN t <= {k} THEN 'tgt_only' ELSE 'neither' END"


_DIAG = f"""{B.RUNS}, {B.GOLD}, names AS (SELECT DISTINCT run FROM runs),
    found AS (SELECT run, qid, min(rank) FILTER (doc = src) AS s, min(rank) FILTER (doc = tgt) AS t FROM ranked JOIN gold USING (qid) WHERE doc = src OR doc = tgt GROUP BY 1, 2),
    diag AS (SELECT run, qid, s AS src_rank, t AS tgt_rank, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN greatest(s, t) END AS pair_rank,
        coalesce(1.0 / CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN greatest(s, t) END, 0.0) AS pair_rr, {_out(5)} AS outcome_5, {_out(10)} AS outcome_10, {_out(20)} AS outcome_20
        FROM gold CROSS JOIN names LEFT JOIN found USING (run, qid))"""


@query(f"WITH {_DIAG} SELECT run, qid, src_rank, tgt_rank, pair_rank, round(pair_rr, 6) AS pair_rr, outcome_5, outcome_10, outcome_20 FROM diag")
def pair_diagnostics(spark, sf):
    return retrieval.pair_diagnostics(B.runs(spark, sf), B.gold(spark, sf))


@query(f"""WITH {_DIAG} SELECT run, count(*) AS n_queries, {", ".join(f"round(avg(CAST(outcome_10 = '{o}' AS INT)), 6) AS {o}" for o in ("both", "src_only", "tgt_only", "neither"))}, round(avg(pair_rr), 6) AS pair_mrr FROM diag GROUP BY run""")
def pair_metrics(spark, sf):
    return retrieval.pair_metrics(retrieval.pair_diagnostics(B.runs(spark, sf), B.gold(spark, sf)))


_VOTES = f"""{B.RUNS}, {B.GOLD}, per AS (SELECT qid, run, bool_or(doc = src) AS s, bool_or(doc = tgt) AS t FROM runs JOIN gold USING (qid) WHERE doc = src OR doc = tgt GROUP BY 1, 2),
    votes AS (SELECT gold.qid, count(*) FILTER (s) AS source_votes, count(*) FILTER (t) AS target_votes, count(*) FILTER (s AND t) AS both_votes,
        coalesce(string_agg(run, ',' ORDER BY run) FILTER (s), '') AS source_runs, coalesce(string_agg(run, ',' ORDER BY run) FILTER (t), '') AS target_runs,
        coalesce(string_agg(run, ',' ORDER BY run) FILTER (s AND t), '') AS both_runs FROM gold LEFT JOIN per USING (qid) GROUP BY 1)"""


def _votes(spark, sf):
    return retrieval.votes(B.runs(spark, sf), B.gold(spark, sf))


@query(f"WITH {_VOTES} SELECT * FROM votes")
def ir_votes(spark, sf):
    return _votes(spark, sf)


@query(f"""WITH {_VOTES}, d AS (SELECT CASE WHEN source_votes >= 3 AND target_votes >= 3 THEN 'KEEP' WHEN source_votes = 2 OR target_votes = 2 THEN 'JUDGE' ELSE 'DROP' END AS decision FROM votes)
    SELECT decision, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM d), 6) AS pct FROM d GROUP BY 1""")
def ir_vote_decisions(spark, sf):
    rows = _votes(spark, sf).groupBy(retrieval.vote_decision(F.col("source_votes"), F.col("target_votes"), 3, 2).alias("decision")).agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select("decision", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


@query(f"WITH {_VOTES} SELECT concat('src:', source_votes, '_tgt:', target_votes) AS votes, count(*) AS n FROM votes GROUP BY 1")
def vote_distribution(spark, sf):
    return _votes(spark, sf).groupBy(F.concat(F.lit("src:"), F.col("source_votes").cast("string"), F.lit("_tgt:"), F.col("target_votes").cast("string")).alias("votes")).agg(F.count("*").alias("n"))


_LABEL = "CASE WHEN both_votes * 2 > 3 THEN 'easy' WHEN both_votes > 0 THEN 'medium' WHEN source_votes > 0 AND target_votes > 0 THEN 'hard' WHEN source_votes > 0 THEN 'source_only' WHEN target_votes > 0 THEN 'target_only' ELSE 'neither' END"


@query(f"""WITH {_VOTES} SELECT label, CASE WHEN label IN ('easy', 'medium') THEN 'retrievable' ELSE 'challenging' END AS tier, count(*) AS n FROM (SELECT {_LABEL} AS label FROM votes) GROUP BY 1, 2""")
def difficulty_labels(spark, sf):
    label = retrieval.difficulty_label(F.col("source_votes"), F.col("target_votes"), F.col("both_votes"), 3)
    rows = _votes(spark, sf).select(label.alias("label"))
    return rows.groupBy("label", retrieval.difficulty_tier(F.col("label")).alias("tier")).agg(F.count("*").alias("n"))
