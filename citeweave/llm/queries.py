"""The subpackage's registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import turn_sql

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def tokenizer_path() -> str:
    """Where the public tokenizer files are; a path, never a copy."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import itq_dedup

    return itq_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.archived(_table(spark, sf_dir, "pages"))


def op4_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    return jaccard_join.similar(_table(spark, sf_dir, "documents"), size=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id")


def op5_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rans

    return rans.digests(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op6_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import weak_label

    docs = _table(spark, sf_dir, "documents")
    return weak_label.score(docs, weak_label.fit(docs))


def op8_deep_shallow_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat_format

    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the contract's own conversation, whose texts look like the template's marks
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_format.round_trip(talks.unionByName(extra))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import token_alignment

    return token_alignment.alignment(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path(PIECES))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    return turn_repair.repair_damage(_table(spark, sf_dir, "conversations"))


_ALL = (op1_ordinal_toxicity, op2_itq_near_dedup, op3_warc_capture_index, op4_divide_skip_join, op5_rans_token_files, op6_streaming_bpe, op7_weak_label_quality, op8_deep_shallow_dedup, op9_language_id, op10_suffix_decontamination, op11_chat_format, op12_token_alignment, op13_turn_repair)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(node, other) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
    groups AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""

ORACLES: dict[str, str] = {
    "op2_itq_near_dedup": f"""
        WITH RECURSIVE good AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98
        ), {_REACH}, n AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN groups ON node = vec_id
    """,
    "op10_suffix_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT k FROM win),
        places AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
        hit AS (SELECT doc_id, item_id, places.k, i FROM places JOIN win ON win.k = places.k AND win.s = places.s),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
    """,
    "op11_chat_format": turn_sql.chat_format(),
    "op13_turn_repair": turn_sql.turn_repair(),
    "op3_warc_capture_index": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
    """,
}
