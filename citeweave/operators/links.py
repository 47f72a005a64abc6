"""Resolution of links to passages: keys of several levels meet at once, the lowest level counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T

LEVELS = ("exact", "lower", "normalised", "document")


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)", 1))


def _least(hits: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """Of each reference's hits that of the lowest level, then of the least order."""
    return hits.groupBy(*by).agg(F.min(F.struct("level", "order", *value)).alias("hit")).select(*by, "hit.level", *[f"hit.{v}" for v in value])


def _keyed(rows: DataFrame, keep: list[str], keys: list[Column]) -> DataFrame:
    """The rows once for each key they have, with its level; keys that are null or empty meet nothing and are left out."""
    pairs = F.array(*[F.struct(F.lit(level).alias("level"), key.alias("key")) for level, key in enumerate(keys)])
    return rows.select(*keep, F.explode(pairs).alias("k")).select(*keep, "k.level", "k.key").where("key <> ''")


def resolve(references: DataFrame, documents: DataFrame, anchors: DataFrame, to_document: bool = True) -> DataFrame:
    """Each reference's document, passage and how it was found.

    references (ref, page_url, href), documents (doc, url, load_order) and
    anchors (doc, anchor, passage, position).  A link matches a document by its
    normal URL, else without its date; then a passage by its fragment as it is,
    in lower case, and by letters and digits alone; ``to_document`` falls back
    to the document's first passage.

    Each of the two steps is one equality join: a reference stands in it once
    for each key it has, under the key's level, and the lowest level it met
    counts.  References without a key, and those without a document, take no
    part, so no null or empty key gathers rows; each index has one row per
    level and key, so no join multiplies references.
    """
    name = ["ref", "page_url", "href"]
    refs = references.select(*name).distinct()
    bad = T.is_bad_href(F.col("href"))
    url, href = T.normal_url(F.col("url")), T.normal_url(F.col("href"))

    by_url = _keyed(documents, ["doc", "load_order"], [url, T.undated_url(url)])
    by_url = by_url.groupBy("level", "key").agg(F.min(F.struct("load_order", "doc")).alias("d")).select("level", "key", F.col("d.load_order").alias("order"), F.col("d.doc").alias("doc"))
    asked = _keyed(refs.where(~bad), name, [href, T.undated_url(href)])
    of_doc = _least(asked.join(by_url, ["level", "key"]), name, ["doc"]).drop("level")

    # a mark tells the keys of fragments from the one that every document has
    mark = lambda c: F.concat(F.lit("#"), F.nullif(c, F.lit("")))
    forms = lambda c: [mark(c), mark(F.lower(c)), mark(T.anchor_key(c))]
    whole = [F.lit("document")] if to_document else []
    by_anchor = _keyed(anchors, ["doc", "position", "passage"], [*forms(F.col("anchor")), *whole])
    by_anchor = by_anchor.groupBy("doc", "level", "key").agg(F.min(F.struct("position", "passage")).alias("p")).select("doc", "level", "key", F.col("p.position").alias("order"), F.col("p.passage").alias("passage"))
    fragment = F.regexp_extract("href", "#(.*)$", 1)
    asked = _keyed(of_doc, [*name, "doc"], [*forms(fragment), *whole])
    of_passage = _least(asked.join(by_anchor, ["doc", "level", "key"]), name, ["passage"])

    same = lambda other: [F.col(f"r.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in name]
    rows = references.alias("r").join(of_doc.alias("d"), same("d"), "left").join(of_passage.alias("p"), same("p"), "left").select("r.*", "d.doc", "p.level", "p.passage")
    same_host = (host(F.col("href")) == "") | (host(F.col("href")) == host(F.col("page_url")))
    found = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("level") + 1)
    reason = F.when(bad, "bad_href").when(F.col("doc").isNull() & ~same_host, "off_site").when(F.col("doc").isNull(), "unknown_document")
    kind = F.when(bad, "bad").when(F.col("doc").isNotNull() & (href == T.normal_url(F.col("page_url"))), "internal").when(F.col("doc").isNotNull(), "external").when(same_host, "outsource_same_host").otherwise("outsource")
    return rows.select("ref", "doc", "passage", reason.when(F.col("level").isNotNull(), found).otherwise("unknown_anchor").alias("reason"), kind.alias("kind"))
