"""Where inputs come from and what their names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.sources import io

REFERENCE_COLUMNS = ("SourceID", "TargetID", "ReferenceText", "ReferenceType", "SourceDocumentID", "TargetDocumentID", "SourcePassageID", "TargetPassageID", "SourcePassage", "TargetPassage")


def discovered(pages: DataFrame, links: DataFrame, host: str, sections: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(url): distinct links of the seed pages to dated pages of some sections on one host, without query and fragment, in order.

    ``links`` holds page_id and the absolute href; ``pages`` the ids of the seeds.
    """
    dated = F.col("absolute").rlike(r"/\d{2}-\d{2}-\d{4}/?$")
    inside = F.lit(False)
    for s in sections:
        inside |= F.col("absolute").contains(f"/{s}/")
    scheme, at, path = (F.try_parse_url("absolute", F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH"))
    found = links.join(pages.select("page_id"), "page_id", "left_semi").where(inside & dated).where(scheme.startswith("http") & at.contains(host))
    urls = found.select(F.concat(scheme, F.lit("://"), at, path).alias("url")).distinct().orderBy("url")
    return urls if most is None else urls.limit(most)


def read_allowlist(spark: SparkSession, path: str, most: int = 0) -> DataFrame:
    """(url): lines that are neither blank nor comments, once each, in order; the first ``most`` if given."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    urls = lines.where("url <> '' and not startswith(url, '#')").distinct().orderBy("url")
    return urls.limit(most) if most > 0 else urls


def to_fetch(allowed: DataFrame, log: DataFrame) -> DataFrame:
    """Allowed URLs that no earlier fetch brought home."""
    return allowed.join(log.where("ok").select("url").distinct(), "url", "left_anti")


def page_file(url: Column) -> Column:
    """A file name for a page: its host and path, and a digest of the whole URL."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    base = F.regexp_replace(F.regexp_replace(rest, "^/+|/+$", ""), "[/:]", "_")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("url")), F.lit("__"), F.substring(F.sha1(url), 1, 10), F.lit(".html"))


def canonical_passages(raw: DataFrame, doc_prefix: str, source_tag: str) -> DataFrame:
    """Raw passages (pid, text, document_id, passage_id) in the common form; fields without a source are empty."""
    text = lambda name: F.lit(None).cast("string").alias(name)
    none = lambda name: F.array().cast("array<string>").alias(name)
    return raw.select(F.col("pid").alias("passage_uid"), F.col("text").alias("passage"), F.concat(F.lit(doc_prefix), F.col("document_id").cast("string")).alias("doc_id"), "passage_id", F.lit(source_tag).alias("source_tag"), text("title"), none("heading_path"), text("passage_url"), text("doc_url"), text("eId"), text("tag"), none("anchor_ids"), none("refs"))


def canonical_references(raw: DataFrame) -> DataFrame:
    """References with the common columns in their order; texts that are missing are empty, other columns are dropped."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda c: F.col(have[c.lower()]).cast("string") if c.lower() in have else F.lit(None).cast("string")
    return raw.select(*[(F.coalesce(pick(c), F.lit("")) if c in ("SourcePassage", "TargetPassage") else pick(c)).alias(c) for c in REFERENCE_COLUMNS])


def cohort_of(path: Column) -> Column:
    """The cohort that a file's name says."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("final_dependency_valid"), "dependency_valid").when(name.contains("final_answer_valid"), "answer_valid").when(name.contains("final_answer_failed"), "answer_failed").otherwise("input")


def read_cohorts(spark: SparkSession, pattern: str, schema: str, corpora: tuple[str, ...] = ()) -> DataFrame:
    """Records of several cohort files with cohort and corpus, from the rows or else from the paths."""
    path = F.col("_metadata.file_path")
    corpus = F.lit("")
    for c in corpora:
        corpus = F.when(F.lower(path).contains(c), c).otherwise(corpus)
    lines = spark.read.text(pattern).select("value", path.alias("_path"), corpus.alias("_corpus"), cohort_of(path).alias("_cohort")).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema).alias("r"), "_path", "_corpus", "_cohort").select("r.*", "_path", "_corpus", "_cohort")
    given = lambda c: F.nullif(F.lower(F.col(c).cast("string")), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("corpus", F.coalesce(given("corpus"), given("dataset"), F.col("_corpus"))).withColumn("cohort", F.coalesce(given("cohort"), F.col("_cohort"))).withColumnRenamed("_path", "input_file").drop("_corpus", "_cohort")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_split(spark: SparkSession, root: str, corpus: str, schema: str, method: str | None = None, split: str = "test") -> DataFrame:
    """One split of a corpus: the method's own file, or else the combined one (in a folder, or beside it), cut to the method."""
    if method and _exists(spark, own := f"{root}/{corpus.upper()}-{method.strip().upper()}-{split}.jsonl"):
        return io.read_jsonl(spark, own, schema)
    for path in (f"{root}/{corpus.upper()}/{split}.jsonl", f"{root}/{corpus.upper()}-{split}.jsonl"):
        if _exists(spark, path):
            rows = io.read_jsonl(spark, path, schema)
            return rows.where(F.upper(F.trim("method")) == method.strip().upper()) if method else rows
    raise FileNotFoundError(f"no {split} split of {corpus} below {root}")


def read_results(spark: SparkSession, pattern: str, result: str, name: str = r"([^_/]+)_([^_/]+)_(.+)_test\.json$") -> DataFrame:
    """Rows of nested result files ({"model": ..., "results": [...]}): scores lifted, corpus, method and retriever from the file's name where a row has none."""
    files = spark.read.option("wholetext", True).text(pattern).select("value", F.col("_metadata.file_name").alias("file"))
    rows = files.select("file", F.from_json("value", f"struct<model:string,results:array<struct<{result}>>>").alias("r")).select("file", "r.model", F.explode("r.results").alias("x")).select("file", "model", "x.*")
    bare = F.regexp_replace("file", "^answer_eval_", "")
    out = rows
    for k, c in enumerate(("corpus", "method", "retriever"), 1):
        told = F.regexp_extract(bare, name, k)
        told = F.upper(told) if c == "method" else told
        out = out.withColumn(c, F.coalesce(F.col(c), told) if c in rows.columns else told)
    if "nli_scores" in rows.columns:
        for c in ("entailment", "contradiction"):
            lifted = F.col(f"nli_scores.{c}")
            out = out.withColumn(c, F.coalesce(F.col(c), lifted) if c in rows.columns else lifted)
    return out.withColumn("split", F.lit("test")).withColumnRenamed("model", "generator_model").drop("file")


def typed(rows: DataFrame, required: dict[str, str]) -> DataFrame:
    """Rows whose required columns convert to their types, converted; others are dropped."""
    out = rows
    for c, kind in required.items():
        out = out.withColumn(c, F.col(c).try_cast(kind))
    good = F.lit(True)
    for c in required:
        good &= F.col(c).isNotNull()
    return out.where(good)


def staged_runs(runs: DataFrame, staged: DataFrame | None, names: tuple[str, ...], aliases: dict[str, str], restage: bool = False) -> DataFrame:
    """Runs under the names a layout expects; what is staged already stays unless ``restage``.

    ``aliases`` gives other names to runs; a run without rows has no alias.
    """
    if staged is not None and not restage and not staged.isEmpty():
        return staged
    known = runs.where(F.col("run").isin(*names))
    out = known
    for alias, name in aliases.items():
        out = out.unionByName(known.where(F.col("run") == name).withColumn("run", F.lit(alias)))
    return out
