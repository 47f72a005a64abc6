"""A kept BM25 index of impact-ordered blocks, searched with block maxima.

Layout below one folder: ``blocks/generation=g`` holds postings in blocks of
(term, slice, level); ``terms/generation=g`` one row per term; ``manifest-g`` the
collection's size, total length and fingerprint, written last, so a build or append
that dies leaves the former index in force.  Levels order a term's blocks by impact,
slices (by a hash of the document, one for about ``SLICE`` postings) bound them, so
the most frequent term is many blocks and no task holds its list.  A block knows its
highest term frequency and shortest passage, which bound its impact whatever the mean
length becomes by appending.

Search, for all queries at once:

1. a threshold: each query's blocks of the highest bounds, up to ``HEAD`` postings, are scored; the
   k-th partial score (less what negative weights could take away) is one that k
   documents reach;
2. candidates: terms whose greatest impacts together stay below the threshold can't
   bring a document in alone; the others' blocks are read unless a block's bound plus
   the other terms' greatest impacts stays below it.  A document that reaches the
   threshold has all its postings in blocks that are read;
3. completion: only for candidates that can still reach the threshold, the left-out
   terms are probed, in the slices that the candidates' hashes name.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.operators.retrieval import B, EPSILON, K1, asked_terms, ranked, sent_if_small, tasks_for, term_counts
from citeweave.operators.tables import list_folders, written

SLICE = 4096
LEVELS = 8
HEAD = 4096
#: Scores are rounded to nine places; bounds leave this much room for the order of additions.
SLACK = 1e-6


class StaleIndex(ValueError):
    """The index was not built from these passages."""


def fingerprint(passages: DataFrame, id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """One row (rows, hashes, mixed) that does not depend on the order of rows; those of parts can be added up."""
    of = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return passages.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(of(1).cast("decimal(28,0)")), F.lit(0)).cast("string").alias("hashes"),
        F.coalesce(F.bit_xor(of(2)), F.lit(0)).alias("mixed"),
    )


def _manifests(spark: SparkSession, path: str) -> list[int]:
    done = [n for n in list_folders(spark, path) if n.startswith("manifest-") and "_SUCCESS" in list_folders(spark, f"{path}/{n}")]
    return sorted(int(n.removeprefix("manifest-")) for n in done)


def _write(passages: DataFrame, path: str, generation: int, id_col: str, text_col: str) -> tuple[int, int]:
    """Blocks and terms of one generation; (passages with words, total length)."""
    rows, _ = written(term_counts(passages, id_col, text_col), "term-counts")
    lengths = rows.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)))
    n, total = lengths.first()
    mean = total / n if n else 1.0
    rows = rows.select("doc", "dl", F.explode("entries").alias("e")).select("e.term", "doc", "dl", "e.tf")
    facts = rows.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")).withColumn("slices", F.ceil(F.col("df") / SLICE).cast("int"))
    terms, _ = written(facts, "terms")
    # terms of several slices are few: each has more than a slice of postings
    frequent, _ = written(terms.where("slices > 1").select("term", "slices"), "frequent")
    level = F.least(F.lit(LEVELS - 1), F.floor(_impact(F.col("tf"), F.col("dl"), F.lit(mean)) / (K1 + 1) * LEVELS)).cast("int")
    placed = rows.join(sent_if_small(frequent), "term", "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("slice", _slice(F.col("doc"), F.col("slices"))).withColumn("level", level)
    entry = F.struct("doc", "tf", "dl")
    blocks = placed.groupBy("term", "slice", "level").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.collect_list(entry).alias("entries"))
    blocks.sortWithinPartitions("term", F.desc("level")).write.mode("overwrite").parquet(f"{path}/blocks/generation={generation}")
    terms.write.mode("overwrite").parquet(f"{path}/terms/generation={generation}")
    return n, total


def _slice(doc: Column, slices: Column) -> Column:
    return F.pmod(F.xxhash64(doc), slices.cast("long")).cast("int")


def _impact(tf: Column, dl: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class KeptIndex:
    """An index that lies below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        found = _manifests(spark, path)
        if not found:
            raise FileNotFoundError(f"no finished index below {path}")
        self.generation = found[-1]
        (line,) = spark.read.text(f"{path}/manifest-{self.generation}").collect()
        self.manifest = json.loads(line[0])

    def _of(self, kind: str) -> DataFrame:
        of_it = [f"{self.path}/{kind}/generation={g}" for g in range(self.generation + 1)]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*of_it)

    def fits(self, passages: DataFrame, id_col: str = "doc", text_col: str = "text") -> bool:
        return fingerprint(passages, id_col, text_col).first().asDict() == self.manifest["fingerprint"]

    def append(self, passages: DataFrame, id_col: str = "doc", text_col: str = "text") -> KeptIndex:
        """The index with further passages, whose ids must be new."""
        return _commit(passages, self.path, self, id_col, text_col)

    def terms(self) -> DataFrame:
        """(term, df, greatest frequency, shortest passage) over all generations."""
        return self._of("terms").groupBy("term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))

    def weights(self, queries: DataFrame, query_col: str = "qid", query_text: str = "text") -> DataFrame:
        """(qid, term, df, weight, most): each asked term's weight and the most it can add, none where that is negative."""
        n, mean = F.lit(float(self.manifest["n"])), self._mean
        terms = self.terms()
        raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        floor = terms.agg(F.avg(raw) * EPSILON).scalar()
        asked = asked_terms(queries, query_col, query_text)
        weight = F.col("times") * F.when(raw < 0, floor).otherwise(raw)
        most = F.col("weight") * _impact(F.col("max_tf"), F.col("min_dl"), mean)
        return asked.join(terms, "term").withColumn("weight", weight).withColumn("most", F.greatest(F.lit(0.0), most)).select("qid", "term", "df", "weight", "most")

    @property
    def _mean(self) -> Column:
        return F.lit(self.manifest["length"] / self.manifest["n"] if self.manifest["n"] else 1.0)

    def _scores(self, blocks: DataFrame) -> DataFrame:
        """(qid, doc, score) summed over the entries of (qid, weight, entries) rows."""
        rows = blocks.select("qid", "weight", F.explode("entries").alias("e"))
        return rows.groupBy("qid", "e.doc").agg(F.sum(F.col("weight") * _impact(F.col("e.tf"), F.col("e.dl"), self._mean)).alias("score"))

    def head_blocks(self, weights: DataFrame) -> DataFrame:
        """Each query's blocks of the highest bounds, up to ``HEAD`` postings and one block; only their entries are read."""
        bound = F.col("weight") * _impact(F.col("max_tf"), F.col("min_dl"), self._mean)
        key = ["term", "generation", "slice", "level"]
        facts = weights.where("weight > 0").select("qid", "term", "weight").join(self._of("blocks").select(*key, "n", "max_tf", "min_dl"), "term")
        before = W.partitionBy("qid").orderBy(bound.desc(), *key).rowsBetween(W.unboundedPreceding, -1)
        head = facts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < HEAD)
        head, _ = written(head.select("qid", "weight", *key), "head")
        return self._of("blocks").select(*key, "n", "entries").join(sent_if_small(head), key)

    def thresholds(self, weights: DataFrame, k: int) -> DataFrame:
        """(qid, theta): a score that k documents reach at least; queries without k documents have none."""
        scores = self._scores(self.head_blocks(weights))
        kth = ranked(scores, k, by=("qid",)).where(F.col("rank") == k).select("qid", "score")
        # what terms of negative weight may take away
        loss = weights.groupBy("qid").agg(F.sum(F.least(F.lit(0.0), F.col("weight") * (K1 + 1))).alias("loss"))
        return kth.join(loss, "qid").select("qid", (F.col("score") + F.col("loss") - SLACK).alias("theta"))

    def split_terms(self, weights: DataFrame, thresholds: DataFrame) -> DataFrame:
        """Weights with theta, whether a term can bring a document in, and what the other terms and the left-out ones add at most."""
        rows = weights.join(thresholds, "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
        upward = W.partitionBy("qid").orderBy("most", F.desc("df"), "term")
        whole = W.partitionBy("qid")
        rows = rows.withColumn("leads", F.sum("most").over(upward) >= F.col("theta")).withColumn("others", F.sum("most").over(whole) - F.col("most"))
        return rows.withColumn("left_out", F.sum(F.when(F.col("leads"), 0.0).otherwise(F.col("most"))).over(whole))

    def candidate_blocks(self, split: DataFrame) -> DataFrame:
        """(qid, term, n) of the blocks of leading terms that can hold a document of the threshold; negative weights are never left out."""
        rows = self._of("blocks").select("term", "n", "max_tf", "min_dl").join(split.where("leads"), "term")
        return rows.where(self._useful()).select("qid", "term", "n")

    def _useful(self, of=F.col) -> Column:
        bound = of("weight") * _impact(F.col("max_tf"), F.col("min_dl"), self._mean)
        return (of("weight") <= 0) | (bound + of("others") >= of("theta"))

    def found(self, split: DataFrame) -> DataFrame:
        """(qid, doc, score) summed over the candidate blocks.

        A block that any query needs is moved once, its postings dealt by document;
        queries meet them there, so no row of a query and a document is shuffled.
        """
        leading = split.where("leads").select("qid", "term", "weight", "others", "theta")
        asks, _ = written(leading.groupBy("term").agg(F.collect_list(F.struct("weight", "others", "theta")).alias("asks")), "asks")
        blocks = self._of("blocks").select("term", "max_tf", "min_dl", "entries").join(sent_if_small(asks), "term").where(F.exists("asks", lambda a: self._useful(lambda c: a[c])))
        entries = blocks.select("term", "max_tf", "min_dl", F.explode("entries").alias("e")).select("term", "max_tf", "min_dl", "e.*")
        tasks = tasks_for(self.spark, self.manifest["n"], split.agg(F.countDistinct("qid")).first()[0])
        leading, _ = written(leading, "leading")
        hits = entries.repartition(tasks, "doc").join(sent_if_small(leading), "term").where(self._useful())
        return hits.groupBy("qid", "doc").agg(F.sum(F.col("weight") * _impact(F.col("tf"), F.col("dl"), self._mean)).alias("score"))

    def completion(self, split: DataFrame, candidates: DataFrame) -> DataFrame:
        """(term, doc, tf, dl) of the left-out terms, in the slices that candidates' hashes name."""
        of_terms = self._of("terms").select("term", "generation", "slices")
        wanted = split.where("not leads").select("qid", "term").join(of_terms, "term").join(candidates.select("qid", "doc"), "qid")
        keys, _ = written(wanted.select("term", "generation", _slice(F.col("doc"), F.col("slices")).alias("slice")).distinct(), "keys")
        blocks = self._of("blocks").join(sent_if_small(keys), ["term", "generation", "slice"], "left_semi")
        return blocks.select("term", F.explode("entries").alias("e")).select("term", "e.*")

    def completed(self, split: DataFrame, candidates: DataFrame) -> DataFrame:
        """(qid, doc, score) of the candidates; they and the postings of left-out terms are dealt by document once and added up there."""
        others, _ = written(split.where("not leads").select(F.col("qid").alias("asker"), "term", "weight"), "others")
        both = candidates.select("qid", "doc", "score").unionByName(self.completion(split, candidates), allowMissingColumns=True)
        tasks = tasks_for(self.spark, self.manifest["n"], split.agg(F.countDistinct("qid")).first()[0])
        met = both.repartition(tasks, "doc").join(sent_if_small(others), "term", "left").where("qid is not null or asker is not null")
        added = F.col("weight") * _impact(F.col("tf"), F.col("dl"), self._mean)
        sums = met.groupBy(F.coalesce("qid", "asker").alias("qid"), "doc").agg(F.round(F.sum(F.coalesce("score", added)), 9).alias("score"), F.max(F.col("score").isNotNull()).alias("alive"))
        return sums.where("alive").drop("alive")

    def search(self, queries: DataFrame, k: int, query_col: str = "qid", query_text: str = "text") -> DataFrame:
        """(qid, doc, score, rank): the same rows as ``retrieval.search_index``."""
        weights, _ = written(self.weights(queries, query_col, query_text), "weights")
        split, _ = written(self.split_terms(weights, self.thresholds(weights, k)), "split-terms")
        limits, _ = written(split.groupBy("qid").agg(F.first("theta").alias("theta"), F.first("left_out").alias("left_out")), "limits")
        alive, _ = written(self.found(split).join(sent_if_small(limits), "qid").where(F.col("score") + F.col("left_out") >= F.col("theta")), "candidates")
        return ranked(self.completed(split, alive), k, by=("qid",))


def _commit(passages: DataFrame, path: str, former: KeptIndex | None, id_col: str, text_col: str) -> KeptIndex:
    spark, generation = passages.sparkSession, former.generation + 1 if former else 0
    seen = fingerprint(passages, id_col, text_col).first().asDict()
    n, total = _write(passages, path, generation, id_col, text_col)
    if former:
        old = former.manifest["fingerprint"]
        seen = {"rows": seen["rows"] + old["rows"], "hashes": str(int(seen["hashes"]) + int(old["hashes"])), "mixed": seen["mixed"] ^ old["mixed"]}
        n, total = n + former.manifest["n"], total + former.manifest["length"]
    line = json.dumps({"n": n, "length": total, "fingerprint": seen})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest-{generation}")
    return KeptIndex(spark, path)


def build(passages: DataFrame, path: str, id_col: str = "doc", text_col: str = "text") -> KeptIndex:
    """A new index in an empty folder."""
    if _manifests(passages.sparkSession, path):
        raise FileExistsError(f"{path} holds an index; open it, or build another one elsewhere")
    return _commit(passages, path, None, id_col, text_col)


def kept(passages: DataFrame, path: str, id_col: str = "doc", text_col: str = "text") -> KeptIndex:
    """The index below ``path`` if it fits the passages, a new one if there is none, else :class:`StaleIndex`."""
    if not _manifests(passages.sparkSession, path):
        return _commit(passages, path, None, id_col, text_col)
    index = KeptIndex(passages.sparkSession, path)
    if not index.fits(passages, id_col, text_col):
        raise StaleIndex(f"the index below {path} was built from other passages")
    return index
