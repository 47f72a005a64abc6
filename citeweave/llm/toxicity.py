"""Severity of toxic text by cumulative-link ordinal regression.

One weight vector over sparse word features is shared by all thresholds:
P(grade >= k) = sigmoid(w.x - t_k), with t_1 < t_2 < ...  The output is the
expected severity, the sum of those probabilities.

Words are hashed into buckets.  How many toxic and other labelled documents
hold each bucket is counted over all labelled documents; buckets that tell the
two apart significantly (``LEAST_Z`` standard errors, by chance fewer than one
bucket of all) are the features, the ``MOST_FEATURES`` most telling ones at
most, which bounds the model.  Weights are fitted on at most ``SAMPLE`` labelled
documents (documented bounds).  Labels go to the texts as a broadcast up to
``MOST_SENT`` of them (20 MB) and beyond by a join; both count the same.

Where labels only say toxic or not, :func:`graded` derives grades: 0 for
others, and for toxic documents the third in which their number of distinct
marker words (features more frequent in toxic documents) falls.  A document is
called toxic from the probability of grade 1 that has the best F1 score on the
fitted documents.

Cases: null, empty or wordless text has no features and gets the severity of
the thresholds alone; a null label teaches nothing; of several labels of one
document the largest counts; labels of one kind alone give severity 0 for all
(or the top grade's prior if all are toxic); ties in grade go to the lower one;
repeated rows get equal answers; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import word_hashes
from .text_blocks import U64, blocks

FEATURE_BASE = 0x1B873593CC9E2D51 % (1 << 60)  # fixed, so that models can be kept
BUCKETS_LOG2 = 18
SAMPLE = 6000
GRADES = 4
LEAST_Z = 4.5
MOST_FEATURES = 1 << 14
MOST_SENT = 2_000_000


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Feature numbers by bucket (-1: none), their weights and the ascending thresholds."""

    feature: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade >= 1), P(grade >= 2), ..."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1)
        for row, found in _features(data, offsets, self.feature):
            out[row] = self.weights[np.unique(found)].sum()
        return out


def _features(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray):
    """(row, features of its words in order) of rows with any."""
    words, first = word_hashes(data, offsets, FEATURE_BASE)
    found = feature[(words >> U64(64 - BUCKETS_LOG2)).astype(np.int64)]
    on = np.flatnonzero(found >= 0)
    row = np.searchsorted(first, on, "right") - 1
    if not len(on):
        return
    cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(on)], strict=True):
        yield int(row[a]), found[on[a:b]]


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, features: int, classes: int, l2: float = 0.02, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the mean log loss."""
    n = len(rows)
    at = np.concatenate([np.full(len(r), k) for k, r in enumerate(rows)]).astype(np.int64) if n else np.zeros(0, np.int64)
    of = np.concatenate(rows).astype(np.int64) if n else np.zeros(0, np.int64)
    share = np.array([(grades >= k).mean() if n else 0.0 for k in range(1, classes)])
    share = np.clip(share, 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    theta = np.concatenate([np.zeros(features), start[:1], gaps])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w = theta[:features]
        thresholds = np.concatenate([theta[features : features + 1], theta[features] + np.cumsum(np.exp(theta[features + 1 :]))])
        score = np.bincount(at, w[of], minlength=n)
        upper = sigmoid(score[:, None] - thresholds[None, :])
        # log P(grade) by differences of neighbouring probabilities
        full = np.hstack([np.ones((n, 1)), upper, np.zeros((n, 1))])
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-9)
        slope = full * (1 - full)
        d_low = -slope[np.arange(n), grades] / p
        d_high = slope[np.arange(n), grades + 1] / p
        d_threshold = np.zeros(classes + 1)
        np.add.at(d_threshold, grades, -d_low / n)
        np.add.at(d_threshold, grades + 1, -d_high / n)
        inner = d_threshold[1:classes]
        d_gap = np.array([inner[k + 1 :].sum() for k in range(classes - 2)]) * np.exp(theta[features + 1 :])
        g = np.concatenate([np.bincount(of, (d_low + d_high)[at] / n, minlength=features) + l2 / max(1, n) * w * 10, [inner.sum()], d_gap])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:features], np.concatenate([theta[features : features + 1], theta[features] + np.cumsum(np.exp(theta[features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int = GRADES, sample: int = SAMPLE, seed: int = 11) -> Model:
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = 1 << BUCKETS_LOG2
    # labels are sent to the texts where they are few enough, else both meet by a join
    few = marks.limit(MOST_SENT + 1).count() <= MOST_SENT
    sent = spark.sparkContext.broadcast(_sorted_labels(marks) if few else None)
    known = texts.withColumn("toxic", F.lit(-1)) if few else texts.join(marks, "id")

    def frequencies(batches):
        total = np.zeros((2, size), np.int32)
        n = [0, 0]
        for batch in batches:
            toxic = np.asarray(batch.column(2)) if sent.value is None else _labels_of(batch.column(0), *sent.value)
            for a, b, data, offsets in blocks(batch.column(1)):
                if (toxic[a:b] < 0).all():
                    continue
                words, first = word_hashes(data, offsets, FEATURE_BASE)
                bucket = (words >> U64(64 - BUCKETS_LOG2)).astype(np.int64)
                for k in np.flatnonzero(toxic[a:b] >= 0).tolist():
                    kind = int(toxic[a + k] > 0)
                    total[kind, np.unique(bucket[first[k] : first[k + 1]])] += 1
                    n[kind] += 1
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([n[0], *total[0][at].tolist()], pa.int64()), pa.array([n[1], *total[1][at].tolist()], pa.int64())], names=["bucket", "clean", "toxic"])

    # at most one row for each bucket
    rows = known.select("id", "text", "toxic").mapInArrow(frequencies, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    totals = rows[rows["bucket"] < 0]
    clean_n, toxic_n = (int(totals[c].sum()) for c in ("clean", "toxic"))
    rows = rows[rows["bucket"] >= 0].sort_values("bucket")
    feature = np.full(size, -1, np.int64)
    if not clean_n or not toxic_n:
        prior = np.full(grades - 1, -20.0 if toxic_n else 20.0)  # all alike
        return Model(feature, np.zeros(0), prior)
    p1, p0 = (rows["toxic"].to_numpy() + 0.5) / (toxic_n + 1), (rows["clean"].to_numpy() + 0.5) / (clean_n + 1)
    pooled = (rows["toxic"].to_numpy() + rows["clean"].to_numpy() + 1) / (toxic_n + clean_n + 2)
    z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / toxic_n + 1 / clean_n))
    chosen = np.argsort(-np.abs(z), kind="stable")[:MOST_FEATURES]
    chosen = np.sort(chosen[np.abs(z[chosen]) >= LEAST_Z])
    feature[rows["bucket"].to_numpy(np.int64)[chosen]] = np.arange(len(chosen))
    marker = z[chosen] > 0

    # about half of the sample from each kind, by a hash of the id
    draw = (F.xxhash64(F.lit(seed), "id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    rate = F.when(F.col("toxic") > 0, min(1.0, sample / 2 / toxic_n)).otherwise(min(1.0, sample / 2 / clean_n))
    chosen_ids = marks.where(draw < rate).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(sample)
    drawn = texts.join(F.broadcast(chosen_ids), "id")  # at most ``sample`` ids
    shared = spark.sparkContext.broadcast(feature)

    def features(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                words, first = word_hashes(data, offsets, FEATURE_BASE)
                out = [np.zeros(0, np.int64)] * (b - a)
                for row, found in _features(data, offsets, shared.value):
                    out[row] = found
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(first), pa.int64()), pa.array([x.astype("<i4").tobytes() for x in out], pa.binary())], names=["toxic", "words", "found"])

    table = drawn.select("text", "toxic").mapInArrow(features, "toxic int, words long, found binary").toPandas()
    found = [np.frombuffer(x, "<i4") for x in table["found"]]
    toxic = table["toxic"].to_numpy() > 0
    found = [np.unique(x) for x in found]
    grade = graded(found, toxic, marker, grades)
    # the sample has other shares of grades than the labelled documents: move the thresholds back
    weights, thresholds = fit_ordinal(found, grade, len(chosen), grades)
    drawn_odds, true_odds = (toxic.sum() + 0.5) / ((~toxic).sum() + 0.5), toxic_n / clean_n
    thresholds = thresholds + np.log(drawn_odds / true_odds)
    p = sigmoid(np.array([weights[x].sum() for x in found]) - thresholds[0])
    weight = np.where(toxic, toxic_n / max(1, toxic.sum()), clean_n / max(1, (~toxic).sum()))
    return Model(feature, weights, thresholds, best_cut(p, toxic, weight))


def best_cut(p: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The probability from which calling documents toxic has the best F1 score; halfway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    q, hit, all_ = p[order], np.cumsum((weight * toxic)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * toxic).sum())
    ends = np.flatnonzero(np.concatenate([q[1:] < q[:-1], [True]]))
    k = ends[np.argmax(f1[ends])]
    return float((q[k] + (q[k + 1] if k + 1 < len(q) else 0.0)) / 2)


def _sorted_labels(marks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = marks.toPandas()
    ids = rows["id"].to_numpy(np.int64)
    order = np.argsort(ids)
    return ids[order], rows["toxic"].to_numpy(np.int8)[order]


def _labels_of(column: pa.Array, ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Each row's label, -1 where it has none."""
    known = np.asarray(column.is_valid())
    wanted = np.asarray(column.fill_null(0), np.int64)
    if not len(ids):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    return np.where(known & (ids[at] == wanted), labels[at], -1)


def graded(found: list[np.ndarray], toxic: np.ndarray, marker: np.ndarray, grades: int) -> np.ndarray:
    """Severity grades 0 .. grades - 1: toxic documents by thirds (or so) of their number of marker words."""
    number = np.array([marker[x].sum() if len(x) else 0 for x in found])
    cuts = np.quantile(number[toxic], np.arange(1, grades - 1) / (grades - 1)) if toxic.any() else []
    return np.where(toxic, 1 + np.searchsorted(cuts, number, "left"), 0)


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, severity, p_toxic, toxic) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                upper = shared.value.at_least(shared.value.scores(data, offsets))
                full = np.hstack([np.ones((b - a, 1)), upper, np.zeros((b - a, 1))])
                grade = (full[:, :-1] - full[:, 1:]).argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(upper.sum(1)), pa.array(grade.astype(np.int32)), pa.array(upper[:, 0]), pa.array(upper[:, 0] >= shared.value.cut)], names=["id", "expected_severity", "severity", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, expected_severity double, severity int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)
