"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of the folded
text, with runs of other characters than letters as one space.  Document
frequencies are counted over the whole training fold; the weights are learned
from at most ``sample_per_language`` documents of each language (a documented
bound) by follow-the-regularised-leader with an elastic-net penalty.  A fifth
of that sample is set aside to fit the temperature by which scores are
calibrated.

Cases: null text and text without a letter is ``und`` with score 0, and so is
every text when nothing can be learned; rows with a null language or in the
held-out fold teach nothing; a null id is not held out and teaches nothing;
ties go to the language first in alphabetical order; repeated rows get equal
answers; extra columns are dropped by :func:`predict` and kept by
:func:`keep_identified`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_blocks import keep_only

BUCKETS_LOG2 = 15
BUCKETS = 1 << BUCKETS_LOG2
SAMPLE_PER_LANGUAGE = 600
UNKNOWN = "und"

_FOLD = np.arange(0x10000, dtype=np.uint32)
for _c in range(0x10000):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams and how often each occurs; empty without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 0x10000
    points = np.where(low, _FOLD[points & np.uint32(0xFFFF)], points)
    if not low.all():
        others = [c for c in np.unique(points[~low]).tolist() if not chr(c).isalpha()]
        points[np.isin(points, others)] = 32
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    if not (points != 32).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint32(32 - BUCKETS_LOG2)
    hashed, state = [], np.zeros(len(points), np.uint32)
    for n in range(1, 4):
        state = (state[: len(points) - n + 1] + points[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        hashed.append((state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA77) >> shift)
    counts = np.bincount(np.concatenate(hashed), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[at]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal for multinomial logistic regression with elastic net."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1.0
        g = x[:, None] * error[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm.

    Each label counts as right with (n + 1) / (n + 2), as n cases can't show more.
    """
    n, classes = logits.shape
    target = np.full((n, classes), 1 / (n + 2) / max(1, classes - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)

    def loss(t):
        return -(target * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-12))).sum(1).mean()

    low, high, ratio = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        at, counts = gram_counts(text)
        if not len(at):
            return UNKNOWN, 0.0
        p = softmax(weighted(at, counts, self.idf) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def held_out(id_col: str) -> Column:
    """The fold: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE, epochs: int = 2, seed: int = 13) -> Model:
    spark = docs.sparkSession
    fold = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))

    def frequencies(batches):
        keep_only()
        total, n = np.zeros(BUCKETS, np.int64), 0
        langs: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, _ = gram_counts(text or "")
                if len(at):
                    total[at] += 1
                    n += 1
                    langs[lang] = langs.get(lang, 0) + 1
        at = np.flatnonzero(total)
        keys = [f"g{k}" for k in at.tolist()] + [f"l{x}" for x in langs]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([*total[at].tolist(), *langs.values()], pa.int64())], names=["key", "n"])

    # one row for each bucket and language: the driver and the model grow with the number of languages alone
    rows = fold.select("text", "lang").mapInArrow(frequencies, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(rows["key"], rows["n"], strict=True))
    sizes = {k[1:]: int(n) for k, n in counts.items() if k[0] == "l"}
    languages, total = sorted(sizes), sum(sizes.values())
    df = np.zeros(BUCKETS)
    for k, n in counts.items():
        if k[0] == "g":
            df[int(k[1:])] = n
    idf = np.log((1 + total) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)

    # about sample_per_language rows of each language, by a hash of the id
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_per_language / n))]), F.col("lang"))
    draw = (F.xxhash64(F.lit(seed), F.col("id").cast("string")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    order = F.xxhash64(F.lit(seed + 1), F.col("id").cast("string"), "text")
    sample = fold.where(draw < rate).select(order.alias("key"), F.col("id").cast("string").alias("id"), "lang", "text")

    def features(batches):
        for batch in batches:
            found = [gram_counts(t or "") for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["key", "id", "lang", "at", "counts"])

    # features are made where the texts are, so only rows of bounded size are ordered
    drawn = sample.mapInArrow(features, "key long, id string, lang string, at binary, counts binary").orderBy("key", "id").limit(2 * sample_per_language * len(languages)).toPandas()
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(c, np.int32), languages.index(x)) for a, c, x in zip(drawn["at"], drawn["counts"], drawn["lang"], strict=True) if len(a)]
    rows = [(a, weighted(a, c, idf), k) for a, c, k in rows]
    order = np.random.default_rng(seed).permutation(len(rows))
    aside = order[: len(order) // 5]
    train = order[len(order) // 5 :]
    learner = FollowTheLeader(BUCKETS, len(languages))
    for _ in range(epochs):
        for k in train:
            learner.learn(*rows[k])
    weights = learner.weights()
    temperature = 1.0
    if len(aside) and len(languages) > 1:
        temperature = fit_temperature(np.array([rows[k][1] @ weights[rows[k][0]] for k in aside]), np.array([rows[k][2] for k in aside]))
    return Model(languages, idf, weights.astype(np.float32), temperature)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
