"""Text quality from weak labels.

Overlapping heuristic labellers vote good, bad or abstain.  Their accuracies
are estimated by expectation-maximisation over the counts of vote patterns,
which are taken over all documents and bounded in number by the labellers, so
any corpus costs one aggregation.  Posterior labels then train a linear scorer
over hashed character shapes on at most ``SAMPLE`` documents (a documented
bound), which scores all documents.

Cases: null and empty text is bad with score 0; documents on which all abstain
get the prior; where all posteriors agree the scorer is constant; repeated
rows get equal answers; an empty table gives an empty table; extra columns are
dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000
BUCKETS_LOG2 = 14
BAD, GOOD, ABSTAIN = 0, 1, 2
_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _BAR, _SYMBOL = range(7)

_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[97:123] = _LOWER
_CLASS[128:] = _LOWER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _STOP
_CLASS[ord("|")] = _BAR


def votes(text: str, raw: np.ndarray) -> tuple[int, ...]:
    """One vote of each labeller: seven look for signs of junk, three for signs of prose."""
    counts = np.bincount(_CLASS[raw], minlength=7)
    size = max(1, len(raw))
    letters = max(1, counts[_LOWER] + counts[_UPPER])
    words = text.split()
    n = max(1, len(words))
    again = sum(map(str.__eq__, words, words[1:])) / n
    runs = float(((raw[1:] == raw[:-1]) & (_CLASS[raw[1:]] >= _SYMBOL)).sum()) / n if len(raw) > 1 else 0.0
    junk = (
        counts[_SYMBOL] / size >= 0.03,
        counts[_UPPER] / letters >= 0.35,
        counts[_BAR] / n >= 0.1,
        counts[_DIGIT] / size >= 0.5,
        runs >= 0.1,
        again >= 0.1,
        n >= 50 and len(set(words)) / n < 0.15,
    )
    prose = (
        text.rstrip()[-1:] in (".", "?", "!", '"'),
        0.03 <= counts[_STOP] / n <= 0.5,
        letters / size >= 0.7 and counts[_UPPER] / letters <= 0.2,
    )
    return (*(BAD if x else ABSTAIN for x in junk), *(GOOD if x else ABSTAIN for x in prose))


LABELLERS = 10


@dataclass
class LabelModel:
    """Prior of good and each labeller's chances of its votes, given bad and good."""

    prior: float
    chance: np.ndarray  # (labeller, class, vote)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.chance)
        at = np.arange(patterns.shape[1])
        bad = np.log(1 - self.prior) + logs[at[None, :], BAD, patterns].sum(1)
        good = np.log(self.prior) + logs[at[None, :], GOOD, patterns].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -60, 60)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, strength: float = 0.02) -> LabelModel:
    """Expectation-maximisation with a prior that labellers are better than chance.

    The prior weighs as much as ``strength`` of the documents in each class; it
    keeps "bad" the class in which junk votes are common.
    """
    if not len(patterns):
        return LabelModel(0.5, np.full((LABELLERS, 2, 3), 1 / 3))
    total = float(counts.sum())
    expected = np.array([[0.25, 0.05, 0.70], [0.01, 0.40, 0.59]])  # of votes bad, good, abstain, given bad and good
    p = np.where((patterns == BAD).any(1), 0.05, 0.95)
    model = LabelModel(0.5, np.full((patterns.shape[1], 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight[1].sum() + 1) / (total + 2)
        chance = np.empty((patterns.shape[1], 2, 3))
        for k in range(patterns.shape[1]):
            for y in range(2):
                chance[k, y] = np.bincount(patterns[:, k], weight[y], minlength=3) + expected[y] * (1 + strength * total)
        chance /= chance.sum(2, keepdims=True)
        model = LabelModel(float(np.clip(prior, 1e-4, 1 - 1e-4)), chance)
        now = model.posterior(patterns)
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return model


def shape_counts(text: str, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of character shapes, and how varied the words are; buckets and log counts of unit length."""
    shape = np.where(_CLASS[raw] <= _DIGIT, _CLASS[raw], raw).astype(np.uint32)
    shift = np.uint32(32 - BUCKETS_LOG2)
    parts = []
    if len(shape) > 2:
        mixed = ((shape[:-2] * np.uint32(0x9E3779B1) + shape[1:-1]) * np.uint32(0x85EBCA77) + shape[2:]) * np.uint32(0xC2B2AE3D)
        parts.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> shift)
    counts = np.bincount(np.concatenate(parts), minlength=1 << BUCKETS_LOG2) if parts else np.zeros(1 << BUCKETS_LOG2, np.int64)
    at = np.flatnonzero(counts)
    x = np.log1p(counts[at])
    x = x / max(1e-9, np.sqrt(x @ x))
    words = text.split()
    n = max(1, len(words))
    again = min(15, int(40 * sum(map(str.__eq__, words, words[1:])) / n))
    variety = int(15 * len(set(words)) / n) if n >= 50 else 15
    extra = np.array([again, 16 + variety]) + (1 << BUCKETS_LOG2)
    return np.concatenate([at, extra]), np.concatenate([x, [1.0, 0.5]])


WIDTH = (1 << BUCKETS_LOG2) + 32


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 5, rate: float = 0.5, l2: float = 1e-5, seed: int = 3) -> np.ndarray:
    """Logistic weights for soft labels by AdaGrad; the last weight is the intercept."""
    w, g2 = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-3)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, WIDTH), np.append(x, 1.0)
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -40, 40)))
            g = (p - labels[k]) * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str, raw: np.ndarray) -> float:
        at, x = shape_counts(text, raw)
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.weights[WIDTH], -40, 40))))


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _pattern_code(pattern) -> int:
    code = 0
    for v in pattern:
        code = code * 3 + int(v)
    return code


def _pattern(code: int) -> list[int]:
    out = []
    for _ in range(LABELLERS):
        out.append(code % 3)
        code //= 3
    return out[::-1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> Model:
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)

    def patterns(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                code = _pattern_code(votes(text, _raw(text)))
                seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    # at most 3 ** LABELLERS rows
    table = texts.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    grid = np.array([_pattern(c) for c in table["pattern"]], np.int64).reshape(-1, LABELLERS)
    labels = fit_labels(grid, table["n"].to_numpy(np.float64))
    total = int(table["n"].sum())

    def features(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                raw = _raw(text)
                at, x = shape_counts(text, raw)
                out.append((_pattern_code(votes(text, raw)), at.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *map(pa.array, columns, (pa.int64(), pa.binary(), pa.binary()))], names=["key", "id", "pattern", "at", "x"])

    draw = (F.xxhash64(F.lit(seed), "id", "text") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    # features are made where the texts are, so only rows of bounded size are ordered
    drawn = texts.where(draw < min(1.0, 1.2 * sample / max(1, total))).select(F.xxhash64(F.lit(seed + 1), "id", "text").alias("key"), "id", "text")
    found = drawn.mapInArrow(features, "key long, id string, pattern long, at binary, x binary").orderBy("key", "id").limit(sample).toPandas()
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(x, "<f4").astype(float)) for a, x in zip(found["at"], found["x"], strict=True)]
    target = labels.posterior(np.array([_pattern(c) for c in found["pattern"]], np.int64).reshape(-1, LABELLERS)) if rows else np.zeros(0)
    return Model(labels, fit_scorer(rows, target))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, posterior, score, keep) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            posterior, scores = [], []
            for text in batch.column(1).to_pylist():
                if not text:
                    posterior.append(0.0)
                    scores.append(0.0)
                    continue
                raw = _raw(text)
                posterior.append(float(shared.value.labels.posterior(np.array([votes(text, raw)]))[0]))
                scores.append(shared.value.score(text, raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(posterior, pa.float64()), pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())], names=["id", "posterior", "score", "keep"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, posterior double, score double, keep boolean").withColumnRenamed("id", id_col)
