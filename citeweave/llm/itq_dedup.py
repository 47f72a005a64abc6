"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

For each vector length, unit vectors are centred, and a rotation of their
principal components is learned so that signs of the rotated vectors form
balanced binary codes (on at most ``sample`` vectors, a documented bound).
Codes are cut into substrings; each is the key of one hash table, and all
vectors are in all tables.  Two vectors that share a substring are compared by
the cosine of the originals in double precision.

Each length has a plan of its own: substrings have about log2(vectors of its
largest label) bits, five fewer where that label fits one block, so buckets stay
small at any size, and there are as many
tables (and rotations, where one code has too few bits) as it takes for the
share ``recall`` of trial pairs just at the threshold to meet.  Trial pairs are
sampled vectors moved in directions of any kind and in directions in which the
data differ, whichever meet more rarely.  Closer pairs are found more surely.
Where even substrings of one bit reach less than ``LEAST_RECALL`` in
``MOST_TABLES`` tables, all pairs of each label are compared, by blocks.

Equal vectors of one label become one class with a count.  Buckets of more than
``BLOCK`` classes are dealt out as pairs of blocks, so no task holds more than
two blocks of a bucket.  Links are counted where they are found, in the first
table in which both meet; tasks return counts and the local spanning forest,
never all pairs.

Cases: a null label, a null, empty or zero vector, one with null or non-finite
components and a row without an id link with nothing (its component is its id);
vectors of different length are never compared; rows that repeat a vector count
as other vectors; an empty table gives an empty table; extra columns are
dropped; vectors are scaled by powers of two, so large ones don't overflow.
The driver holds one plan for each distinct length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, partitions, settle

BLOCK = 512
SAMPLE = 4096
BITS = 64
TRIALS = 1000
MOST_TABLES = 64
LEAST_RECALL = 0.9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by powers of two first, which is exact."""
    _, exponent = np.frexp(np.abs(vectors).max(1, initial=0))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def learn_rotation(vectors: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """(dimension, bits) projection of centred vectors: principal components, rotated for least quantisation error."""
    rng = np.random.default_rng(seed)
    values, axes = np.linalg.eigh(vectors.T @ vectors / len(vectors))
    axes = axes[:, np.argsort(-values)[:bits]]
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    projected = vectors @ axes
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(codes.T @ projected)
        rotation = (u @ v).T
    return axes @ rotation


def substrings(vectors: np.ndarray, projections: list[np.ndarray], width: int, tables: int) -> np.ndarray:
    """(vectors, tables) substrings of the binary codes of centred vectors."""
    weights = 1 << np.arange(width)
    out = []
    for p in projections:
        code = (vectors @ p >= 0).astype(np.int64)
        out += [code[:, k * width : (k + 1) * width] @ weights for k in range(p.shape[1] // width)]
    return np.stack(out[:tables], 1)


def trial_pairs(units: np.ndarray, threshold: float, rng) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sampled vectors and others just at the threshold, moved anyhow and as the data differ."""
    x = units[rng.integers(0, len(units), TRIALS)]
    out = []
    for way in (rng.standard_normal(x.shape), x[rng.permutation(TRIALS)] - x[rng.permutation(TRIALS)] + 1e-9 * rng.standard_normal(x.shape)):
        way = way - (way * x).sum(1)[:, None] * x
        size = np.linalg.norm(way, axis=1)
        on = size > 1e-12
        out.append((x[on], threshold * x[on] + np.sqrt(max(0.0, 1 - threshold * threshold)) * way[on] / size[on][:, None]))
    return out


class Plan:
    """How vectors of one length are cut into substrings; ``recall`` is that of the trial pairs."""

    def __init__(self, units: np.ndarray, largest: int, threshold: float, recall: float, seed: int):
        self.projections: list[np.ndarray] = []
        self.mean = units.mean(0)
        self.bits, centred = min(BITS, units.shape[1]), units - self.mean
        trials = [(x - self.mean, y - self.mean) for x, y in trial_pairs(units, threshold, np.random.default_rng(seed))]
        trials = [(x, y) for x, y in trials if len(x)]
        size = round(math.log2(max(2, largest)))
        # what fits a block is compared in one piece, so buckets of small labels may hold some 32 vectors
        self.width = min(self.bits, 31, max(0, size - 5) if largest <= BLOCK else max(8, size))
        self.tables, self.recall = 1, 1.0
        while self.width and not self._reach(recall, trials, lambda: learn_rotation(centred, self.bits, seed + len(self.projections))):
            if self.width == 1:
                break
            self.width = max(1, self.width - 2)
        if self.recall < LEAST_RECALL:  # all pairs of a label instead
            self.width, self.tables, self.recall, self.projections = 0, 1, 1.0, []

    def _reach(self, recall: float, trials, learn) -> bool:
        """Add tables until trial pairs of each kind meet in one of them often enough; projections are learned as they are needed."""
        each = self.bits // self.width
        met = [np.zeros(len(x), bool) for x, _ in trials]
        for k in range(MOST_TABLES):
            if k // each == len(self.projections):
                self.projections.append(learn())
            if k % each == 0:
                sides = [[substrings(v, [self.projections[k // each]], self.width, each) for v in pair] for pair in trials]
            for seen, (x, y) in zip(met, sides, strict=True):
                seen |= x[:, k % each] == y[:, k % each]
            self.tables, self.recall = k + 1, float(min((m.mean() for m in met), default=1.0))
            if self.recall >= recall and self.tables >= 4:
                del self.projections[-(-self.tables // each) :]
                return True
        return False

    def codes(self, units: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros((len(units), 1), np.int64)
        return substrings(units - self.mean, self.projections, self.width, self.tables)


def block_links(x: np.ndarray, y: np.ndarray, sub_x: np.ndarray, sub_y: np.ndarray, table: int, threshold: float) -> np.ndarray:
    """Linked pairs of unit vectors that meet in this table first."""
    found = x @ y.T >= threshold
    for k in range(table):
        found &= sub_x[:, k][:, None] != sub_y[:, k][None, :]
    return found


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) of each component of a symmetric boolean matrix."""
    out, free = [], np.ones(len(links), bool)
    for root in np.flatnonzero(links.any(1)).tolist():
        if not free[root]:
            continue
        free[root] = False
        reached = np.zeros(len(links), bool)
        reached[root] = True
        edge = reached
        while edge.any():
            edge = links[edge].any(0) & ~reached
            reached |= edge
        reached[root] = False
        free &= ~reached
        out += [(root, m) for m in np.flatnonzero(reached).tolist()]
    return out


def _codes(plans: dict[int, Plan]):
    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(2))
            subs: list = [None] * len(size)
            rows = batch.column(4)
            for dimension in np.unique(size).tolist():
                on = np.flatnonzero(size == dimension)
                flat = rows.take(pa.array(on)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(on), dimension)
                for k, row in zip(on.tolist(), plans[dimension].codes(unit(flat)), strict=True):
                    subs[k] = row
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(subs, pa.list_(pa.int64())), rows], names=["cls", "label", "size", "n", "subs", "vector"])

    return run


def _match(threshold: float):
    def handle(table, first, second, rows):
        vectors = unit(np.array(rows["vector"].tolist(), np.float64))
        subs = np.array(rows["subs"].tolist(), np.int64)
        cls, count, block = (np.asarray(rows[c], np.int64) for c in ("cls", "n", "block"))
        if first == second:
            links = block_links(vectors, vectors, subs, subs, table, threshold)
            np.fill_diagonal(links, False)
        else:
            x, y = block == first, block == second
            links = np.zeros((len(cls), len(cls)), bool)
            links[np.ix_(x, y)] = block_links(vectors[x], vectors[y], subs[x], subs[y], table, threshold)
            links |= links.T
        number = links @ count
        on = np.flatnonzero(number)
        for k in on.tolist():
            yield int(cls[k]), None, int(number[k])
        for a, b in forest(links):
            yield int(cls[a]), int(cls[b]), 0

    def run(batches):
        key, held = None, []
        names = ["tab", "bucket", "first", "second"]

        def emit():
            import pandas as pd

            rows = pd.concat(held) if len(held) > 1 else held[0]
            # a bucket is a hash: labels and lengths decide who is compared
            label, size = rows["label"].to_numpy(), rows["size"].to_numpy()
            parts = [rows] if (label == label[0]).all() and (size == size[0]).all() else [part for _, part in rows.groupby(["label", "size"], sort=False)]
            out = [x for part in parts for x in handle(key[0], key[2], key[3], part)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

        for batch in batches:
            frame = batch.to_pandas()
            keys = frame[names].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(frame)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = tuple(keys[a].tolist())
                if now != key and held:
                    if sum(map(len, held)) > 1:
                        yield emit()
                    held = []
                key = now
                held.append(frame.iloc[a:b])
        if held and sum(map(len, held)) > 1:
            yield emit()

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.98, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    n = partitions(spark)
    limit = F.lit(float("inf"))
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    paths = []

    def keep(df, name):
        out, path = settle(df, name)
        paths.append(path)
        return out

    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    usable = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("vector", sound) & F.exists("vector", lambda v: v != 0), F.lit(False))
    key = [F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2")]
    good = rows.where(usable).select("id", "label", F.size("vector").alias("size"), *key, "vector")
    classes = keep(good.groupBy("label", "size", "k1", "k2").agg(F.min("id").alias("cls"), F.count("*").alias("n"), F.first("vector").alias("vector")), "vector-classes")
    # one row for each label and length, then for each length; a vector alone in both has nobody to meet
    members = keep(classes.groupBy("label", "size").agg(F.count("*").alias("m")).where("m > 1"), "vector-groups")
    meeting = classes.join(members.select("label", "size"), ["label", "size"], "left_semi")
    plans = {}
    for size, largest, total in members.groupBy("size").agg(F.max("m"), F.sum("m")).collect():
        drawn = meeting.where((F.col("size") == size) & (F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(1_000_003)) < min(1.0, 1.2 * sample / total) * 1_000_003 + 1))
        fit = np.array(drawn.orderBy(F.xxhash64("cls", F.lit(seed)), "cls").limit(sample).select("vector").toPandas()["vector"].tolist(), np.float64)
        if len(fit):
            plans[size] = Plan(unit(fit), largest, threshold, recall, seed)
    planned = meeting.where(F.col("size").isin(*plans)) if plans else meeting.where(F.lit(False))
    coded = keep(planned.select("cls", "label", "size", "n", "vector").mapInArrow(_codes(plans), f"cls long, label string, size int, n long, subs array<long>, vector array<{kind}>"), "codes")
    entries = coded.select("cls", "label", "size", F.posexplode("subs").alias("tab", "part")).select("cls", "tab", F.xxhash64("label", "size", "tab", "part").alias("bucket"))
    # written first, so that the join can split a hot bucket
    counts = keep(entries.groupBy("tab", "bucket").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks.cast("long")).cast("int")
    placed = entries.join(counts, ["tab", "bucket"]).withColumn("blocks", blocks).withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.withColumn("other", other).select("cls", "tab", "bucket", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    # a class meets its own block once: block pairs (b, b) come from other = b alone
    full = dealt.join(coded, "cls")
    order = ["tab", "bucket", "first", "second"]
    found = keep(full.repartition(n, *order).sortWithinPartitions(*order).select(*order, "block", "cls", "label", "size", "n", "subs", "vector").mapInArrow(_match(threshold), "a long, b long, links long"), "matches")
    groups, temporary = components(found.where("b is not null"))
    paths += temporary
    number = found.where("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    of_class = classes.select("label", "size", "k1", "k2", "cls", "n").join(number.withColumnRenamed("a", "cls"), "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    # also written first, for vectors with many copies
    of_class = keep(of_class.select("label", "size", "k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id")), "class-links")
    joined = good.select("id", "label", "size", "k1", "k2").join(of_class, ["label", "size", "k1", "k2"])
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = joined.select("id", "n_links", "component_id").unionByName(alone)
    result, _ = settle(out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")), "vector-links")
    discard(spark, *paths)
    return result
