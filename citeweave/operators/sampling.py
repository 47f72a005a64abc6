"""Which references go on: the sampling modes behind one door, and samples of other kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import xrefs

MODES = ("random", "low_overlap", "multi_ref_source", "target_definition_or_condition", "mixed_difficulty", "hard_enriched")


def any_of(*names: str) -> Column:
    """Whether any of the flags is set."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in names])


def sample(rows: DataFrame, n: int, mode: str = "random", seed: int = 13, key: tuple[str, ...] = ("seq",), low_overlap: float = xrefs.LOW_OVERLAP, weights: dict[str, float] | None = None) -> tuple[DataFrame, dict]:
    """Rows with features, sampled by one of ``MODES``, and a report; all rows where n is 0 or enough.

    The rows are read several times, so what is costly to compute should be written before.
    """
    if mode not in MODES:
        raise ValueError(f"sampling mode must be one of {MODES}, not {mode!r}")
    tagged = rows.withColumn("low_overlap", F.col("jaccard") < low_overlap)
    total = tagged.count()
    report = {"mode": mode, "requested": n, "candidates": total, "seed": seed, "no_sampling_applied": n <= 0 or n >= total}
    if report["no_sampling_applied"]:
        return tagged, report | {"sampled": total, "buckets": {}}
    if mode == "random":
        out, bucket = xrefs.sample_random(tagged, n, seed, *key), F.lit("random")
    elif mode == "low_overlap":
        out, bucket = xrefs.sample_low_overlap(tagged, n, *key), F.lit("low_overlap")
    elif mode == "multi_ref_source":
        out, bucket = xrefs.sample_matching(tagged, F.col("out_refs") > 1, n, seed, *key), F.when(F.col("out_refs") > 1, mode).otherwise("random_fill")
    elif mode == "target_definition_or_condition":
        match = any_of("has_definition", "has_exception")
        out, bucket = xrefs.sample_matching(tagged, match, n, seed, *key), F.when(match, mode).otherwise("random_fill")
    elif mode == "mixed_difficulty":
        out, bucket = xrefs.sample_mixed(tagged, n, seed, *key, weights=weights or xrefs.BUCKET_WEIGHTS), F.col("bucket")
    else:
        out, bucket = xrefs.sample_hard(tagged, n, *key), F.when(F.col("picked") == 0, "diverse").otherwise("by_score")
    counts = {r[0]: r[1] for r in out.groupBy(bucket.alias("b")).agg(F.count("*")).collect()}
    return out, report | {"sampled": sum(counts.values()), "buckets": counts}


def unique_targets(refs: DataFrame, n: int, seed: int = 13, order: str = "seq") -> DataFrame:
    """A sample of references with different targets, the first of each target standing for it."""
    rest = [c for c in refs.columns if c not in ("target_id", order)]
    first = refs.where(~T.absent(F.col("target_id").cast("string"))).groupBy("target_id").agg(F.min(F.struct(order, *rest)).alias("r")).select("target_id", "r.*")
    return first.orderBy(T.draw(seed, F.col("target_id")), "target_id").limit(n)


def capped(rows: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """The first n rows in their order; all where n is 0."""
    return rows.orderBy(order).limit(n) if n > 0 else rows
