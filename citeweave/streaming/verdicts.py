"""Streams of verdicts and of work to do."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, FractionalType, IntegralType, TimestampType

from citeweave.operators import records


def new_only(stream: DataFrame, key: str, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen before within the watermark: a resumed run skips what is done."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def running_consensus(stream: DataFrame, item: str, time_col: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Votes and confidence per item and window; all parts are mergeable, so late passes simply add up."""
    says = F.col("decision") == "PASS"
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window), item)
        .agg(F.count("*").alias("n_passes"), F.count(F.when(says, 1)).alias("votes_pass"), F.sum(F.when(says, F.col("confidence")).otherwise(0.0)).alias("for_pass"), F.sum(F.when(~says, F.col("confidence")).otherwise(0.0)).alias("for_drop"))
    )


#: What a stream keeps of an item: its passes by number as JSON, and whether it was given out.
_STATE = "passes string, done boolean"


def complete_passes(stream: DataFrame, item: str, pass_col: str, time_col: str, expected: int, wait: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """All passes of an item at once, as soon as ``expected`` passes of different numbers are there.

    State is kept by item: the passes seen so far, each number once (of repeats the first to
    arrive).  An item that waits longer than ``wait`` after its last pass, by the watermark of
    ``time_col``, is given out with what it has.  Items given out are remembered for as long, so
    that repeated and late passes don't make a second verdict; passes later than ``delay`` behind
    the watermark are dropped by Spark, so it must cover how late they come.  The rows have the
    stream's columns.
    """
    schema = stream.schema
    kinds = {f.name: f.dataType for f in schema.fields}
    hold = _milliseconds(wait)

    def step(key, frames, state: GroupState):
        passes, done = state.get if state.exists else ("{}", False)
        held = json.loads(passes)
        if state.hasTimedOut:
            state.remove()
            if not done and held:
                yield _frame(held.values(), kinds)
            return
        latest = state.getCurrentWatermarkMs()
        for frame in frames:
            times = frame.pop("_millis").dropna()
            latest = max(latest, int(times.max())) if len(times) else latest
            for row in json.loads(frame.to_json(orient="records", date_format="iso", date_unit="us")):
                held.setdefault(str(row[pass_col]), row)
        ready = not done and len(held) >= expected
        if ready:
            yield _frame(held.values(), kinds)
        state.update(("{}" if done or ready else json.dumps(held), done or ready))
        state.setTimeoutTimestamp(latest + hold + 1)

    return (
        stream.withWatermark(time_col, delay)
        .withColumn("_millis", F.unix_millis(time_col))
        .groupBy(item)
        .applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _milliseconds(text: str) -> int:
    number, unit = text.split()
    return int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def _frame(rows, kinds) -> pd.DataFrame:
    """Rows kept as JSON as a frame of the stream's types."""
    frame = pd.DataFrame(list(rows), columns=list(kinds))
    for name, kind in kinds.items():
        if isinstance(kind, TimestampType):
            frame[name] = pd.to_datetime(frame[name], utc=True).dt.tz_localize(None)
        elif isinstance(kind, BooleanType):
            frame[name] = frame[name].astype("object").where(frame[name].notna(), None)
        elif isinstance(kind, IntegralType):
            frame[name] = frame[name].astype("Int64")
        elif isinstance(kind, FractionalType):
            frame[name] = frame[name].astype("float64")
    return frame


def judged(stream: DataFrame, sink: str, checkpoint: str, expected: int, time_col: str = "ts", verdict: Callable[[DataFrame], DataFrame] = records.judge_verdicts, wait: str = "10 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """Verdicts of a stream of passes (item, pass_no, time, ...): each item once, the same as of a table of the same passes.

    :func:`complete_passes` brings an item's passes together, so that ``verdict``, a function of
    tables, judges whole items; its rows are appended by :func:`append_batches`.
    """
    whole = complete_passes(stream, "item", "pass_no", time_col, expected, wait, delay)
    return append_batches(whole, sink, checkpoint, verdict)


def append_batches(stream: DataFrame, sink: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> StreamingQuery:
    """Append each batch once: it goes to a folder named by its number, which a repeated batch replaces."""

    def write(rows: DataFrame, batch: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def append_new(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str) -> None:
    """Process the files that arrived since the last call and append the first row of each new key.

    Keys seen are state of the stream, kept by key beside its checkpoint: a batch reads its own
    rows and their keys' state, never the sink.
    """
    rows = spark.readStream.schema(schema).json(source).dropDuplicates([key])
    append_batches(rows, sink, checkpoint).awaitTermination()
