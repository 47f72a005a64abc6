"""Conversations as sorted runs of rows, however long one of them is.

Rows are dealt by ranges of (conversation, turn, digest) and sorted within each
range, so a conversation that holds a third of all rows spreads over as many
tasks as its rows deserve.  A task reads its range as segments of bounded size;
a conversation that lies within one range and one segment is called whole, and
only the others need a second step, in which segments meet by conversation.

Order of a conversation's rows: by turn, nulls first; rows of one turn by a
digest of role and text, so that equal rows are adjacent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and characters after which a segment ends.
SEGMENT_ROWS = 2048
SEGMENT_CHARS = 1 << 20


def digest(role: Column, text: Column) -> Column:
    """32 bytes that are equal for equal roles and texts; nulls differ from every string."""
    parts = [F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in (role, text)]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(p, F.lit("-")) for p in parts)), 256))


def in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows dealt by ranges of conv, turn and digest and sorted by them and then ``ties``; equal keys share a range."""
    keys = ["conv", "turn", "digest"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys, *ties)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def segments(sorted_rows: Iterable[tuple], text_at: int) -> Iterator[tuple[object, int, bool, list[tuple]]]:
    """(conversation, place, whole, rows) of one sorted range; places rise within a conversation and from range to range."""
    place = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    chars, begun, alone, conv = 0, False, False, None
    for row in sorted_rows:
        if begun and row[0] != conv:
            yield conv, place, alone, rows
            # what follows the first conversation of the range began in this range
            place, rows, chars, alone = place + 1, [], 0, True
        elif len(rows) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
            yield conv, place, False, rows
            place, rows, chars, alone = place + 1, [], 0, False
        conv, begun = row[0], True
        rows.append(row)
        chars += len(row[text_at] or "")
    if begun:
        yield conv, place, False, rows
