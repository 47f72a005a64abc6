"""Chat formatting by a grammar round trip.

A template gives each role an opening and a closing mark; roles it doesn't name
go between ``other`` marks with their name in front.  The rendered text of a
turn is parsed again by a deterministic parser, and the turn it recovers is
compared with the source.  Content that does not come back is escaped one level
further until it does: first backslashes and control strings, then every
character that begins one of them, then every character.  A backslash takes the
meaning from the character behind it, so escapes can be undone.

The last level is always read back, so the loop ends.  A turn's text decides
alone how it is parsed, since the parser is at the same state after every turn;
hence turns are compared one by one, and pieces of a conversation that is too
long for one task can be formatted, parsed and joined in order.

Output (:func:`formatted`): per piece the text and the spans of the loss mask,
in code points of the piece: the content of each turn of a role that is learned,
escapes included, marks excluded.  :func:`recovered` parses pieces back into
turns, and :func:`digests` reads a whole output back without moving what lies in
one piece; the pieces of longer conversations meet in order and are digested
piece by piece, so a task holds one piece at a time.

Cases: null text and null role count as empty; a null conversation id is a
conversation of its own; rows of one turn are ordered as in ``turns``; repeated
rows are repeated turns; an empty table gives an empty table; columns other than
the four are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle, small_batches
from .turns import digest, in_order, rows_of, segments

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks around each role's content; ``learned`` roles are under the loss mask."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
    )
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        opening = [a for a, _ in self.marks.values()] + [self.other[0]]
        if any(not s or ESCAPE in s for s in self.controls):
            raise ValueError("marks must not be empty or hold a backslash")
        if len(set(opening)) < len(opening) or any(a != b and b.startswith(a) for a in self.controls for b in self.controls):
            raise ValueError("opening marks must differ, and no mark may begin with another one")

    @property
    def controls(self) -> list[str]:
        return [*(m for pair in self.marks.values() for m in pair), *self.other]

    @cached_property
    def scanner(self) -> re.Pattern:
        """An escaped character or a control string, the longest one."""
        longest = sorted(set(self.controls), key=len, reverse=True)
        return re.compile(r"\\(.)|(" + "|".join(map(re.escape, longest)) + ")", re.DOTALL)

    @cached_property
    def levels(self) -> list[re.Pattern]:
        """What gets a backslash at each level of escaping."""
        controls = "|".join(map(re.escape, sorted(set(self.controls), key=len, reverse=True)))
        first = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        return [re.compile(p, re.DOTALL) for p in (rf"\\|{controls}", rf"[\\{first}]", ".")]

    def escaped(self, content: str, level: int) -> str:
        return self.levels[level - 1].sub(lambda m: ESCAPE + m[0], content) if level else content

    def turn(self, role: str, text: str, level: int) -> tuple[str, int, int]:
        """A rendered turn and where its content lies."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            before, after = self.other[0] + self.escaped(role, level) + self.other[1], self.other[2]
        content = self.escaped(text, level)
        return before + content + after, len(before), len(before) + len(content)


class GrammarError(ValueError):
    """A text that the template cannot have rendered."""


def _content(template: Template, text: str, at: int, close: str) -> tuple[str, int, int]:
    """(unescaped content, its end, the place behind its closing mark) from ``at``."""
    parts, on = [], at
    for found in template.scanner.finditer(text, at):
        parts.append(text[on : found.start()])
        if found[1] is not None:
            parts.append(found[1])
            on = found.end()
        elif found[2] == close:
            return "".join(parts), found.start(), found.end()
        else:
            raise GrammarError(f"{found[2]!r} at {found.start()} inside a turn")
    raise GrammarError(f"no {close!r} after {at}")


def parse(template: Template, text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the content) of each turn of a rendered text."""
    at = 0
    while at < len(text):
        for role, (mark, close) in template.marks.items():
            if text.startswith(mark, at):
                break
        else:
            if not text.startswith(template.other[0], at):
                raise GrammarError(f"no turn begins at {at}")
            role, _, at = _content(template, text, at + len(template.other[0]), template.other[1])
            mark, close = "", template.other[2]
        start = at + len(mark)
        content, end, at = _content(template, text, start, close)
        yield role, content, start, end


def rendered(template: Template, role: str, text: str) -> tuple[str, int, int]:
    """One turn, escaped until the parser recovers it and nothing else."""
    for level in range(len(template.levels) + 1):
        out, start, end = template.turn(role, text, level)
        try:
            if [*parse(template, out)] == [(role, text, start, end)]:
                return out, start, end
        except GrammarError:
            pass
    raise GrammarError("a template whose marks cannot be told apart")


FORMATTED = "place long, whole boolean, n_turns int, formatted string, loss array<struct<start:int,stop:int>>"


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, place, whole, n_turns, formatted, loss): the rendered pieces of each conversation, in order of ``place``."""
    template = template or Template()
    rows = conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = in_order(rows.withColumn("digest", digest(F.col("role"), F.col("text")))).select("conv", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        held, size = [], 0
        for conv, place, whole, turns in segments(rows_of(batches), text_at=2):
            parts, spans, at = [], [], 0
            for _, role, text in turns:
                out, start, stop = rendered(template, role, text)
                if role in template.learned:
                    spans.append({"start": at + start, "stop": at + stop})
                parts.append(out)
                at += len(out)
            held.append((conv, place, whole, len(turns), "".join(parts), spans))
            size += at
            if size >= 1 << 20 or len(held) >= 1024:
                yield as_batch(held)
                held, size = [], 0
        if held:
            yield as_batch(held)

    conv_type = _arrow_type(conversations, "conv_id")

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        kinds = [conv_type, pa.int64(), pa.bool_(), pa.int32(), pa.string(), spans]
        names = ["conv_id", "place", "whole", "n_turns", "formatted", "loss"]
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def write_formatted(conversations: DataFrame, path: str, template: Template | None = None) -> None:
    """:func:`formatted` as Parquet files."""
    with small_batches(conversations.sparkSession):
        formatted(conversations, template).write.option("compression", "zstd").parquet(path)


def recovered(output: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, place, number, role, text, learned): the turns of formatted pieces, unescaped."""
    template = template or Template()
    kind, conv_type = output.schema["conv_id"].dataType.simpleString(), _arrow_type(output, "conv_id")

    def run(batches):
        kinds = [conv_type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
        names = ["conv_id", "place", "number", "role", "text", "learned"]
        for batch in batches:
            for conv, place, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = {(s["start"], s["stop"]) for s in loss}
                turns = [(conv, place, k, role, content, (a, b) in spans) for k, (role, content, a, b) in enumerate(parse(template, text))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*turns, strict=True), kinds, strict=True)], names=names)

    schema = f"conv_id {kind}, place long, number int, role string, text string, learned boolean"
    return output.select("conv_id", "place", "formatted", "loss").mapInArrow(run, schema)


class _Digest:
    """Counts and digests of one conversation, fed piece by piece."""

    def __init__(self):
        self.turns, self.chars, self.learned = 0, 0, 0
        self.of_turns, self.of_loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, template: Template, text: str, loss: list[dict]) -> None:
        self.chars += len(text)
        spans = iter([(s["start"], s["stop"]) for s in loss])
        due = next(spans, None)
        for role, content, start, stop in parse(template, text):
            self.turns += 1
            self.of_turns.update(f"{role}\n{content}\n".encode())
            if due == (start, stop):
                self.learned += len(content)
                self.of_loss.update(content.encode())
                due = next(spans, None)
        if due is not None:
            raise GrammarError(f"the loss span {due} is no turn's content")

    def row(self, conv) -> tuple:
        return conv, self.turns, self.of_turns.hexdigest(), self.learned, self.of_loss.hexdigest(), self.chars


def digests(output: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from formatted pieces."""
    template = template or Template()
    kind, conv_type = output.schema["conv_id"].dataType.simpleString(), _arrow_type(output, "conv_id")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def one_each(batches):
        for batch in batches:
            rows = []
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = _Digest()
                state.feed(template, text, loss)
                rows.append(state.row(conv))
            if rows:
                yield as_batch(rows)

    def in_pieces(batches):
        state, at = None, None
        for batch in batches:
            for conv, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is not None and conv != at:
                    yield as_batch([state.row(at)])
                    state = None
                state, at = state or _Digest(), conv
                state.feed(template, text, loss)
        if state is not None:
            yield as_batch([state.row(at)])

    within = output.where("whole").select("conv_id", "formatted", "loss").mapInArrow(one_each, schema)
    across = output.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return within.unionAll(across.select("conv_id", "formatted", "loss").mapInArrow(in_pieces, schema))


def round_trip(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Format, write, read the files back and digest what they hold."""
    output, _ = settle(formatted(conversations, template), "chat-format")
    return digests(output, template)
