"""Conversation structure repair by a dynamic programme over retained subsequences.

A conversation's rows shall read ``(s?(ua)+)?`` by the initials of their roles.
A row may be kept (free), given the role user or assistant (2) or deleted (3, and
blank or repeated rows must be); empty rows of user or assistant may be inserted
anywhere (2); a truncated row that is not deleted costs 1.

The programme chooses which rows are retained, kept or reroled.  Between two
retained neighbours all rows are deleted, which prefix sums of the deletion price
charge in one subtraction, and their two roles alone say what is inserted (the
opposite turn between two equal ones).  So one running minimum per role of the
last retained row, its cost less the prefix sum, prices every gap.  Of equally
cheap repairs the one of the least audit wins: each minimum carries the rank of
its audit (D delete, I insert, K keep, R rerole) among the others.  Inserts are
written straight before the next retained row, which is where the least audit has
them; then audits of the same rows are never prefixes of one another, so ranks
and the letters that follow decide every comparison.

A conversation that spreads over several segments (see ``turns``) is repaired in
two steps: each segment gives its cheapest repair from each role before it to
each role behind it with ranks, a few numbers; these meet by conversation, the
best chain is chosen, and then the segments' contents stream through the digest
in order, one at a time.

Which rows repeat an earlier role and text is found without a join: an aggregate
gives the first row of each (conversation, role, text), and these marks are dealt
and sorted with the rows, so each mark stands straight before its row.

Cases: null text, role, conversation id or turn are one space in the damage and its
key; null turns come first; rows of one turn are ordered as in ``turns``; an initial
other than s, u, a (an empty role has none) cannot be kept; a null conversation
id is a conversation of its own; an empty table gives an empty table; columns other
than the four are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .storage import settle
from .turns import SEGMENT_ROWS, digest, in_order, rows_of, segments

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
_OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NEVER = 1 << 60
# rows inserted between a last retained role and the next one, or the end
_BETWEEN = {
    (START, SYSTEM): 0,
    (START, USER): 0, (SYSTEM, USER): 0, (ASSISTANT, USER): 0, (USER, USER): 1,
    (USER, ASSISTANT): 0, (START, ASSISTANT): 1, (SYSTEM, ASSISTANT): 1, (ASSISTANT, ASSISTANT): 1,
}
_AT_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_INTO = {r: [(q, n) for (q, to), n in _BETWEEN.items() if to == r] for r in (SYSTEM, USER, ASSISTANT)}


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies): rows with a fault each by a checksum of their key; 0 copies where the row is dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return conversations.select(
        F.col("conv_id").alias("conv"),
        F.col("turn").try_cast("long").alias("turn"),
        F.when(fault == 4, F.lit("user")).otherwise(text("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, F.lit(0)).when(fault == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )


def _options(initial: str, truncated: bool) -> list[tuple[int, int, str]]:
    """(role, price, letter) of retaining a row."""
    more = TRUNCATED if truncated else 0
    own = _OF_INITIAL.get(initial)
    out = [(own, more, "K")] if own is not None else []
    return out + [(r, REROLE + more, "R") for r in (USER, ASSISTANT) if r != own]


class Repair:
    """The cheapest repairs of some rows from one role before them to each role behind them."""

    def __init__(self, rows: list[tuple[str, bool, bool]], entry: int):
        """``rows``: (initial, whether it must go, whether it is truncated) each."""
        # per last retained role: cost less the deletion price of all rows so far, and the rank of its audit
        least, rank = [_NEVER] * 4, [0] * 4
        least[entry] = 0
        self.steps: list[list[tuple[int, str]] | None] = []
        for initial, gone, truncated in rows:
            if gone:
                self.steps.append(None)
                continue
            best = [(least[q], rank[q], "D", q) for q in STATES]
            for role, price, letter in _options(initial, truncated):
                for q, inserted in _INTO[role]:
                    if least[q] < _NEVER:
                        option = (least[q] + price + INSERT * inserted - DELETE, rank[q], "I" * inserted + letter, q)
                        if option < best[role]:
                            best[role] = option
            order = sorted({b[1:3] for b in best if b[0] < _NEVER})
            least = [b[0] for b in best]
            rank = [order.index(b[1:3]) if b[0] < _NEVER else 0 for b in best]
            self.steps.append([(b[3], b[2]) for b in best])
        self.cost = [c + DELETE * len(rows) if c < _NEVER else _NEVER for c in least]
        self.rank = rank

    def audit(self, last: int) -> str:
        """The letters of the repair that ends in role ``last``."""
        out = []
        for step in reversed(self.steps):
            if step is None:
                out.append("D")
            else:
                last, letters = step[last]
                out.append(letters)
        return "".join(reversed(out))


def chain(tables: list[np.ndarray]) -> tuple[int, list[tuple[int, int]]]:
    """The cost of the cheapest repair of segments in a row, and (role before, role behind) of each segment in it.

    ``tables``: 16 costs and 16 ranks by role before and role behind.
    """
    least, rank = [0] + [_NEVER] * 3, [0] * 4
    steps = []
    for table in tables:
        costs, ranks = table[:16].tolist(), table[16:].tolist()
        best = []
        for t in STATES:
            ways = [(least[s] + costs[4 * s + t], rank[s], ranks[4 * s + t], s) for s in STATES if least[s] < _NEVER and costs[4 * s + t] < _NEVER]
            best.append(min(ways, default=(_NEVER, 0, 0, t)))
        order = sorted({b[1:] for b in best if b[0] < _NEVER})
        least = [b[0] for b in best]
        rank = [order.index(b[1:]) if b[0] < _NEVER else 0 for b in best]
        steps.append(tuple(b[3] for b in best))
    cost, _, last = min((least[t] + INSERT * _AT_END[t], rank[t], t) for t in STATES if least[t] < _NEVER)
    ways = []
    for step in reversed(steps):
        ways.append((step[last], last))
        last = step[last]
    return cost, ways[::-1]


def repaired(audit: str, roles: list[str], texts: list[str | None], last: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows an audit leaves, the last retained role before them being ``last``."""
    k = 0
    for letter in audit:
        if letter != "D":
            due = ASSISTANT if last == USER else USER
            if letter == "I":
                yield NAMES[due], ""
                last = due
                continue
            if letter == "R":
                yield NAMES[due], texts[k] or ""
                last = due
            else:
                yield roles[k], texts[k] or ""
                last = _OF_INITIAL[roles[k][0]]
        k += 1


class Counts:
    """Faults, gaps and illegal neighbours of rows in order; parts of a conversation can be added up."""

    FIELDS = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")
    _LEGAL = ("su", "ua", "au")

    def __init__(self, low=None, high=None, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, first=None, last=None):
        self.low, self.high, self.turns = low, high, turns
        self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last = blank, duplicate, truncated, illegal, first, last

    def add(self, other: Counts) -> None:
        """Count the rows of ``other``, which come behind these."""
        if other.first is None:
            return
        if self.last is not None and self.last + other.first not in self._LEGAL:
            self.illegal += 1
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.first, self.last = other.first if self.first is None else self.first, other.last
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def values(self) -> tuple:
        return tuple(getattr(self, name) for name in self.FIELDS)


def with_firsts(sorted_rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, turn, role, text, copies, shape, first): rows without the marks, each saying whether a mark stood before it."""
    first = False
    for conv, turn, kind, role, text, copies, shape in sorted_rows:
        if kind == 0:
            first = True
            continue
        yield conv, turn, role, text, copies, shape, first
        first = first and copies == 0


def judged(rows: list[tuple]) -> tuple[Counts, list[tuple[str, bool, bool]], list[str], list[str | None]]:
    """Counts, rows for :class:`Repair`, roles and texts (null where the row must go) of a segment.

    ``rows`` are those of :func:`with_firsts`; ``shape`` is 0 for blank texts, 1 for truncated ones, 2 for others.
    """
    counts, facts, roles, texts = Counts(), [], [], []
    for _, turn, role, text, copies, shape, first in rows:
        for copy in range(copies):
            initial = role[:1]
            blank, duplicate = shape == 0, shape != 0 and not (first and copy == 0)
            truncated = shape == 1 and not duplicate
            counts.add(Counts(turn, turn, turn is not None, blank, duplicate, truncated, 0, initial, initial))
            facts.append((initial, blank or duplicate, truncated))
            roles.append(role)
            texts.append(None if blank or duplicate else text)
    return counts, facts, roles, texts


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = "struct<low:long,high:long,turns:long,blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string>"
_PIECE = f"whole boolean, place long, step int, counts {_COUNTS}, costs array<long>, ranks array<long>, audits array<string>, roles array<string>, texts array<string>"
_RESULT_NAMES = [f.split(" ")[0] for f in RESULT.split(", ")]


def _result(counts: Counts, cost: int, audit: str, digested: str) -> dict:
    return dict(zip(_RESULT_NAMES, (counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, cost, audit, digested), strict=True))


class _Text:
    """The digest of repaired rows, one by one."""

    def __init__(self):
        self.digest, self.begun = hashlib.sha256(), False

    def feed(self, rows: Iterator[tuple[str, str]]) -> None:
        for role, text in rows:
            self.digest.update(("\n" * self.begun + f"{role}:{text}").encode())
            self.begun = True


def _whole(rows: list[tuple]) -> dict:
    """The result of a conversation in one segment."""
    counts, facts, roles, texts = judged(rows)
    best = Repair(facts, START)
    cost, _, last = min((best.cost[t] + INSERT * _AT_END[t], best.rank[t], t) for t in STATES if best.cost[t] < _NEVER)
    audit, text = best.audit(last) + "I" * _AT_END[last], _Text()
    text.feed(repaired(audit, roles, texts, START))
    return {"whole": True} | _result(counts, cost, audit, text.digest.hexdigest())


def _pieces(rows: list[tuple], place: int) -> list[dict]:
    """A segment's summary and its content with the audits of all its repairs."""
    counts, facts, roles, texts = judged(rows)
    ways = [Repair(facts, s) for s in STATES]
    audits = [w.audit(t) if w.cost[t] < _NEVER else None for w in ways for t in STATES]
    summary = {"whole": False, "place": place, "step": 0, "counts": dict(zip(Counts.FIELDS, counts.values(), strict=True))}
    summary |= {"costs": [c for w in ways for c in w.cost], "ranks": [r for w in ways for r in w.rank]}
    return [summary, {"whole": False, "place": place, "step": 1, "audits": audits, "roles": roles, "texts": texts}]


class _Joining:
    """One conversation of several segments: summaries first, then the contents; holds 32 numbers a segment and one content."""

    def __init__(self, conv):
        self.conv, self.counts, self.tables = conv, Counts(), []
        self.ways, self.at, self.text, self.audits = None, 0, _Text(), []

    def feed(self, piece: dict) -> None:
        if piece["step"] == 0:
            self.counts.add(Counts(**piece["counts"]))
            self.tables.append(np.array(piece["costs"] + piece["ranks"], np.int64))
            return
        if self.ways is None:
            self.cost, self.ways = chain(self.tables)
        before, behind = self.ways[self.at]
        audit = piece["audits"][4 * before + behind]
        self.audits.append(audit)
        self.text.feed(repaired(audit, piece["roles"], piece["texts"], before))
        self.at += 1

    def result(self) -> dict:
        last = self.ways[-1][1]
        end = "I" * _AT_END[last]
        self.text.feed(repaired(end, [], [], last))
        return {"conv_id": self.conv} | _result(self.counts, self.cost, "".join([*self.audits, end]), self.text.digest.hexdigest())


def _joined(pieces: Iterator[dict]) -> Iterator[dict]:
    """Results of conversations in several segments, sorted by conversation, step and place."""
    state = None
    for piece in pieces:
        if state is not None and piece["conv_id"] != state.conv:
            yield state.result()
            state = None
        state = state or _Joining(piece["conv_id"])
        state.feed(piece)
    if state is not None:
        yield state.result()


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows as :func:`damaged` returns them."""
    kind = rows.schema["conv"].dataType.simpleString()
    piece_ddl, result_ddl = f"conv_id {kind}, {_PIECE}, {RESULT}", f"conv_id {kind}, {RESULT}"
    piece_schema, result_schema = (to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (piece_ddl, result_ddl))

    visible = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    shape = F.when(visible == "", 0).when(F.substring(visible, -1, 1).isin(".", "!", "?"), 2).otherwise(1)
    named = rows.withColumn("digest", digest(F.col("role"), F.col("text")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    marks = named.where("copies > 0").groupBy("conv", "digest").agg(F.min(place).alias("first"))
    marks = marks.selectExpr("conv", "first.turn as turn", "digest", "0 as kind", "cast(null as string) as role", "cast(null as string) as text", "0 as copies")
    both = named.select("conv", "turn", "digest", F.lit(1).alias("kind"), "role", "text", "copies").unionAll(marks)
    dealt = in_order(both, "kind").select("conv", "turn", "kind", "role", "text", "copies", shape.alias("shape"))

    def begin(batches):
        held, size = [], 0
        for conv, place, whole, found in segments(with_firsts(rows_of(batches)), text_at=3):
            made = [_whole(found)] if whole else _pieces(found, place)
            held += [{"conv_id": conv} | m for m in made]
            size += 1 if whole else len(found)
            if size >= SEGMENT_ROWS:
                yield pa.RecordBatch.from_pylist(held, piece_schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, piece_schema)

    def end(batches):
        for row in _joined(piece for batch in batches for piece in batch.to_pylist()):
            yield pa.RecordBatch.from_pylist([row], result_schema)

    table, _ = settle(dealt.mapInArrow(begin, piece_ddl), "turn-repair")
    within = table.where("whole").select("conv_id", *_RESULT_NAMES)
    across = table.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "step", "place")
    across = across.select("conv_id", "step", "counts", "costs", "ranks", "audits", "roles", "texts")
    return within.unionAll(across.mapInArrow(end, result_ddl))


def repair_damage(conversations: DataFrame) -> DataFrame:
    """:func:`repair` of :func:`damaged` conversations."""
    return repair(damaged(conversations))
