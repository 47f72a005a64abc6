"""Byte-pair encoding and decoding as streaming transducers.

Encoding.  A merge list has a *sufficient lookahead*: a number of bytes such
that a token ending that far before the end of what has been read can no longer
change, whatever follows.  :func:`sufficient_lookahead` computes it from the
merges, and :class:`Encoder` emits tokens once they are stable, so its window
has a constant size however long a piece of text is.

Why the bound holds: a merge of rank r can only be disturbed from the right by
a merge of a lower rank that takes its last part away, so a disturbance travels
left through merges of strictly rising rank.  One pass over the merges in rank
order adds up the longest such chain in bytes.

Every piece goes through the transducer, and texts longer than ``WINDOW`` are
cut into pieces window by window, so what a task holds besides the text itself
does not grow with it (a text without any safe place to cut in ``_LONGEST``
bytes is read piece by piece instead).  Chunks between spaces that a worker has
met before are looked up by a hash and compared byte by byte.

Decoding.  Bytes of tokens go through an incremental UTF-8 state machine that
holds at most one unfinished character.

Cases: null text counts as empty (no tokens); a special token's string in a
text is that special token; invalid UTF-8 decodes to U+FFFD per maximal
invalid part; rows keep their order and repeated rows give repeated results;
an empty table gives an empty table; columns other than the id and the text
are dropped, so their names cannot clash.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_blocks import blocks, keep_only, kept, random_base, span_hasher

# Fixed value: the splitting pattern of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SLOTS_LOG2 = 20
CACHE_ENTRIES = 400_000  # well under the slots, so that every probe meets a free one
WINDOW = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeList:
    """A vocabulary file's merges by rank, its tokens' bytes and its special tokens."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, of = spec["model"], byte_alphabet()
        ids = model["vocab"]
        size = 1 + max([*ids.values(), *(t["id"] for t in spec.get("added_tokens") or [])])
        self.token_bytes: list[bytes] = [b""] * size
        for token, k in ids.items():
            self.token_bytes[k] = bytes(map(of.__getitem__, token))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        for content, k in self.special.items():
            self.token_bytes[k] = content.encode()
        self.byte_ids = [ids[c] for c, _ in sorted(of.items(), key=lambda kv: kv[1])]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.wholes = [c for _, _, c in self.merges]
        self.follow: list[dict[int, int]] = [{} for _ in range(size)]
        for k, (a, b, _) in enumerate(self.merges):
            self.follow[a].setdefault(b, k)
        self.byte_count = np.array([len(b) for b in self.token_bytes], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.lookahead = sufficient_lookahead(self.merges, [len(b) for b in self.token_bytes])

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, one after another."""
        count = self.byte_count[ids]
        total = np.cumsum(count)
        if not len(ids):
            return b""
        return self.all_bytes[np.repeat(self.byte_start[ids] - (total - count), count) + np.arange(int(total[-1]))].tobytes()


def sufficient_lookahead(merges: list[tuple[int, int, int]], lengths: list[int]) -> int:
    """Bytes past a token's end after which it is stable under this merge list."""
    formed = [0] * len(lengths)  # bytes past a token's end that decide whether it is formed
    taken = [0] * len(lengths)  # bytes past it that decide whether a merge so far takes it away
    for left, right, whole in merges:
        reach = max(formed[right], taken[right], max(formed[left], taken[left]) - lengths[right])
        formed[whole] = max(formed[whole], reach)
        taken[left] = max(taken[left], lengths[right] + reach)
    return max(map(max, formed, taken), default=0)


_NEVER = 1 << 30


def merge_window(ids: list[int], follow: list[dict[int, int]], wholes: list[int]) -> list[int]:
    """All merges over a window of ids, lowest rank first and leftmost first within a rank.

    ``follow[a].get(b)`` is the rank of merging a and b, ``wholes[rank]`` the result.
    """
    n = len(ids)
    if n < 2:
        return ids
    if n <= 64:
        ranks = [follow[a].get(b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (rank := min(ranks)) != _NEVER:
            k = ranks.index(rank)
            ids[k] = whole = wholes[rank]
            del ids[k + 1], ranks[k]
            if k < len(ranks):
                ranks[k] = follow[whole].get(ids[k + 1], _NEVER)
            if k:
                ranks[k - 1] = follow[ids[k - 1]].get(whole, _NEVER)
        return ids
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := follow[ids[k]].get(ids[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, k, a, b = heapq.heappop(heap)
        j = after[k] if ids[k] >= 0 else n
        if j >= n or ids[k] != a or ids[j] != b:
            continue
        ids[k], ids[j] = (whole := wholes[rank]), -1
        after[k] = m = after[j]
        if m < n:
            before[m] = k
            if (r := follow[whole].get(ids[m])) is not None:
                heapq.heappush(heap, (r, k, whole, ids[m]))
        if (p := before[k]) >= 0 and (r := follow[ids[p]].get(whole)) is not None:
            heapq.heappush(heap, (r, p, ids[p], whole))
    return [t for t in ids if t >= 0]


class Encoder:
    """Bytes of one piece in, stable tokens out; holds at most a window and one chunk."""

    def __init__(self, merges: MergeList):
        self.merges, self.window, self.held = merges, 4 * merges.lookahead + 64, bytearray()

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) >= self.window:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        done, limit = 0, len(self.held) - self.merges.lookahead
        for token in self._merged():
            end = done + len(self.merges.token_bytes[token])
            if end > limit:
                break
            yield token
            done = end
        del self.held[:done]

    def _merged(self) -> list[int]:
        return merge_window([self.merges.byte_ids[b] for b in self.held], self.merges.follow, self.merges.wholes)

    def finish(self) -> list[int]:
        rest = self._merged()
        self.held.clear()
        return rest

    def piece(self, data: bytes) -> list[int]:
        return [*self.feed(data), *self.finish()]


class Decoder:
    """Tokens in, text out; holds the bytes of at most one unfinished character."""

    def __init__(self, merges: MergeList):
        self.merges, self.machine = merges, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(self.merges.joined(ids))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def _byte_set(*values: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_ASCII_SPACE = (9, 10, 11, 12, 13, 28, 29, 30, 31, 32)
# last and first bytes that white space may have in UTF-8
_MAY_END_SPACE = _byte_set(*_ASCII_SPACE, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)
_MAY_BEGIN_SPACE = _byte_set(*_ASCII_SPACE, 0xC2, 0xE1, 0xE2, 0xE3)
_LONGEST = 1 << 24
# 1 for ASCII letters, 2 for ASCII marks, 3 for the line feed
_KINDS = np.zeros(256, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
_KINDS[10] = 3


class TextEncoder:
    """Whole texts to ids: special tokens, then chunks between spaces, then a function for each piece.

    The ids of at most CACHE_ENTRIES chunks, those seen first, stand in a hash table that is
    probed for a whole block of texts at once.  A hash only proposes an entry: lengths and
    bytes are compared, and a text with a chunk that differs is cut and encoded by itself.
    """

    def __init__(self, special: dict[str, int], size: int, piece_ids, base: int | None = None):
        self.kind, self.code = ("<u2", "H") if size <= 1 << 16 else ("<u4", "I")
        self.split, self.piece_ids, self.special = regex.compile(PIECES), piece_ids, special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = tuple(special)
        self.mark_bytes = _byte_set(*{m.encode()[0] for m in special if m})
        self.slots, self.shift = 1 << SLOTS_LOG2, 64 - SLOTS_LOG2
        self.base = random_base() if base is None else base
        self.keys, self.entry = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
        # entry k: ids pool[id_at[k]:id_at[k + 1]] of the bytes text[text_at[k]:text_at[k + 1]]
        self.pool, self.id_at = np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    @property
    def entries(self) -> int:
        return len(self.id_at) - 1

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a part of a text that the pattern never joins with its neighbours."""
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return self.piece_ids(chunk)
        return [k for p in self.split.findall(chunk) for k in self.piece_ids(p)]

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        return [self.chunk(c) for c in chunks]

    def _begins(self, data: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Where chunks begin inside texts."""
        kind = _KINDS[data]
        before = np.append(np.uint8(0), kind[:-1])
        # always cut by the pattern: letter|mark, visible|line feed, and a line feed between those and a letter
        broken = (kind == 3) & ((before == 1) | (before == 2))
        begins = space | ((kind == 2) & (before == 1)) | broken
        begins[1:] |= broken[:-1] & (kind[1:] == 1)
        return begins

    def piecewise(self, text: str, step: int = 1 << 16) -> Iterator[np.ndarray]:
        """One text's ids, piece by piece, about ``step`` at a time."""
        out: list[int] = []
        for k, part in enumerate(self.cut.split(text) if any(m in text for m in self.marks) else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for piece in self.split.finditer(part):
                out += self.piece_ids(piece[0])
                if len(out) >= step:
                    yield np.array(out, self.kind)
                    out = []
        yield np.array(out, self.kind)

    def ids(self, text: str) -> np.ndarray:
        """One text's ids, piece by piece."""
        return np.concatenate([*self.piecewise(text)])

    def stream(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """One text's ids, window by window; a window ends where every splitting of the text would."""
        at = 0
        while at < len(data):
            end = self._safe_cut(data, at)
            if end is None:
                yield from self.piecewise(data[at:].tobytes().decode())
                return
            yield self._window_ids(data[at:end], np.array([0, end - at]))[0]
            at = end

    def _safe_cut(self, data: np.ndarray, at: int) -> int | None:
        """The end of the window from ``at``: before a lone space or after a lone line feed, outside special tokens."""
        if len(data) - at <= WINDOW:
            return len(data)
        size = WINDOW
        while size <= _LONGEST:
            part = data[at : at + size]
            lone = ~_MAY_END_SPACE[part[:-2]] & ((part[1:-1] == 32) | (part[1:-1] == 10)) & ~_MAY_BEGIN_SPACE[part[2:]]
            for k in (np.flatnonzero(lone)[::-1] + 1).tolist():
                end = at + k + int(part[k] == 10)
                if not any(m.encode() in data[max(at, end - len(m.encode()) + 1) : end + len(m.encode()) - 1].tobytes() for m in self.marks):
                    return end
            if at + size >= len(data):
                return len(data)
            size *= 2
        return None

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Iterator[np.ndarray]]:
        """For each text of a block, its ids in parts; long texts are streamed."""
        if len(data) > WINDOW:
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                yield self.stream(data[a:b])
            return
        flat, at = self._window_ids(data, offsets)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield iter((flat[x:y],))

    def block_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block and the offsets of each text's ids."""
        if len(data) <= WINDOW:
            return self._window_ids(data, offsets)
        each = [np.concatenate([np.zeros(0, self.kind), *parts]) for parts in self.rows(data, offsets)]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def _window_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        space = data == 32
        begins = self._begins(data, space)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(rows + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        length = ends - starts
        hasher = span_hasher(self.base)
        hashes = hasher.hashes(hasher.sums(data), starts, ends) | np.uint64(1)
        entry = self._probe(hashes)
        pool, id_at, text, text_at = self.pool, self.id_at, self.text, self.text_at
        at = np.flatnonzero(entry < 0)
        if len(at):
            missing, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
            order = np.argsort(first)
            missing, first, inverse = missing[order], first[order], np.argsort(order)[inverse]
            on = at[first]
            new = self.chunks([data[a:b].tobytes().decode() for a, b in zip(starts[on].tolist(), ends[on].tolist(), strict=True)])
            count = np.array([len(x) for x in new], np.int64)
            pool = np.concatenate([pool, np.fromiter((t for x in new for t in x), self.kind, int(count.sum()))])
            id_at = np.concatenate([id_at, id_at[-1] + np.cumsum(count)])
            text = np.concatenate([text, data[_ranges(starts[on], length[on])]])
            text_at = np.concatenate([text_at, text_at[-1] + np.cumsum(length[on])])
            entry[at] = self.entries + inverse
            room = min(max(CACHE_ENTRIES - self.entries, 0), len(missing))
            if room:  # ids of the others are needed in this block only
                self._insert(missing[:room])
                n = self.entries + room + 1
                self.id_at, self.text_at = id_at[:n], text_at[:n]
                self.pool, self.text = pool[: id_at[n - 1]].copy(), text[: text_at[n - 1]].copy()
        odd = self._odd_rows(data, offsets, space)
        differ = text_at[entry + 1] - text_at[entry] != length
        if not differ.any():
            differ = text[_ranges(text_at[entry], length)] != data[starts[0] :]
            odd |= set((np.searchsorted(offsets, np.flatnonzero(differ) + starts[0], "right") - 1).tolist())
        else:
            odd |= set(range(rows))
        sizes = id_at[entry + 1] - id_at[entry]
        flat = pool[_ranges(id_at[entry], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]
        if not len(odd):
            return flat, bounds
        parts, sizes = [], np.diff(bounds)
        for k in range(rows):
            part = flat[bounds[k] : bounds[k + 1]]
            if k in odd:
                part = self.ids(data[offsets[k] : offsets[k + 1]].tobytes().decode())
                sizes[k] = len(part)
            parts.append(part)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def _odd_rows(self, data, offsets, space) -> set[int]:
        """Rows with a special token or with a space inside a run of white space: those need the whole pattern."""
        if not len(data):
            return set()
        at = np.flatnonzero(space)
        after = np.append(_MAY_BEGIN_SPACE[data], True)[at + 1]
        after |= np.isin(at + 1, offsets)
        before = np.append(False, _MAY_END_SPACE[data])[at]
        rows = set((np.searchsorted(offsets, at[before & after], "right") - 1).tolist())
        marked = np.flatnonzero(self.mark_bytes[data]) if self.marks else []
        for k in set((np.searchsorted(offsets, marked, "right") - 1).tolist()):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            if any(m.encode() in text for m in self.marks):
                rows.add(k)
        return rows

    def _probe(self, hashes: np.ndarray) -> np.ndarray:
        """The entry that each hash proposes, -1 for none."""
        entry = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(self.shift)).astype(np.int64)
        on = np.arange(len(hashes))
        while len(on):
            key = self.keys[slot]
            hit = key == hashes[on]
            entry[on[hit]] = self.entry[slot[hit]]
            more = ~hit & (key != 0)
            on, slot = on[more], (slot[more] + 1) & (self.slots - 1)
        return entry

    def _insert(self, hashes: np.ndarray) -> None:
        for k, h in enumerate(hashes.tolist(), self.entries):
            slot = h >> self.shift
            while self.keys[slot]:
                slot = (slot + 1) & (self.slots - 1)
            self.keys[slot], self.entry[slot] = h, k


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after another."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(int(total[-1]) if len(total) else 0)


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read on the driver and sent to the executors with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _transducer(vocabulary: str) -> tuple[MergeList, TextEncoder]:
    loaded, key = kept("bpe"), hash(vocabulary)
    keep_only("bpe", "hashers")
    if key not in loaded:
        merges = MergeList(vocabulary)
        encoder = Encoder(merges)
        loaded[key] = (merges, TextEncoder(merges.special, len(merges.token_bytes), lambda p: encoder.piece(p.encode())))
    return loaded[key]


def decoded_text(ids: np.ndarray, merges: MergeList, step: int = 1 << 16) -> Iterator[str]:
    machine = Decoder(merges)
    for at in range(0, len(ids), step):
        yield machine.feed(ids[at : at + step])
    yield machine.finish()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's token ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        _, texts = _transducer(shared.value)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                ids, at = texts.block_ids(data, offsets)
                packed = [ids[x:y].astype("<u4").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the text of packed ids; null ids give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        merges, _ = _transducer(shared.value)
        for batch in batches:
            texts = ["".join(decoded_text(np.frombuffer(x or b"", "<u4"), merges)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) in one pass: encode, decode and digest, window by window."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        merges, texts = _transducer(shared.value)
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                counts, of_ids, of_text = [], [], []
                for parts in texts.rows(data, offsets):
                    count, ids_digest, text_digest, machine = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
                    for ids in parts:
                        count += len(ids)
                        ids_digest.update(ids.astype("<u4").tobytes())
                        text_digest.update(machine.feed(ids).encode())
                    text_digest.update(machine.finish().encode())
                    counts.append(count)
                    of_ids.append(ids_digest.hexdigest())
                    of_text.append(text_digest.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
