"""Benchmark decontamination by suffix arrays over shards of the training text.

Each shard of documents gets an array of its word suffixes.  Every suffix of a
test item that is long enough for a window (``window`` consecutive words; a
shorter item is one window) is looked up in it by binary search, which tells how
far it matches and where.  Matches that go on from one suffix to the next make
the longest verbatim matches of :func:`find_matches`; shorter ones than a window
count nowhere and are not reported.

A suffix can only match where the text has its first few words, its seed.  Only
places with some seed enter a shard's array, which is so sparse and exact, and
only suffixes whose seed the shard has are looked up.  Words are known by hashes
in a secret base drawn for the run.

The test items are read in blocks of at most ``ITEM_WORDS`` words and sent out
block by block.  A task judges each row by all blocks before it goes on, so the
result does not depend on their number; of several blocks it holds one at a time.

Cases: null or wordless text has no words and no hits; wordless items never
occur; equal items are all reported; an empty benchmark leaves every document
clean; repeated document rows and rows of a null id are judged one by one; items
of a null id count as hits and as one item, without a name in the digest; extra columns are kept by
:func:`remove_contaminated` and dropped by :func:`find_matches`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_blocks import U64, blocks, mix, random_base, span_hasher, word_spans

ITEM_WORDS = 2_000_000
WINDOW = 13
SEED_WORDS = 4

# Word bytes: everything outside \x00-\x2F, \x3A-\x60, \x7B-\x7F, after folding A-Z.
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x00:0x30] = False
_IS_WORD[0x3A:0x41] = False
_IS_WORD[0x5B:0x61] = False
_IS_WORD[0x7B:0x80] = False


def word_hashes(data: np.ndarray, offsets: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words of a block, and where each row's words begin."""
    starts, ends, first = word_spans(data, offsets, _IS_WORD)
    hasher = span_hasher(base)
    return hasher.hashes(hasher.sums(data, fold_case=True), starts, ends), first


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position; positions too near the end get none."""
    out = np.zeros(max(0, len(words) - n + 1), U64)
    for k in range(n):
        out = mix(out + words[k : len(words) - n + 1 + k])
    return out


class TestItems:
    """The words of one block of items, its windows and the seeds (first few words) by which they begin."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, base: int):
        packed = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(packed), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int64)
        self.base = base
        self.words, self.first = word_hashes(data, offsets, base)
        self.names = [name for name, _ in items]
        starts, lengths, owners = [], [], []
        for k in range(len(items)):
            a, b = int(self.first[k]), int(self.first[k + 1])
            size = min(window, b - a)
            if size:
                starts += range(a, b - size + 1)
                owners += [k] * (b - a - size + 1)
                lengths += [size] * (b - a - size + 1)
        self.starts, self.lengths, self.owners = (np.array(x, np.int64) for x in (starts, lengths, owners))
        # short items have shorter seeds of their own: (words, sorted seeds, their windows, a filter)
        self.seeds = []
        for n in np.unique(np.minimum(self.lengths, SEED_WORDS)).tolist():
            on = np.flatnonzero(np.minimum(self.lengths, SEED_WORDS) == n)
            seeds = gram_hashes(self.words, n)[self.starts[on]]
            order = np.argsort(seeds, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[(seeds >> U64(44)).astype(np.int64)] = True
            self.seeds.append((n, seeds[order], on[order], maybe))

    def occurring(self, words: np.ndarray, row_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions that begin with the seed of some window within their row, and the windows of those seeds."""
        places, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, seeds, of_seed, maybe in self.seeds:
            if len(words) < n:
                continue
            grams = gram_hashes(words, n)
            at = np.flatnonzero(maybe[(grams >> U64(44)).astype(np.int64)])
            at = at[row_of_word[at] == row_of_word[at + n - 1]]
            found = np.minimum(np.searchsorted(seeds, grams[at]), len(seeds) - 1)
            at = at[seeds[found] == grams[at]]
            places.append(at)
            met = np.unique(grams[at])
            low, high = np.searchsorted(seeds, met, "left"), np.searchsorted(seeds, met, "right")
            windows += [of_seed[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        return np.unique(np.concatenate(places)), np.sort(np.concatenate(windows))


class SuffixArray:
    """Chosen word suffixes of a shard in lexicographic order of their word hashes, up to ``depth`` words."""

    def __init__(self, words: np.ndarray, row_end: np.ndarray, places: np.ndarray, depth: int):
        self.words, self.row_end, self.depth = words, row_end, depth
        columns = [self._column(places, d) for d in range(depth)]
        order = np.lexsort(columns[::-1]) if len(places) else places
        self.places = places[order]
        self.columns = [c[order] for c in columns]

    def _column(self, places: np.ndarray, d: int) -> np.ndarray:
        at = places + d
        inside = at < self.row_end[places]
        out = np.zeros(len(places), U64)
        out[inside] = self.words[at[inside]] | U64(1)
        return out

    def longest_matches(self, suffix: np.ndarray) -> list[tuple[int, int]]:
        """For each length from 1, the range of suffixes that begin with so many words of ``suffix``; ends at no match."""
        low, high, out = 0, len(self.places), []
        for d, word in enumerate(suffix[: self.depth]):
            part, key = self.columns[d][low:high], word | U64(1)
            low, high = low + int(np.searchsorted(part, key, "left")), low + int(np.searchsorted(part, key, "right"))
            if low == high:
                break
            out.append((low, high))
        return out


def shard_matches(items: TestItems, data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """Words of each row, and (row, first word, words, item, first word in the item) of every window's occurrence in a shard."""
    words, first = word_hashes(data, offsets, items.base)
    counts = np.diff(first)
    row_of_word = np.repeat(np.arange(len(counts)), counts)
    places, windows = items.occurring(words, row_of_word)
    if not len(places):
        return counts, []
    array = SuffixArray(words, np.repeat(first[1:], counts), places, window)
    out, known = [], {}
    for start, size, owner in zip(items.starts[windows].tolist(), items.lengths[windows].tolist(), items.owners[windows].tolist(), strict=True):
        suffix = items.words[start : start + size]
        key = suffix.tobytes()
        if key not in known:
            ranges = array.longest_matches(suffix)
            known[key] = array.places[slice(*ranges[-1])].tolist() if len(ranges) == size else []
        for place in known[key]:
            row = int(row_of_word[place])
            out.append((row, place - int(first[row]), size, owner, start - int(items.first[owner])))
    return counts, out


def longest(hits: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(row, first word, words, item) of the longest verbatim matches: windows that go on in text and item alike are one."""
    out: list[tuple[int, int, int, int]] = []
    before = None
    for row, at, size, owner, start in sorted(hits, key=lambda h: (h[0], h[3], h[1] - h[4], h[1])):
        now = (row, owner, at - start)
        if before == now and at == last + 1:
            out[-1] = (row, out[-1][1], at + size - out[-1][1], owner)
        else:
            out.append((row, at, size, owner))
        before, last = now, at
    return sorted(out)


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int):
    """The test items, read by the driver one block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    base, block, size = random_base(), [], 0
    for name, text in rows.toLocalIterator():
        block.append((name, text))
        size += len(text) // 2 + 1
        if size >= ITEM_WORDS:
            yield TestItems(block, window, base)
            block, size = [], 0
    if block:
        yield TestItems(block, window, base)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in rising order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _judge(counts, by_row, share) -> list[tuple[int, int, int, str, bool]]:
    out = []
    for row, n in enumerate(counts.tolist()):
        spans, names = by_row.get(row, ((), ()))
        hit = sum(b - a for a, b in spans)
        ids = sorted(x for x in names if x is not None)
        out.append((n, hit, len(names), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and share * hit >= n))
    return out


def _judged(column: pa.Array, shared: list, window: int, share: int):
    """(first row, end row, judgements) of a batch's runs of rows: each row by itself, by all blocks of items."""
    parts = list(blocks(column))
    counts, by_row = [np.zeros(0, np.int64)] * len(parts), [{} for _ in parts]
    for block in shared:
        items = _loaded(block) if len(shared) > 1 else block.value
        for k, (_, _, data, offsets) in enumerate(parts):
            counts[k], hits = shard_matches(items, data, offsets, window)
            fresh: dict[int, tuple[list, set]] = {}
            for row, at, size, owner, _ in hits:
                spans, names = fresh.setdefault(row, ([], set()))
                spans.append((at, at + size))
                names.add(items.names[owner])
            for row, (spans, names) in fresh.items():
                old = by_row[k].get(row, ([], set()))
                by_row[k][row] = (_merged(old[0] + spans), old[1] | names)
    for (a, b, _, _), n, found in zip(parts, counts, by_row, strict=True):
        yield a, b, _judge(n, found, share)


def _loaded(block) -> TestItems:
    """A broadcast block, not kept by the worker, so that a task holds one of several at a time."""
    path = getattr(block, "_path", None)
    return block.load_from_path(path) if path else block.value


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> list:
    """All blocks of items as broadcasts, one at least; the driver holds one block at a time."""
    context = docs.sparkSession.sparkContext
    return [context.broadcast(x) for x in _item_blocks(benchmark, item_col, item_text_col, window)] or [context.broadcast(TestItems([], window, random_base()))]


_FIELDS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: its words, hit words, items found, their digest, and whether ``share`` * hits >= words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = _shared_blocks(docs, benchmark, item_col, item_text_col, window)

    def run(batches):
        for batch in batches:
            for a, b, judged in _judged(batch.column(1), shared, window, share):
                columns = list(zip(*judged, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, matches): the longest verbatim matches (first word, words, item) of ``window`` words or a whole shorter item."""
    shared = _shared_blocks(docs, benchmark, item_col, item_text_col, window)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.int64()), ("item", pa.string())]))

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(1)):
                lists: list[list] = [[] for _ in range(b - a)]
                for block in shared:
                    items = _loaded(block) if len(shared) > 1 else block.value
                    counts, hits = shard_matches(items, data, offsets, window)
                    for row, at, size, owner in longest(hits):
                        lists[row].append({"at": at, "words": size, "item": items.names[owner]})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(lists, fields)], names=["id", "n_words", "matches"])

    schema = f"id {kind}, n_words long, matches array<struct<at: long, words: long, item: string>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns, without moving a row."""
    shared, at = _shared_blocks(docs, benchmark, item_col, item_text_col, window), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for a, b, judged in _judged(batch.column(at), shared, window, share):
                yield batch.slice(a, b - a).filter(pa.array([not x[4] for x in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
