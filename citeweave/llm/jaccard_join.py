"""Exact Jaccard self-join over word n-grams by T-occurrence search (DivideSkip).

Two documents whose sets have a Jaccard similarity of num/den or more share at
least T = ceil(num * n / den) shingles, n being the size of either set.
DivideSkip splits a document's inverted lists into the T - 1 longest and the
rest: a partner must occur in one of the short lists, so only those are merged
by a heap, and the long ones are probed by binary search for what the merge
found.

The index of a corpus fits no task, so the search has two steps.

Who may meet.  Documents with equal sets become one class.  The postings of
the short lists (lengths are ranked by counts of the corpus's most frequent
shingles; any fixed ranking gives whole results) are dealt by shingle.  A list
of up to ``SMALL`` classes brings all its classes together; of a longer one,
first ``HEADS`` of its classes are brought together with all others (the same
ones in all lists that have them, by a hash), and once the links found have made
components, the classes of different components are if their sizes allow a link:
lists are cut into parts by size, and a part meets itself and the next one,
``BLOCK`` by ``BLOCK``.
Lists of the most frequent shingles are dealt in parts of about ``PART``
postings, each with heads of its own.
Sizes, places in the lists and a parity sketch (each differing bit is a
shingle that only one set has) rule most meetings out for certain.

The search.  Classes that many others may meet are heads; every class that may meet
some of them is a query against their inverted lists, which queries of the same heads
share: :func:`divide_skip` merges the short ones by a heap and probes the long ones.
A class meets all its heads in one place where it can, up to about ``GROUP`` there.

Components need no link inside a component, so such pairs are not searched and
numbers of links are not returned.

Shingles are known by hashes in a secret base drawn for the run; a class by a
63-bit digest of its set, checked against a second digest: names that two sets
share are found in the first pass and replaced.

Cases: text without words, null text included, has the empty set and links
with nothing; fewer words than n-grams need are one shingle together; equal
sets always link; repeated rows are documents of one class; rows with a null
id take part, but name no class or component: theirs is null unless a document
with an id belongs to it; an empty table gives an empty table; other columns
are dropped, except by :func:`keep_one_each`.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import counted, discard, partitions, settle
from .suffix_dedup import _by_shard, _dealt
from .text_blocks import U64, blocks, keep_only, mix, random_base, span_hasher, word_spans

FREQUENT = 1 << 16
FREQUENT_PER_CHUNK = 4096
CHUNK = 1 << 19
FILTER_WORDS = 1 << 17
BLOCK = 1024
SMALL = 32
PART = 4096
HEADS = 6
GROUP = 128
KEPT_LISTS = 16
#: Ids of dropped documents that go out to the texts; more are joined, which moves the texts.
MOST_SENT = 2_000_000

# Word bytes: everything but \x20 and \x09-\x0D, after folding A-Z.
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x20] = False
_IS_WORD[0x09:0x0E] = False


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, base: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    starts, ends, first = word_spans(data, offsets, _IS_WORD)
    hasher = span_hasher(base)
    words = hasher.hashes(hasher.sums(data, fold_case=True), starts, ends)
    grams = np.zeros(max(0, len(words) - size + 1), U64)
    for k in range(size):
        grams = mix(grams + words[k : len(words) - size + 1 + k]) if len(grams) else grams
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], U64)
            for w in words[a:b]:
                whole = mix(whole + w)
            out.append(mix(whole ^ U64(0x5BD1E995)))
        else:
            out.append(np.zeros(0, U64))
    return out


def names_of(grams: np.ndarray) -> tuple[int, int]:
    """Two independent 63-bit digests of a set, the same for equal sets."""
    n = U64(len(grams))
    sums = np.array([mix(grams).sum(dtype=U64) + n, mix(grams ^ U64(0xA0761D6478BD642F)).sum(dtype=U64) + n], U64)
    first, second = (mix(sums) >> U64(1)).tolist()
    return first, second


def class_of(grams: np.ndarray, shared_names: frozenset[int] = frozenset()) -> int:
    """The name of a set's class: its first digest, or the second if unequal sets share the first."""
    first, second = names_of(grams)
    return second if first in shared_names else first


def sketch_of(grams: np.ndarray) -> bytes:
    """Two independent rows of parities of the numbers of shingles in 2**k buckets, 2**k being n to 2n, 128 at least."""
    bits = max(128, 1 << int(len(grams) - 1).bit_length()) if len(grams) else 128
    odd = [np.bincount((part & U64(bits - 1)).astype(np.int64), minlength=bits) & 1 for part in (grams, grams >> U64(32))]
    return np.packbits(np.concatenate(odd).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of a smaller power of two of buckets, from 64-bit words in rows."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(x: bytes, nx: int, y: bytes, ny: int, num: int, den: int) -> bool:
    """False only if the sketches prove that two sets do not reach the similarity."""
    words = min(len(x), len(y)) // 16
    a, b = (folded(np.frombuffer(v, U64).reshape(2, -1), words) for v in (x, y))
    return (den + num) * int(np.bitwise_count(a ^ b).sum(1).max()) <= (den - num) * (nx + ny)


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n shingles with any partner."""
    return -(-num * n // den)


def divide_skip(lists: list, least: int, long: int | None = None) -> dict[int, int]:
    """Ids that occur in at least ``least`` of the sorted lists, with their counts.

    The ``long`` longest lists (least - 1 unless given) are left out of the
    merge by a heap and probed by binary search for the ids the merge found,
    all of them at once: they stand one after another as (list, id).
    """
    long = max(0, min(least - 1 if long is None else long, least - 1, len(lists)))
    by_length = sorted(lists, key=len)
    short = [x if isinstance(x, list) else x.tolist() for x in by_length[: len(lists) - long]]
    rest = by_length[len(lists) - long :]
    heap = [(x[0], k, 0) for k, x in enumerate(short) if x]
    if not heap:
        return {}
    heapq.heapify(heap)
    if rest:
        span = 1 + max(max(int(x[-1]) for x in rest if len(x)) if any(map(len, rest)) else 0, max(x[-1] for x in short if x))
        first_of = np.arange(long, dtype=np.int64) * span
        probed = np.concatenate([np.asarray(x, np.int64) for x in rest]) + np.repeat(first_of, [len(x) for x in rest])
    found = {}
    while heap:
        value, count = heap[0][0], 0
        while heap and heap[0][0] == value:
            _, k, at = heap[0]
            count += 1
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if count < least - long:
            continue
        if rest and len(probed):
            wanted = first_of + value
            at = np.minimum(np.searchsorted(probed, wanted), len(probed) - 1)
            count += int((probed[at] == wanted).sum())
        if count >= least:
            found[value] = count
    return found


class Inverted:
    """Inverted lists of some sets: which of them hold each shingle, places rising within a list."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        grams = np.concatenate([np.zeros(0, U64), *sets])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def similar(self, query: np.ndarray, num: int, den: int) -> list[int]:
        """Which sets reach the similarity with ``query``: T-occurrence search over the lists of its shingles."""
        low, high = np.searchsorted(self.grams, query, "left"), np.searchsorted(self.grams, query, "right")
        lists = [self.owner[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        counts = divide_skip(lists, needed(len(query), num, den))
        return [k for k, both in counts.items() if den * both >= num * (len(query) + int(self.sizes[k]) - both)]


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity, by comparison of the sets."""
    if len(x) > len(y):
        x, y = y, x
    if den * len(x) < num * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return den * both >= num * (len(x) + len(y) - both)


def _classes(size: int, base: int):
    """(kind 0: id, alias, class, second name, n, sketch of a class new to the task; kind 1: frequent shingle, count) from one pass over the texts."""

    def run(batches):
        keep_only("hashers")
        seen, waiting, held = set(), [], 0

        def frequent():
            grams = np.concatenate(waiting)
            bucket = (grams >> U64(44)).astype(np.int64)
            often = np.bincount(bucket, minlength=1 << 20) >= 4
            values, counts = np.unique(grams[often[bucket]], return_counts=True)
            top = np.argsort(-counts, kind="stable")[:FREQUENT_PER_CHUNK]
            top = top[counts[top] >= 4]
            n = len(top)
            none = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(values[top].view(np.int64)), pa.nulls(n, pa.int64()), pa.array(counts[top], pa.int64()), pa.array(np.ones(n), pa.int32()), pa.nulls(n, pa.binary())], names=["id", "alias", "value", "second", "n", "kind", "sketch"])

        for batch in batches:
            ids, aliases = batch.column(0), batch.column(2)
            for a, b, data, offsets in blocks(batch.column(1)):
                names, sizes, sketches = [], [], []
                for grams in shingle_sets(data, offsets, size, base):
                    names.append(both := names_of(grams))
                    sizes.append(len(grams))
                    sketches.append(None)
                    if len(grams) and both not in seen:
                        seen.add(both)
                        waiting.append(grams)
                        held += len(grams)
                        sketches[-1] = sketch_of(grams)
                facts = [pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.zeros(b - a), pa.int32()), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), aliases.slice(a, b - a), *facts], names=["id", "alias", "value", "second", "n", "kind", "sketch"])
                if held >= CHUNK:
                    yield frequent()
                    waiting, held = [], 0
        if held:
            yield frequent()

    return run


_POSTING = np.dtype([("gram", "<u8"), ("cls", "<i8"), ("n", "<u4"), ("place", "<u4")])


def _posting_type() -> np.dtype:
    return _POSTING


def short_prefix(grams: np.ndarray, keep: int, frequent: np.ndarray, counts: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` shingles with the shortest lists, ties by value, and how many postings each is known to have."""
    hot = np.flatnonzero(maybe[(grams >> U64(44)).astype(np.int64)])
    if len(hot):
        at = np.minimum(np.searchsorted(frequent, grams[hot]), len(frequent) - 1)
        is_hot = frequent[at] == grams[hot]
        hot, at = hot[is_hot], at[is_hot]
    cost = np.zeros(len(grams), np.int64)
    if not len(hot):
        return grams[:keep], cost[:keep]
    cost[hot] = counts[at]
    best = np.lexsort((grams, np.log2(cost + 1).astype(np.int64)))[:keep]
    return grams[best], cost[best]


def _postings(size: int, num: int, den: int, shards: int, base: int, shared_names: frozenset, shared):
    """Packed postings of the short lists by shard: kind 0 of whole lists, kind 1 of lists dealt in parts."""

    def run(batches):
        keep_only("hashers")
        frequent, counts = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(frequent >> U64(44)).astype(np.int64)] = True
        seen, waiting, held = set(), [], 0

        def flush():
            rows, known = np.concatenate([r for r, _ in waiting]), np.concatenate([k for _, k in waiting])
            parted = known > PART
            yield _dealt(rows["gram"][~parted], rows[~parted], shards, 0)
            part = rows["cls"][parted].astype(U64) % (known[parted] // PART + 1).astype(U64)
            yield _dealt(mix(rows["gram"][parted] + part), rows[parted], shards, 1)

        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                for grams in shingle_sets(data, offsets, size, base):
                    name = class_of(grams, shared_names) if len(grams) else -1
                    if name < 0 or name in seen:
                        continue
                    seen.add(name)
                    n = len(grams)
                    part, known = short_prefix(grams, n - needed(n, num, den) + 1, frequent, counts, maybe)
                    rows = np.empty(len(part), _posting_type())
                    rows["gram"], rows["cls"], rows["n"], rows["place"] = part, name, n, np.arange(len(part))
                    waiting.append((rows, known))
                    held += len(rows)
                if held >= CHUNK:
                    yield from flush()
                    waiting, held = [], 0
        if held:
            yield from flush()

    return run


def could_link(n_x, n_y, at_x, at_y, num: int, den: int) -> np.ndarray:
    """Whether sizes allow the similarity and enough of both sets is left from a first common shingle on."""
    close = den * np.minimum(n_x, n_y) >= num * np.maximum(n_x, n_y)
    return close & ((den + num) * np.minimum(n_x - at_x, n_y - at_y) >= num * (n_x + n_y))


def _merged_lists(num: int, den: int):
    """From the postings of a shard: pairs to search (kind 1: a, b), the postings of long lists (kind 0: gram, cls, n, place) and the first head of each part (kind 2: gram, cls)."""

    def rows_of(kind, x, y, *more):
        none = pa.nulls(len(x), pa.int64())
        more = [pa.array(m.astype(np.int64)) for m in more] or [none, none]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind), pa.int32()), pa.array(x.view(np.int64)), pa.array(y), *more], names=["kind", "a", "b", "n", "place"])

    def of_kind(chunks, parted):
        rows = np.concatenate([np.frombuffer(d, _posting_type()) for d in chunks])
        rows = rows[np.lexsort((rows["cls"], rows["gram"]))]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["cls"][1:] != rows["cls"][:-1])
        rows = rows[fresh]
        rows = rows[np.lexsort((mix(rows["cls"].astype(U64)), rows["gram"]))]  # heads first
        start = np.flatnonzero(np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]]))
        size = np.diff(np.append(start, len(rows)))
        of, head = np.repeat(size, size), np.repeat(start, size)
        n, place, cls = rows["n"].astype(np.int64), rows["place"].astype(np.int64), rows["cls"]
        is_long = (of > SMALL) | parted
        found = []
        for k in range(HEADS):
            i = np.flatnonzero(is_long & (np.arange(len(rows)) - head > k))
            h = head[i] + k
            ok = could_link(n[h], n[i], place[h], place[i], num, den)
            found.append(np.stack([cls[h[ok]], cls[i[ok]]], 1))
        for step in range(1, SMALL):
            # the pairs of rows that stand ``step`` apart in one short list
            i = np.arange(len(rows) - step) if len(rows) > step else np.zeros(0, np.int64)
            i = i[(head[i] == head[i + step]) & ~is_long[i]]
            i = i[could_link(n[i], n[i + step], place[i], place[i + step], num, den)]
            found.append(np.stack([cls[i], cls[i + step]], 1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        yield rows_of(1, pairs[:, 0], pairs[:, 1])
        long = rows[is_long]
        yield rows_of(0, long["gram"], long["cls"], long["n"], long["place"])
        if parted:
            yield rows_of(2, rows["gram"][start], rows["cls"][start])

    def handle(held):
        for kind in (0, 1):
            chunks = [d for k, d in held if k == kind]
            if chunks:
                yield from of_kind(chunks, kind == 1)

    return handle


def _sets(size: int, base: int, shared_names: frozenset, shared):
    def run(batches):
        keep_only("hashers")
        words, seen = shared.value, set()
        for batch in batches:
            for a, b, data, offsets in blocks(batch.column(0)):
                keys = np.asarray(batch.column(1)[a:b])
                on = (keys & (FILTER_WORDS - 1)).astype(np.int64)
                wanted = np.flatnonzero((words[on] >> ((keys >> 40) & 63)) & 1)
                # a task sends a text once, however many rows without an id have it
                wanted = np.array([k for k in wanted.tolist() if not (keys[k] in seen or seen.add(keys[k]))], np.int64)
                if not len(wanted):
                    continue
                # only the rows asked for are cut into words
                pieces = [data[offsets[k] : offsets[k + 1]] for k in wanted]
                short = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
                sets = shingle_sets(np.concatenate(pieces), short, size, base)
                yield pa.RecordBatch.from_arrays([pa.array(keys[wanted]), pa.array([class_of(g, shared_names) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["key", "cls", "grams"])

    return run


def _search(num: int, den: int):
    """Links of the members of each group (kind 1) with their heads (kind 0) in it; members of the same heads share inverted lists."""

    def run(batches):
        keep_only("hashers")
        key, sets, built, found = None, {}, {}, []

        def lists_of(heads: tuple) -> Inverted:
            if heads not in built:
                if len(built) == KEPT_LISTS:
                    built.clear()
                built[heads] = Inverted([sets[h] for h in heads])
            return built[heads]

        for batch in batches:
            for *group, kind, cls, heads, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != key:
                    key, sets, built = group, {}, {}
                values = np.frombuffer(grams, U64)
                if kind == 0:
                    sets[cls] = values
                    continue
                heads = tuple(h for h in heads if h != cls and h in sets)
                found += [(heads[x], cls) for x in lists_of(heads).similar(values, num, den)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])
                found = []

    return run


def _screen(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = [may_link(x, nx, y, ny, num, den) for x, nx, y, ny in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def screened(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs of classes that their sketches do not rule out."""
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "n_a", "sketch_b", "n_b")
    return rows.mapInArrow(_screen(num, den), "a long, b long")


def _within_lists(num: int, den: int):
    """Pairs across components of one list, or of two blocks of it, that sketches do not rule out."""

    def pairs(frame):
        cls, n, place, component, block, upper = (frame[c].to_numpy() for c in ("cls", "n", "place", "component", "block", "upper"))
        first, second = int(frame["first"].iloc[0]), int(frame["second"].iloc[0])
        words = np.array([len(x) // 8 for x in frame["sketch"]])
        kinds = np.unique(words).tolist()
        rows = {w: np.flatnonzero(words == w) for w in kinds}
        bits = {w: np.frombuffer(b"".join(frame["sketch"].iloc[k] for k in rows[w]), U64).reshape(-1, w) for w in kinds}
        out = set()
        for w in kinds:
            for v in (w, 2 * w):
                if v not in rows:
                    continue
                x, y, big = rows[w], rows[v], folded(bits[v], w)
                for at in range(0, len(x), 256):
                    i = x[at : at + 256]
                    total = n[i][:, None] + n[y][None, :]
                    close = could_link(n[i][:, None], n[y][None, :], place[i][:, None], place[y][None, :], num, den)
                    close &= (component[i][:, None] != component[y][None, :]) & ((upper[i][:, None] & upper[y][None, :]) == 0)
                    if first != second:
                        close &= block[i][:, None] != block[y][None, :]
                    a, b = np.nonzero(close)
                    for k in range(0, len(a), 1 << 14):
                        p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                        differ = np.bitwise_count(bits[w][at + p] ^ big[q]).sum(1, dtype=np.int64)
                        ok = (den + num) * differ <= (den - num) * total[p, q]
                        out |= {(int(min(s, t)), int(max(s, t))) for s, t in zip(cls[i[p[ok]]], cls[y[q[ok]]], strict=True)}
        return out

    def run(batches):
        import pandas as pd

        key, held, done = None, [], set()

        def flush():
            fresh = pairs(pd.concat(held) if len(held) > 1 else held[0]) - done
            if len(done) > 1 << 18:  # only spares work: pairs are made distinct afterwards
                done.clear()
            done.update(fresh)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in fresh], pa.int64()), pa.array([y for _, y in fresh], pa.int64())], names=["a", "b"])

        for batch in batches:
            frame = batch.to_pandas()
            keys = frame[["gram", "part", "first", "second"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(frame)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if (now := tuple(keys[a].tolist())) != key and held:
                    yield flush()
                    held = []
                key = now
                held.append(frame.iloc[a:b])
        if held:
            yield flush()

    return run


def pairs_within(lists: DataFrame, classes: DataFrame, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """Distinct pairs of the lists' classes across components that could link, and the tables it reads; ``lists`` has gram, cls, n, place and component."""
    # a list is searched in parts by size: linked sets differ in size by less than den / num, so a class
    # meets its own part and the next one only; ``upper`` rows are guests from the next part
    part = F.floor(F.log("n") / (math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n")
    home = lists.withColumn("part", part.cast("long"))
    rows = home.withColumn("upper", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("part", F.col("part") - F.col("upper"))
    # lists of the same classes (a passage gives one for each of its shingles) are searched once, by the
    # shingle that stands first: its places rule out least.  Members are told by two sums of hashes
    of = [F.sum(F.xxhash64(F.lit(k), "cls", "upper").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    facts = [F.count("*").alias("m"), F.min("upper").alias("u"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("place").alias("at")]
    each = rows.groupBy("gram", "part").agg(*facts, *of).where("x <> y and u = 0")
    first = each.groupBy("m", "s1", "s2").agg(F.min(F.struct("at", "gram", "part")).alias("first"))
    # written first, so that the join can split a long list
    sizes, path = settle(first.select(F.col("first.gram").alias("gram"), F.col("first.part").alias("part"), "m"), "list-sizes")
    blocks_ = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.join(sizes, ["gram", "part"]).withColumn("blocks", blocks_).withColumn("block", F.pmod(F.col("cls"), F.col("blocks").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("gram", "part", "upper", "cls", "n", "place", "component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    # one row of the sketches is enough here: what it lets through meets both rows before any set is fetched
    half = F.expr("substring(sketch, 1, cast(octet_length(sketch) / 2 as int))")
    rows = rows.join(classes.select("cls", half.alias("sketch")), "cls")
    key = ["gram", "part", "first", "second"]
    dealt = rows.repartition(partitions(lists.sparkSession), *key).sortWithinPartitions(*key).select(*key, "block", "upper", "cls", "n", "place", "component", "sketch")
    return dealt.mapInArrow(_within_lists(num, den), "a long, b long").distinct(), [path]


def fetch_sets(texts: DataFrame, of_doc: DataFrame, wanted: DataFrame, sets) -> DataFrame:
    """(cls, grams) of the wanted classes, from one document each, where it is read.

    A filter of fixed size tells which texts to cut into words.  What it lets
    through in error are sets of other classes, or one of these once more.
    """
    spark = texts.sparkSession
    key = F.coalesce("alias", F.xxhash64("id"))
    reps = of_doc.where("n > 0").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min(key).alias("rep"))
    bits = reps.select(F.col("rep").bitwiseAND(F.lit(FILTER_WORDS - 1)).alias("word"), F.shiftright("rep", 40).bitwiseAND(F.lit(63)).alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_WORDS, np.int64)
    words[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return texts.select("text", key.alias("key")).mapInArrow(sets(spark.sparkContext.broadcast(words)), "key long, cls long, grams binary").select("cls", "grams")


def grouped(pairs: DataFrame) -> DataFrame:
    """(g, piece, salt, h, b): pairs of a head and a member, in groups of one task each.

    Of two classes that with more pairs is the head; a member belongs to its head of most
    pairs, ``g``, where it meets its other heads too, so its set is sent once and not once
    for each pair.  Heads of a group are dealt in pieces of ``GROUP``, members in parts.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("d"))
    side = lambda c: degree.select(F.col("cls").alias(c), F.col("d").alias(f"d_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    x, y = F.struct((-F.col("d_a")).alias("d"), F.col("a").alias("cls")), F.struct((-F.col("d_b")).alias("d"), F.col("b").alias("cls"))
    rows = rows.select(F.least(x, y).alias("h"), F.greatest(x, y)["cls"].alias("b"))
    of_member = rows.groupBy("b").agg(F.min("h")["cls"].alias("g"))
    rows = rows.select(F.col("h.cls").alias("h"), "b").join(of_member, "b")
    sizes = rows.groupBy("g").agg(F.approx_count_distinct("h").alias("heads"), F.count("*").alias("members"))
    spread = lambda c, n, room: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / room)).cast("int")
    return rows.join(sizes, "g").select("g", spread("h", "heads", GROUP).alias("piece"), spread("b", "members", 16 * GROUP).alias("salt"), "h", "b")


def compare(pairs: DataFrame, texts: DataFrame, of_doc: DataFrame, cut, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """(a, b) of classes that reach the similarity, all of the pairs among them, and the tables it reads."""
    n = partitions(pairs.sparkSession)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets, path = settle(fetch_sets(texts, of_doc, ends, cut), "sets")
    groups, of_groups = settle(grouped(pairs), "groups")
    key = ["g", "piece", "salt"]
    heads = groups.select(*key, F.lit(0).alias("kind"), F.col("h").alias("cls"), F.lit(None).cast("array<long>").alias("heads")).distinct()
    members = groups.groupBy(*key, F.lit(1).alias("kind"), F.col("b").alias("cls")).agg(F.sort_array(F.collect_set("h")).alias("heads"))
    rows = heads.unionByName(members).join(sets, "cls").select(*key, "kind", "cls", "heads", "grams")
    rows = rows.repartition(n, *key).sortWithinPartitions(*key, "kind")
    return rows.mapInArrow(_search(num, den), "a long, b long"), [path, of_groups]


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every document; a class is named by its smallest document."""
    spark = docs.sparkSession
    n = partitions(spark)
    shards = 4 * n
    base = random_base()
    paths, sent = [], []

    def keep(df, name):
        out, path = settle(df, name)
        paths.append(path)
        return out

    def send(value):
        sent.append(spark.sparkContext.broadcast(value))
        return sent[-1]

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows without an id are known by their texts
    texts = texts.withColumn("alias", F.when(F.col("id").isNull(), F.xxhash64("text")))
    first = keep(texts.mapInArrow(_classes(size, base), "id long, alias long, value long, second long, n long, kind int, sketch binary"), "classes")
    # names that unequal sets share: as good as none, and few at any size
    several = first.where("kind = 0 and sketch is not null").groupBy("value").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x <> y").select("value")
    shared_names = frozenset(r[0] for r in several.collect())
    name = F.when(F.col("value").isin(*shared_names), F.col("second")).otherwise(F.col("value")) if shared_names else F.col("value")
    of_doc = first.where("kind = 0").select("id", "alias", name.alias("cls"), "n")
    classes = keep(first.where("kind = 0 and sketch is not null").groupBy(name.alias("cls")).agg(F.first("sketch").alias("sketch"), F.first("n").alias("n")), "class-sketches")
    top = first.where("kind = 1").groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(FREQUENT).toPandas()
    frequent = top["value"].to_numpy(np.int64).view(U64)
    order = np.argsort(frequent)
    shared = send((frequent[order], top["n"].to_numpy(np.int64)[order]))
    dealt = texts.select("text").mapInArrow(_postings(size, num, den, shards, base, shared_names, shared), "shard int, kind int, data binary")
    merged = keep(dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(_merged_lists(num, den)), "kind int, a long, b long, n long, place long"), "lists")
    lists = merged.where("kind = 0").select(F.col("a").alias("gram"), F.col("b").alias("cls"), "n", "place")

    # the first heads of the parts of one list meet the smallest of them
    heads = merged.where("kind = 2").select(F.col("a").alias("gram"), F.col("b").alias("cls"))
    smallest = heads.groupBy("gram").agg(F.min("cls").alias("head"))
    across = heads.join(smallest, "gram").where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    first_pairs = merged.where("kind = 1").select("a", "b").unionByName(across).distinct()
    tested = keep(screened(first_pairs, classes, num, den), "first-pairs")
    cut = lambda words: _sets(size, base, shared_names, words)
    found, temporary = compare(tested, texts, of_doc, cut, num, den)
    links = keep(found, "star-links")
    discard(spark, *temporary)
    groups, temporary = components(links)
    paths += temporary

    # long lists that still span components: every pair across them that could link and was not yet searched
    named = lists.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").select("gram", "cls", "n", "place", F.coalesce("component", "cls").alias("component"))
    spanning, temporary = pairs_within(keep(named, "named-lists"), classes, num, den)
    paths += temporary
    untested = spanning.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    pairs = keep(screened(untested, classes, num, den), "pairs")
    if not pairs.isEmpty():
        found, temporary = compare(pairs, texts, of_doc, cut, num, den)
        more = keep(found, "other-links")
        discard(spark, *temporary)
        groups, temporary = components(links.unionByName(more))
        paths += temporary

    # documents of a class, then of linked classes; the tables by class and component are
    # written first, so that a class with many documents can be split in the joins
    of_class = keep(of_doc.where("n > 0").groupBy("cls").agg(F.min("id").alias("class_id")), "class-ids")
    of_class = of_class.join(groups.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "class_id", F.coalesce("component", "cls").alias("component"))
    of_class = keep(of_class, "class-components")
    least = keep(of_class.groupBy("component").agg(F.min("class_id").alias("component_id")), "component-ids")
    of_class = keep(of_class.join(least, "component").select("cls", "class_id", "component_id"), "class-results")
    empty = F.col("n") == 0
    result = of_doc.join(of_class, "cls", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(empty, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    result, _ = settle(result, "similar")
    discard(spark, *paths)
    for b in sent:
        b.destroy()
    return result


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of similar ones, that with the smallest id, with all its columns; rows without an id stay."""
    found = similar(docs, id_col, text_col, size, num, den)
    gone, _, n = counted(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "dropped")
    return docs.join(F.broadcast(gone) if n <= MOST_SENT else gone, id_col, "left_anti")
