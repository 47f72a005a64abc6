"""Removal of repeated byte strings by a sampled suffix array with deep-shallow sorting.

A byte goes when some string of ``length`` bytes that covers it also starts
earlier: in a document with a smaller id, or further left in the same one.

1. Whole copies of an earlier text are settled by their digest and left out.
2. Every string of ``length`` bytes has one *anchor*, the place of the smallest
   hash among its ``GRAM``-byte substrings (leftmost on a tie).  Equal strings
   have equal anchors, so only anchors whose hash occurs twice can matter.
3. Around those anchors, the suffixes to the right and the reversed prefixes to
   the left are sorted: multikey quicksort on eight-byte characters to a
   shallow depth, then blind tries for the groups with longer common prefixes.
   The arrays of common prefix lengths tell exactly which strings are equal.

Anchors and their surroundings travel in packed blocks, dealt by their hash
over more shards than tasks.  Of equal hashes, and of equal surroundings, in a
chunk of a task one goes to the hash's shard; what is known of the others goes
to their documents.  So a passage common to many documents adds a row for each
chunk to its shard, not one for each occurrence.

Cases: null text counts as empty; texts shorter than ``length`` lose nothing;
ids identify documents, so rows that repeat an id and its text get the same
answer and are no copies of each other (of rows that repeat an id with other
texts each is judged as that document); rows without an id are left as they
are and make nothing else a repeat; an empty table gives an empty table; other
columns are kept by :func:`remove_repeats` and dropped by :func:`digests`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions
from .text_blocks import U64, blocks, keep_only, mix, quick_hashes, quick_sums

LENGTH = 100
GRAM = 32
SHALLOW = 32
SHARDS_PER_TASK = 4
FLUSH_ROWS = 200_000
_PLACE_BITS = 24


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of a block: row, place, first and last string start they stand for, and hash.

    Blocks of one long text may exceed 2**24 bytes; then it is scanned in
    overlapping pieces.
    """
    limit = 1 << _PLACE_BITS
    if len(data) > limit:
        parts = []
        for row in range(len(offsets) - 1):
            a, b = int(offsets[row]), int(offsets[row + 1])
            for at in range(a, max(a + 1, b - length + 1), limit - length):
                end = min(b, at + limit - 1)
                part = anchors(data[at:end], np.array([0, end - at]), length)
                part["row"] = part["row"] + row
                parts.append({k: v + (at if k in ("place", "first", "last") else 0) if k != "hash" else v for k, v in part.items()})
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    span = length - GRAM + 1
    starts = len(data) - length + 1
    empty = {"row": np.zeros(0, np.int64), "place": np.zeros(0, np.int64), "first": np.zeros(0, np.int64), "last": np.zeros(0, np.int64), "hash": np.zeros(0, U64)}
    if starts < 1:
        return empty
    valid = np.ones(starts, bool)
    for b in offsets[1:-1].tolist():
        valid[max(0, b - length + 1) : b] = False
    sums = quick_sums(data)
    at = np.arange(len(data) - GRAM + 1)
    hashes = quick_hashes(sums, at, at + GRAM)
    least = (hashes & ~U64(limit - 1)) | at.astype(U64)
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: starts], least[span - width : span - width + starts])
    window = np.flatnonzero(valid)
    place = (least[window] & U64(limit - 1)).astype(np.int64)
    if not len(window):
        return empty
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1])]))
    last = np.concatenate([fresh[1:] - 1, [len(window) - 1]])
    place = place[fresh]
    return {"row": np.searchsorted(offsets, place, "right") - 1, "place": place, "first": window[fresh], "last": window[last], "hash": hashes[place]}


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of distinct strings of one length, and each one's common prefix with the one before."""
    bits = 8 * len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list | int = 0  # a leaf is an index; an inner node is [depth, children by byte]
    for k in range(1, len(strings)):
        s = strings[k]
        node = root
        while node.__class__ is list:
            children = node[1]
            node = children[c] if (c := s[node[0]]) in children else next(iter(children.values()))
        depth = (bits - (numbers[k] ^ numbers[node]).bit_length()) // 8
        parent, node = None, root
        while node.__class__ is list and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if node.__class__ is list and node[0] == depth:
            node[1][s[depth]] = k
            continue
        other = node
        while other.__class__ is list:
            other = next(iter(other[1].values()))
        split = [depth, {strings[other][depth]: node, s[depth]: k}]
        if parent is None:
            root = split
        else:
            parent[1][s[parent[0]]] = split
    order, common, stack = [], [], [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        if node.__class__ is list:
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][c], node[0]) for c in keys[:-1]]
            stack.append((node[1][keys[-1]], lcp))
        else:
            order.append(node)
            common.append(lcp)
    return order, common


def deep_shallow_sort(rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of equally long byte rows, and the common prefix of each with the row before in that order.

    Equal rows keep their given order; the first row's common prefix is 0.
    """
    n, width = rows.shape
    padded = -width % 8
    if padded:
        rows = np.hstack([rows, np.zeros((n, padded), np.uint8)])
    words = np.ascontiguousarray(rows).view(">u8").astype(U64).reshape(n, -1)
    order, group = np.arange(n), np.zeros(n, np.int64)
    common = np.zeros(n, np.int64)
    alive = np.arange(n)  # positions in order whose group has several rows
    depth = 0
    while len(alive) and depth * 8 < min(shallow, words.shape[1] * 8):
        key = words[order[alive], depth]
        by = np.lexsort((key, group[alive]))
        order[alive] = order[alive[by]]
        key = key[by]
        joined = np.zeros(len(alive), bool)
        joined[1:] = group[alive[1:]] == group[alive[:-1]]
        cut = np.flatnonzero(joined[1:] & (key[1:] != key[:-1])) + 1
        differ = key[cut] ^ key[cut - 1]
        common[alive[cut]] = depth * 8 + _leading_bytes(differ)
        new = np.ones(n, bool)
        new[alive[joined]] = False
        new[alive[cut]] = True
        group = np.cumsum(new)
        size = np.bincount(group)
        alive = alive[size[group[alive]] > 1]
        depth += 1
    if len(alive):
        begin = depth * 8
        tails = rows[:, begin:]
        where = np.flatnonzero(np.concatenate([[True], group[alive[1:]] != group[alive[:-1]]]))
        for a, b in zip(where, [*where[1:], len(alive)], strict=True):
            members = order[alive[a:b]]
            equal: dict[bytes, list[int]] = {}
            for m in members.tolist():
                equal.setdefault(tails[m].tobytes(), []).append(m)
            distinct = list(equal)
            ranks, lcps = blind_trie_order(distinct) if begin < width else ([0], [0])
            at = int(alive[a])
            for k, lcp in zip(ranks, lcps, strict=True):
                same = equal[distinct[k]]
                order[at : at + len(same)] = same
                if at != alive[a]:
                    common[at] = begin + lcp
                common[at + 1 : at + len(same)] = width
                at += len(same)
    return order, np.minimum(common, width)


def _leading_bytes(differ: np.ndarray) -> np.ndarray:
    """Equal leading bytes of two eight-byte words, from their exclusive or."""
    out = np.zeros(len(differ), np.int64)
    for k in range(1, 8):
        out += differ < (U64(1) << U64(64 - 8 * k))
    return out


_SURROUND = [("hash", "<u8"), ("doc", "<i8"), ("place", "<i8"), ("low", "u1"), ("high", "u1")]


def surround_type(length: int) -> np.dtype:
    """One anchor: its hash, document and place, the offsets it stands for, bytes to the right and, reversed, to the left."""
    return np.dtype([*_SURROUND, ("right", "u1", (length,)), ("left", "u1", (length - GRAM,))])


def surroundings(data, offsets, docs, found, length: int) -> np.ndarray:
    """Anchors of a block with the bytes of all strings they stand for; unused bytes are 0."""
    out = np.zeros(len(found["place"]), surround_type(length))
    place = found["place"]
    out["hash"], out["doc"], out["place"] = found["hash"], docs[found["row"]], place - offsets[found["row"]]
    out["low"], out["high"] = place - found["last"], place - found["first"]
    if len(place):
        k = np.arange(length)
        at = place[:, None] + k
        used = k[None, :] < (length - out["low"].astype(np.int64))[:, None]
        out["right"] = np.where(used, data[np.minimum(at, len(data) - 1)], 0)
        k = np.arange(length - GRAM)
        at = place[:, None] - 1 - k
        used = k[None, :] < out["high"].astype(np.int64)[:, None]
        out["left"] = np.where(used, data[np.maximum(at, 0)], 0)
    return out


def merge_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each group of equal surroundings by document and place, the others)."""
    rows = rows[np.lexsort((rows["place"], rows["doc"]))]
    # a place met twice, from repeated rows, is no repeat of itself
    rows = rows[np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["place"][1:] != rows["place"][:-1])])]
    content = [name for name in rows.dtype.names if name not in ("doc", "place")]
    raw = np.ascontiguousarray(np.hstack([np.ascontiguousarray(rows[name]).view(np.uint8).reshape(len(rows), -1) for name in content]))
    seen: dict[bytes, int] = {}
    first = np.ones(len(rows), bool)
    for k, key in enumerate(map(bytes, raw)):
        j = seen.setdefault(key, k)
        first[k] = j == k
    return rows[first], rows[~first]


def repeats(rows: np.ndarray, length: int) -> np.ndarray:
    """(anchor, offset) booleans: whether the string that starts ``offset`` before the anchor has an earlier equal.

    Rows must be in order of document and place.
    """
    n = len(rows)
    out = np.zeros((n, length - GRAM + 1), bool)
    if n < 2:
        return out
    right, right_common = deep_shallow_sort(rows["right"])
    left, left_common = deep_shallow_sort(rows["left"])
    right_rank, left_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    right_rank[right], left_rank[left] = np.arange(n), np.arange(n)
    doc, place = rows["doc"], rows["place"]
    low, high = rows["low"].astype(np.int64), rows["high"].astype(np.int64)
    for d in range(length - GRAM + 1):
        on = np.flatnonzero((low <= d) & (d <= high))
        if len(on) < 2:
            continue
        of_right = np.cumsum(right_common < length - d)[right_rank[on]]
        of_left = np.cumsum(left_common < d)[left_rank[on]]
        _, first, inverse = np.unique(of_right * (n + 1) + of_left, return_index=True, return_inverse=True)
        earliest = on[first[inverse]]
        out[on, d] = (doc[earliest] != doc[on]) | (place[earliest] != place[on])
    return out


def spans(flags: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of byte runs covered by the flagged strings of each anchor."""
    edge = np.zeros((len(flags), 1), bool)
    step = np.diff(np.hstack([edge, flags, edge]).astype(np.int8), axis=1)
    row, low = np.nonzero(step == 1)
    _, high = np.nonzero(step == -1)
    place = rows["place"][row]
    return rows["doc"][row], place - (high - 1), place - low + length


def _whole_range(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["doc"], rows["place"] - rows["high"], rows["place"] - rows["low"].astype(np.int64) + length


def _dealt(hashes: np.ndarray, payload: np.ndarray, shards: int, kind: int):
    """Packed rows, one for each shard: (shard, kind, data)."""
    shard = (hashes % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, payload = shard[order], payload[order]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    ends = [*cuts[1:], len(shard)] if len(shard) else []
    return pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a in cuts], pa.int32()), pa.array([kind] * len(cuts), pa.int32()), pa.array([payload[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["shard", "kind", "data"])


# half a hash is enough inside a shard: a chance match only brings more bytes to compare
_POINT = np.dtype([("hash", "<u4"), ("doc", "<i8"), ("place", "<u4")])
_MARK = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def known_twice(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that stand for one hash each, places of the rows whose hash occurs at several places)."""
    order = np.lexsort((rows["place"], rows["doc"], hashes))
    same = np.zeros(len(rows), bool)  # as the row before in order
    same[1:] = hashes[order[1:]] == hashes[order[:-1]]
    again = same.copy()  # and at the same place, from repeated rows
    again[1:] &= (rows["doc"][order[1:]] == rows["doc"][order[:-1]]) & (rows["place"][order[1:]] == rows["place"][order[:-1]])
    order, same = order[~again], same[~again]
    several = same.copy()
    several[:-1] |= same[1:]
    return order[~same], order[several]


def _emit_points(length: int, shards: int):
    """One point for each hash of a chunk goes to the hash's shard (kind 0); where a chunk has several, they are known repeats and go to their documents' shards (kind 1)."""

    def run(batches):
        keep_only("powers")
        waiting, hashes, size = [], [], 0

        def flush():
            rows, full = np.concatenate(waiting), np.concatenate(hashes)
            one, several = known_twice(rows, full)
            yield _dealt(full[one], rows[one], shards, 0)
            yield _dealt(mix(rows["doc"][several].astype(U64)), rows[several], shards, 1)

        for batch in batches:
            docs = np.asarray(batch.column(0))
            for a, b, data, offsets in blocks(batch.column(1)):
                found = anchors(data, offsets, length)
                rows = np.zeros(len(found["place"]), _point_type())
                rows["hash"], rows["doc"], rows["place"] = found["hash"] >> U64(32), docs[a:b][found["row"]], found["place"] - offsets[found["row"]]
                waiting.append(rows)
                hashes.append(found["hash"])
                size += len(rows)
                if size >= 5 * FLUSH_ROWS:
                    yield from flush()
                    waiting, hashes, size = [], [], 0
        if size:
            yield from flush()

    return run


def _by_shard(handle):
    """Call ``handle`` with the (kind, data) chunks of each shard of a task; rows must be sorted by shard."""

    def run(batches):
        current, held = None, []
        for batch in batches:
            for shard, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != current and held:
                    yield from handle(held)
                    held = []
                current = shard
                held.append((kind, data))
        if held:
            yield from handle(held)

    return run


def _repeated_points(held):
    of_kind = lambda kind: np.concatenate([np.zeros(0, _point_type()), *(np.frombuffer(d, _point_type()) for k, d in held if k == kind)])
    rows = of_kind(0)
    rows = rows[np.argsort(rows["hash"], kind="stable")]
    same = rows["hash"][1:] == rows["hash"][:-1]
    twice = np.zeros(len(rows), bool)
    twice[1:] |= same
    twice[:-1] |= same
    rows = rows[twice]
    rows = np.unique(np.concatenate([rows, of_kind(1)]))  # repeated rows of a table
    order = np.argsort(rows["doc"], kind="stable")
    rows = rows[order]
    cuts = np.flatnonzero(np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]])) if len(rows) else []
    ends = [*cuts[1:], len(rows)] if len(rows) else []
    yield pa.RecordBatch.from_arrays([pa.array([int(rows["doc"][a]) for a in cuts], pa.int64()), pa.array([rows["place"][a:b].astype("<u4").tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["doc", "places"])


def _point_type() -> np.dtype:
    return _POINT


def _mark_type() -> np.dtype:
    return _MARK


def _emit_surroundings(length: int, shards: int):
    def run(batches):
        keep_only("powers")
        waiting, size = [], 0

        def flush():
            kept, others = merge_equal(np.concatenate(waiting))
            yield _dealt(kept["hash"], kept, shards, 0)
            marks = np.zeros(len(others), _mark_type())
            marks["doc"], marks["start"], marks["end"] = _whole_range(others, length)
            if len(marks):
                yield _dealt(mix(marks["doc"].astype(U64)), marks, shards, 1)  # to their documents

        for batch in batches:
            docs, hits = np.asarray(batch.column(0)), batch.column(2)
            for a, b, data, offsets in blocks(batch.column(1)):
                found = anchors(data, offsets, length)
                base = np.repeat(offsets[:-1], np.diff(np.searchsorted(found["row"], np.arange(b - a + 1))))
                wanted = np.zeros(len(data) + 1, bool)
                for row, chunks in enumerate(hits.slice(a, b - a).to_pylist()):
                    for chunk in chunks or ():
                        wanted[np.frombuffer(chunk, "<u4").astype(np.int64) + offsets[row]] = True
                on = wanted[found["place"]] & (base == offsets[found["row"]])
                part = {k: v[on] for k, v in found.items()}
                rows = surroundings(data, offsets, docs[a:b], part, length)
                waiting.append(rows)
                size += len(rows)
                if size >= FLUSH_ROWS:
                    yield from flush()
                    waiting, size = [], 0
        if size:
            yield from flush()

    return run


def _mark_shard(length: int):
    def handle(held):
        marks = [np.frombuffer(d, _mark_type()) for k, d in held if k == 1]
        chunks = [np.frombuffer(d, surround_type(length)) for k, d in held if k == 0]
        if chunks:
            kept, others = merge_equal(np.concatenate(chunks))
            found = [_whole_range(others, length)] if len(others) else []
            twice = np.isin(kept["hash"], kept["hash"][_repeated(kept["hash"])])
            kept = kept[twice]
            found.append(spans(repeats(kept, length), kept, length))
            for doc, start, end in found:
                part = np.zeros(len(doc), _mark_type())
                part["doc"], part["start"], part["end"] = doc, start, end
                marks.append(part)
        rows = np.concatenate(marks) if marks else np.zeros(0, _mark_type())
        rows = rows[np.lexsort((rows["start"], rows["doc"]))]
        cuts = np.flatnonzero(np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]])) if len(rows) else []
        ends = [*cuts[1:], len(rows)] if len(rows) else []
        packed = [np.stack([rows["start"][a:b], rows["end"][a:b]], 1).astype("<i8").tobytes() for a, b in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(rows["doc"][a]) for a in cuts], pa.int64()), pa.array(packed, pa.binary())], names=["doc", "marks"])

    return handle


def _repeated(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def merged_spans(chunks: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of marked bytes."""
    out: list[tuple[int, int]] = []
    if not chunks:
        return out
    rows = np.concatenate([np.frombuffer(c, "<i8").reshape(-1, 2) for c in chunks])
    for a, b in rows[np.argsort(rows[:, 0], kind="stable")].tolist():
        b = min(b, size)
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        elif a < b:
            out.append((a, b))
    return out


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, text, copy, marks): texts with the packed byte runs to remove; ``copy`` marks whole copies."""
    n = partitions(docs.sparkSession)
    shards = SHARDS_PER_TASK * n
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.col("doc").isNotNull())
    # the first document of each text, by a digest; whoever is long enough and no first is a copy, so
    # nothing is ever joined by the digest that many copies share
    digest = texts.where(F.octet_length("text") >= length).select("doc", F.sha2("text", 256).alias("digest"))
    firsts = digest.groupBy("digest").agg(F.min("doc").alias("doc")).select("doc").distinct().withColumn("first", F.lit(True))
    # one exchange of the texts serves all three passes over them
    dealt = texts.repartition(n, "doc").join(firsts, "doc", "left")
    dealt = dealt.select("doc", "text", ((F.octet_length("text") >= length) & F.col("first").isNull()).alias("copy"))
    # an anti-join would be pushed below the exchange and so get one of its own
    own = dealt.where(~F.col("copy")).select("doc", "text")
    points = own.mapInArrow(_emit_points(length, shards), "shard int, kind int, data binary")
    hits = points.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(_repeated_points), "doc long, places binary")
    hits = hits.groupBy("doc").agg(F.collect_list("places").alias("places"))
    around = dealt.join(hits, "doc").select("doc", "text", "places").mapInArrow(_emit_surroundings(length, shards), "shard int, kind int, data binary")
    marks = around.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(_mark_shard(length)), "doc long, marks binary")
    marks = marks.groupBy("doc").agg(F.collect_list("marks").alias("marks"))
    return dealt.join(marks, "doc", "left").select("doc", "text", "copy", "marks")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches):
        for batch in batches:
            out = []
            for text, copy, chunks in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                raw = text.encode()
                cut = [(0, len(raw))] if copy else merged_spans(chunks, len(raw))
                keep = hashlib.sha256()
                at = 0
                for a, b in cut:
                    keep.update(raw[at:a])
                    at = b
                keep.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in cut), len(cut), keep.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = marked(docs, id_col, text_col, length).mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    bare = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unnamed = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("doc"), F.octet_length(bare).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bare, 256).alias("kept_sha256"))
    return found.unionByName(unnamed).withColumnRenamed("doc", id_col)


def cut_text(raw: bytes, cut: list[tuple[int, int]]) -> str:
    """What is left of a text; a character that lost some of its bytes goes whole."""
    parts, at = [], 0
    for a, b in cut:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return "".join(p.decode("utf-8", "ignore") for p in parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents that have text left, repeated strings removed, with all their columns.

    Rows without an id stay as they are.  Rows that repeat an id keep their own
    other columns, but those that repeat both id and text get the columns of one
    of them.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    hashed = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rest = docs.select(F.col(id_col).cast("long").alias("doc"), hashed.alias("h"), F.struct(F.lit(0).alias("_"), *others).alias("rest")).where(F.col("doc").isNotNull())
    # by id alone, as the texts are dealt; of the few texts of an id each has its columns
    rest = rest.dropDuplicates(["doc", "h"]).groupBy("doc").agg(F.collect_list(F.struct("h", "rest")).alias("of_texts"))
    own = F.filter("of_texts", lambda x: x["h"] == F.xxhash64("text"))[0]["rest"]
    rows = marked(docs, id_col, text_col, length).join(rest, "doc").select("doc", "text", "copy", "marks", own.alias("rest"))

    def run(batches):
        for batch in batches:
            out, on = [], []
            for k, (text, copy, chunks) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:4]), strict=True)):
                raw = text.encode()
                cut = [(0, len(raw))] if copy else merged_spans(chunks, len(raw))
                left = cut_text(raw, cut) if cut else text
                if left.strip() or not cut:
                    on.append(k)
                    out.append(left)
            at = pa.array(on, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(out, pa.string()), batch.column(4).take(at)], names=["doc", "text", "rest"])

    kept = rows.mapInArrow(run, rows.select("doc", "text", "rest").schema)
    named = {id_col: F.col("doc").cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    columns = [(named[c] if c in named else F.col("rest")[c]).alias(c) for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where(F.col(id_col).isNull()))
