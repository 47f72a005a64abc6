"""Alignment of two tokenizers over byte-owner arrays.

A is a byte-level vocabulary, B a SentencePiece model; both read a space and the
text.  For each, token indices are repeated over the bytes of their tokens, so
that every byte has an owner in A and one in B.  Walking along the bytes, each new
pair of owners is a link (the two tokens overlap), and a byte where both owners
change is a cut: the tokens between two cuts make a group.  A block of texts is
aligned at once, since a text's first byte always is a cut; long texts are aligned
piece by piece between common ends of tokens.

How many documents hold a pair of ids is counted over the whole corpus from each
document's distinct pairs, written once with their numbers of links.  Documents
get the counts back in two exact ways.  The most frequent pairs, at most
``FREQUENT`` of them, go to all tasks as a broadcast of a known size.  What a
document holds besides is exploded and joined by pair; such pairs are rare by
construction, so no key of that join is hot.  The highest count of each id of A
is a table of at most one row per vocabulary entry.

B's ids come from the SentencePiece library chunk by chunk: no piece of the model
has a space behind another character, so merges never cross the start of a run of
spaces (checked when the model is read; a model without that property is given
whole texts).  A's come from the transducer of ``bpe``.

Cases: null and empty texts, and texts whose tokens do not spell them (B reads
U+2581 as a space), have no tokens, zeros and an empty groups column; strings of
special tokens are plain text; rows are counted one by one, so a repeated document
counts twice; rows without an id count too; an empty table gives an empty table;
columns other than id and text are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, MergeList, TextEncoder, WINDOW, _ranges, read_vocabulary
from .storage import settle
from .text_blocks import blocks, keep_only, kept

#: Most pairs that are broadcast with their counts: 17 bytes each, 18 MB in all.
FREQUENT = 1 << 20
#: Steps of a power of two by which pairs are sorted into classes of frequency.
_FINE = 8


class TokenBytes:
    """The bytes and the decimal digits of each id of a vocabulary."""

    def __init__(self, token_bytes: list[bytes]):
        self.size = len(token_bytes)
        self.count = np.array([len(b) for b in token_bytes], np.int64)
        self.start = np.cumsum(self.count) - self.count
        self.all = np.frombuffer(b"".join(token_bytes), np.uint8)
        width = len(str(self.size))
        self.digits = np.array([list(str(k).ljust(width + 1).encode()) for k in range(self.size)], np.uint8)
        self.width = np.array([len(str(k)) for k in range(self.size)], np.int64)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.all[_ranges(self.start[ids], self.count[ids])]


class PieceEncoder(TextEncoder):
    """Whole texts to ids of a SentencePiece model, through the table of chunks met before."""

    SPACE = "▁"

    def __init__(self, processor, base: int | None = None):
        super().__init__({}, processor.get_piece_size(), None, base)
        self.processor = processor
        pieces = [processor.id_to_piece(k) for k in range(processor.get_piece_size())]
        self.cuts = not any(self.SPACE in p.lstrip(self.SPACE) for p in pieces)
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if processor.is_byte(k) else p.replace(self.SPACE, " ").encode() for k, p in enumerate(pieces)])

    def chunks(self, chunks: list[str]) -> list[list[int]]:
        """The model adds the space that each chunk begins with; of nothing but that space it would make no token."""
        out = self.processor.encode([c[1:] for c in chunks], num_threads=1)
        return [[self.processor.piece_to_id(self.SPACE)] if c == " " else ids for c, ids in zip(chunks, out, strict=True)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.chunks([text])[0], self.kind)

    def _begins(self, data: np.ndarray, space: np.ndarray) -> np.ndarray:
        begins = space & self.cuts
        begins[1:] &= ~space[:-1]
        return begins

    def _odd_rows(self, data, offsets, space) -> set[int]:
        return set()

    def _safe_cut(self, data: np.ndarray, at: int) -> int:
        size = WINDOW
        while self.cuts and at + size < len(data):
            part = data[at : at + size]
            found = np.flatnonzero((part[1:] == 32) & (part[:-1] != 32))
            if len(found):
                return at + int(found[-1]) + 1
            size *= 2
        return len(data)


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, vocabulary: str, model: bytes):
        import sentencepiece

        merges = MergeList(vocabulary)
        encoder = Encoder(merges)
        # without special tokens: their strings are text
        self.a = TextEncoder({}, len(merges.token_bytes), lambda p: encoder.piece(p.encode()))
        self.a_bytes = TokenBytes(merges.token_bytes)
        self.b = PieceEncoder(sentencepiece.SentencePieceProcessor(model_proto=model))
        self.b_bytes = self.b.bytes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, the offsets of each row's ids, and which rows both of them spell; the others have no ids."""
        ids_a, at_a = self.a.block_ids(data, offsets)
        ids_b, at_b = self.b.block_ids(data, offsets)
        spelt = self._spelt(self.a_bytes, ids_a, at_a, data, offsets) & self._spelt(self.b_bytes, ids_b, at_b, data, offsets)
        if not spelt.all():
            ids_a, at_a = _without(ids_a, at_a, spelt)
            ids_b, at_b = _without(ids_b, at_b, spelt)
        return ids_a, at_a, ids_b, at_b, spelt

    @staticmethod
    def _spelt(table: TokenBytes, ids: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(table.count[ids])])[at]
        joined = table.joined(ids)
        same = np.diff(ends) == np.diff(offsets)
        if same.all():
            differ = np.flatnonzero(joined != data)
            same[np.searchsorted(offsets, differ, "right") - 1] = False
            return same
        for k in np.flatnonzero(same).tolist():
            same[k] = np.array_equal(joined[ends[k] : ends[k + 1]], data[offsets[k] : offsets[k + 1]])
        return same


def _without(ids: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    return ids[np.repeat(wanted, sizes)], np.concatenate([[0], np.cumsum(sizes * wanted)])


@dataclass
class Alignment:
    """Links and groups of some texts that follow one another; ``at_*`` are the offsets of each text's part."""

    a: np.ndarray  # link: index of a token of A
    b: np.ndarray  # link: index of a token of B
    at_links: np.ndarray
    at_groups: np.ndarray
    first_a: np.ndarray  # group: first token of A, and behind the last group their number
    first_b: np.ndarray


def align(count_a: np.ndarray, count_b: np.ndarray, ends: np.ndarray) -> Alignment:
    """Links and groups from the numbers of bytes of both sides' tokens; ``ends``: byte offsets of texts."""
    owner_a, owner_b = (np.repeat(np.arange(len(c), dtype=np.int32), c) for c in (count_a, count_b))
    new_a, new_b = (np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool) for o in (owner_a, owner_b))
    links, cuts = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
    return Alignment(
        owner_a[links],
        owner_b[links],
        np.searchsorted(links, ends),
        np.searchsorted(cuts, ends),
        np.append(owner_a[cuts], len(count_a)).astype(np.int64),
        np.append(owner_b[cuts], len(count_b)).astype(np.int64),
    )


def group_text(found: Alignment, ids_a: np.ndarray, ids_b: np.ndarray, a: TokenBytes, b: TokenBytes) -> tuple[np.ndarray, np.ndarray]:
    """All groups as ``a1,a2|b1;`` and the offset of each group's text."""
    groups = len(found.first_a) - 1
    in_a, in_b = np.diff(found.first_a), np.diff(found.first_b)
    # tokens in order: those of A in a group, then those of B
    place_a = np.arange(len(ids_a)) + np.repeat(found.first_b[:-1], in_a)
    place_b = np.arange(len(ids_b)) + np.repeat(found.first_a[1:], in_b)
    total = len(ids_a) + len(ids_b)
    wide = max(a.digits.shape[1], b.digits.shape[1])
    chars, width = np.full((total, wide), 32, np.uint8), np.empty(total, np.int64)
    for table, ids, place, first, last in ((a, ids_a, place_a, found.first_a, b"|"), (b, ids_b, place_b, found.first_b, b";")):
        chars[place, : table.digits.shape[1]] = table.digits[ids]
        width[place] = table.width[ids]
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[first[1:] - 1] = last[0]
        chars[place, table.width[ids]] = mark
    text = chars[np.arange(wide) <= width[:, None]]
    offsets = np.concatenate([[0], np.cumsum(width + 1)])
    starts = np.append(found.first_a[:-1] + found.first_b[:-1], total)
    return text, offsets[starts] if groups else np.zeros(1, np.int64)


class _Rows:
    """Facts of texts, collected for one Arrow batch."""

    FIELDS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")

    def __init__(self):
        self.columns: dict[str, list] = {f: [] for f in self.FIELDS}

    def add(self, *values) -> None:
        for field, value in zip(self.FIELDS, values, strict=True):
            self.columns[field].append(value)


def _pair_codes(found: Alignment, ids_a: np.ndarray, ids_b: np.ndarray, size_b: int) -> np.ndarray:
    return ids_a[found.a].astype(np.int64) * size_b + ids_b[found.b]


def _short_texts(aligner: Aligner, data: np.ndarray, offsets: np.ndarray, rows: _Rows) -> None:
    """All texts of a block at once."""
    ids_a, at_a, ids_b, at_b, spelt = aligner.encode(data, offsets)
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) * spelt)])
    found = align(aligner.a_bytes.count[ids_a], aligner.b_bytes.count[ids_b], ends)
    text, at_text = group_text(found, ids_a, ids_b, aligner.a_bytes, aligner.b_bytes)
    codes = _pair_codes(found, ids_a, ids_b, aligner.b_bytes.size)
    every = aligner.a_bytes.size * aligner.b_bytes.size
    of_row = np.repeat(np.arange(len(spelt)), np.diff(found.at_links))
    keys, times = np.unique(of_row * every + codes, return_counts=True)
    at_keys = np.searchsorted(keys, np.arange(len(spelt) + 1) * every)
    codes, held = keys % every, memoryview(text)
    n_links, n_groups = np.diff(found.at_links).tolist(), np.diff(found.at_groups).tolist()
    n_a, n_b = np.diff(at_a).tolist(), np.diff(at_b).tolist()
    starts = at_text[found.at_groups].tolist()
    for k in range(len(spelt)):
        x, y = at_keys[k], at_keys[k + 1]
        digest = hashlib.sha256(held[starts[k] : starts[k + 1] - 1]).hexdigest() if n_a[k] else ""
        rows.add(n_a[k], n_b[k], n_groups[k], n_links[k], digest, codes[x:y], times[x:y])


def _long_text(aligner: Aligner, data: np.ndarray, rows: _Rows, step: int = WINDOW) -> None:
    """One text, ``step`` bytes at a time between common ends of tokens."""
    ids_a, _, ids_b, _, spelt = aligner.encode(data, np.array([0, len(data)]))
    count_a, count_b = aligner.a_bytes.count[ids_a], aligner.b_bytes.count[ids_b]
    end_a, end_b = np.cumsum(count_a), np.cumsum(count_b)
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    digest, n_groups, n_links, at, codes, times = hashlib.sha256(), 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
    while len(common) and at < common[-1]:
        end = int(common[max(np.searchsorted(common, at + step, "right") - 1, np.searchsorted(common, at, "right"))])
        on_a, on_b = (slice(np.searchsorted(e, at, "right"), np.searchsorted(e, end, "right")) for e in (end_a, end_b))
        found = align(count_a[on_a], count_b[on_b], np.array([0, end - at]))
        text, _ = group_text(found, ids_a[on_a], ids_b[on_b], aligner.a_bytes, aligner.b_bytes)
        digest.update(memoryview(text)[: len(text) - (end == common[-1])])
        n_groups, n_links = n_groups + len(found.first_a) - 1, n_links + len(found.a)
        new, counted = np.unique(_pair_codes(found, ids_a[on_a], ids_b[on_b], aligner.b_bytes.size), return_counts=True)
        codes, inverse = np.unique(np.concatenate([codes, new]), return_inverse=True)
        times = np.bincount(inverse, np.concatenate([times, counted]), len(codes)).astype(np.int64)
        at = end
    rows.add(len(ids_a), len(ids_b), n_groups, n_links, digest.hexdigest() if len(ids_a) else "", codes, times)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), kind, safe=False))


def _aligner(inputs: tuple[str, bytes]) -> Aligner:
    loaded, key = kept("alignment"), hash(inputs)
    keep_only("alignment", "hashers")
    if key not in loaded:
        loaded[key] = Aligner(*inputs)
    return loaded[key]


def _shared(spark: SparkSession, vocabulary_path: str, model_path: str) -> Broadcast:
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast((read_vocabulary(vocabulary_path), f.read()))


def linked(docs: DataFrame, vocabulary_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each text's distinct linked pairs and their links.

    A pair of ids is the number ``a * size of B + b``.
    """
    shared = _shared(docs.sparkSession, vocabulary_path, model_path)

    def run(batches):
        for batch in batches:
            for x, y, data, offsets in blocks(batch.column(1)):
                aligner, rows = _aligner(shared.value), _Rows()
                if len(data) > WINDOW and y - x == 1:
                    _long_text(aligner, data, rows)
                else:
                    _short_texts(aligner, data, offsets, rows)
                made = rows.columns
                arrays = [batch.column(0).slice(x, y - x), *(pa.array(made[f], pa.int64()) for f in rows.FIELDS[:4]), pa.array(made["groups_sha256"], pa.string())]
                arrays += [_lists(made["pairs"], pa.int64()), _lists(made["times"], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", *rows.FIELDS])

    kind = docs.schema[id_col].dataType.simpleString()
    # both tokenizers read a space and the text
    text = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col).cast("string"))).otherwise("")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each pair, and whether no pair of its id of A is held by more; written once."""
    counts, _ = settle(links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    of_a = F.floor(F.col("pair") / size_b).alias("a")
    # one row for each entry of A's vocabulary at most
    highest = counts.groupBy(of_a).agg(F.max("n").alias("highest"))
    return counts.select("*", of_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _class(n: str = "n"):
    return F.floor(F.log2(n) * _FINE)


def frequent_class(counts: DataFrame, most: int) -> tuple[int, bool]:
    """The lowest class of frequency from which on there are at most ``most`` pairs, and whether those are all."""
    sizes = sorted(counts.groupBy(_class().alias("class")).count().collect(), reverse=True)  # some hundred rows
    total, lowest = 0, 1 << 20
    for of_class, pairs in sizes:
        if total + pairs > most:
            return lowest, False
        total, lowest = total + pairs, of_class
    return lowest, True


def alignment(docs: DataFrame, vocabulary_path: str, model_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every text."""
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    found = linked(docs, vocabulary_path, model_path, id_col, text_col)
    links, _ = settle(found.withColumnRenamed(id_col, "id").withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = pair_counts(links, size_b)
    lowest, all_of_them = frequent_class(counts, most)
    table = counts.where(_class() >= lowest).toArrow()
    columns = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    order = np.argsort(columns[0])
    shared = spark.sparkContext.broadcast(tuple(c[order] for c in columns))

    def run(batches):
        pair, n, best = shared.value
        if not len(pair):
            pair, n, best = np.array([-1]), np.array([0]), np.array([False])
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, many = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            place = np.minimum(np.searchsorted(pair, flat), len(pair) - 1)
            known = pair[place] == flat
            sums = np.concatenate([[0], np.cumsum(np.where(known, n[place] * many, 0))])
            bests = np.concatenate([[0], np.cumsum(np.where(known & best[place], many, 0))])
            rest = np.concatenate([[0], np.cumsum(~known)])[at].astype(np.int32)
            out = [*(batch.column(c) for c in _KEPT), pa.array(np.diff(bests[at])), pa.array(np.diff(sums[at]))]
            out += [pa.ListArray.from_arrays(rest, pa.array(flat[~known])), pa.ListArray.from_arrays(rest, pa.array(many[~known]))]
            yield pa.RecordBatch.from_arrays(out, names=[*_KEPT, "n_best", "count_sum", "rest", "rest_times"])

    kind = docs.schema[id_col].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _KEPT[2:6])
    schema = f"row long, id {kind}, {numbers}, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>"
    out = links.select(*_KEPT, "pairs", "times").mapInArrow(run, schema)
    if not all_of_them:
        out = _with_rest(settle(out, "alignment-rest")[0], counts)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_KEPT = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _with_rest(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds what the rarer pairs contribute, by a join on pairs that few documents hold."""
    rest = rows.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("r"))
    rest = rest.select("row", F.col("r.rest").alias("pair"), F.col("r.rest_times").alias("times"))
    more = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    added = rows.join(more, "row", "left").fillna(0, ["more", "more_best"])
    return added.withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn("count_sum", F.col("count_sum") + F.col("more"))
