"""Token ids on disk: static range asymmetric numeral system in independent blocks.

One frequency table, counted over the whole corpus, is shared by all files and
blocks.  A block holds up to ``BLOCK_TOKENS`` tokens in ``LANES`` interleaved
coder states, so encoding and decoding run over all lanes at once.  It carries
a checkpoint (its first token's place in the corpus and the final states),
checksums of its coded and decoded content and the documents it has tokens of,
so any block can be read by its range and decoded alone.  Readers list the
blocks by their heads, deal them out one by one and decode them in parallel,
whatever the size of the files; a document that spans blocks is put together
from its parts in order.

File layout, all integers little-endian; each record is followed by b"\n":
  table   b"RTB1", u32 byte length, zlib of u32 symbol count and (u32 id, u32 frequency) pairs
  block   b"RBK1", u32 byte length, u64 first token, u32 tokens, u32 crc32 of ids, u32 crc32 of
          the payload, u32 bytes of documents, documents: zlib of (i64 id, u64 first token, u64
          tokens) of each document that has tokens in the block, payload: LANES u64 states, u32 words

Ids come from the tokenizers library's model for the pieces of a text; pieces
are cut by :class:`citeweave.llm.bpe.TextEncoder`, which tests hold against the
library's encoding of whole texts.

Cases: null text counts as empty and yields the end id alone; repeated doc ids
are written one after another; null doc ids come first; an empty table gives
files without blocks; a document without tokens (no end id) stands in the block
before it; a token the table doesn't know cannot occur, since the table is
counted over the same ids; extra columns are dropped.
"""

from __future__ import annotations

import struct
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TextEncoder, byte_alphabet, read_vocabulary
from .storage import discard, new_path, open_file, partitions, settle, write_records
from .text_blocks import blocks, keep_only, kept

LANES = 2048
BLOCK_TOKENS = 1 << 18
SCALE_BITS = 24
_COARSE_BITS = 10
_LOW = 1 << 31  # coder states stay in [_LOW, _LOW << 32)
_HEAD = "<4sI"
_BLOCK = "<QIIII"


class FrequencyTable:
    """Frequencies scaled to 2**SCALE_BITS, at least 1 for each id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids = ids[order].astype(np.uint32)
        counts = counts[order].astype(np.float64)
        total = 1 << SCALE_BITS
        if len(ids):
            freq = np.maximum(1, np.floor(counts / counts.sum() * (total - len(ids)))).astype(np.int64)
            freq[np.argmax(freq)] += total - freq.sum()
        else:
            freq = np.zeros(0, np.int64)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._index()

    def _index(self) -> None:
        """Where to look ids and slots up: a place for each id, and the symbol at the beginning of each range of slots."""
        self.place = np.full(int(self.ids.max(initial=0)) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        edges = np.arange((1 << SCALE_BITS - _COARSE_BITS) + 1, dtype=np.uint64) << np.uint64(_COARSE_BITS)
        edges[-1] -= np.uint64(1)
        self.coarse = np.searchsorted(self.start, edges, "right") - 1

    def symbol_of(self, slot: np.ndarray) -> np.ndarray:
        """The symbols whose ranges hold the slots; most ranges of slots belong to one symbol."""
        at = (slot >> np.uint64(_COARSE_BITS)).astype(np.int64)
        symbol = self.coarse[at]
        open_ = np.flatnonzero(symbol != self.coarse[at + 1])
        symbol[open_] = np.searchsorted(self.start, slot[open_], "right") - 1
        return symbol

    def pack(self) -> bytes:
        pairs = np.stack([self.ids, self.freq.astype(np.uint32)], 1) if len(self.ids) else np.zeros((0, 2), np.uint32)
        return zlib.compress(struct.pack("<I", len(self.ids)) + pairs.astype("<u4").tobytes())

    @classmethod
    def unpack(cls, data: bytes) -> FrequencyTable:
        raw = zlib.decompress(data)
        pairs = np.frombuffer(raw, "<u4", offset=4).reshape(-1, 2)
        table = cls(np.zeros(0), np.zeros(0))
        table.ids, table.freq = pairs[:, 0].copy(), pairs[:, 1].astype(np.uint64)
        table.start = np.cumsum(table.freq) - table.freq
        table._index()
        return table

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) and int(ids.max()) >= len(self.place):
            raise ValueError("an id is not in the frequency table")
        at = self.place[ids]
        if len(ids) and at.min() < 0:
            raise ValueError("an id is not in the frequency table")
        return at


def encode_block(symbols: np.ndarray, table: FrequencyTable) -> bytes:
    """Final states of the lanes, then the 32-bit words in the order the decoder reads them."""
    state = np.full(LANES, _LOW, np.uint64)
    words: list[np.ndarray] = []
    shift, thirty_two = np.uint64(SCALE_BITS), np.uint64(32)
    step = len(symbols) - len(symbols) % LANES
    for at in range(step, -1, -LANES):
        part = symbols[at : at + LANES]
        if not len(part):
            continue
        x, freq, start = state[: len(part)], table.freq[part], table.start[part]
        full = x >= (freq << np.uint64(63 - SCALE_BITS))
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> thirty_two, x)
        quotient = x // freq
        state[: len(part)] = (quotient << shift) + (x - quotient * freq) + start
    return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))


def decode_block(data: bytes, n: int, table: FrequencyTable) -> np.ndarray:
    """The symbols of one block."""
    state = np.frombuffer(data, "<u8", LANES).astype(np.uint64)
    words = np.frombuffer(data, "<u4", offset=8 * LANES).astype(np.uint64)
    out, at, mask, shift = np.zeros(n, np.int64), 0, np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    low, thirty_two = np.uint64(_LOW), np.uint64(32)
    for k in range(0, n, LANES):
        x = state[: min(LANES, n - k)]
        slot = x & mask
        symbol = table.symbol_of(slot)
        out[k : k + len(x)] = symbol
        x = table.freq[symbol] * (x >> shift) + slot - table.start[symbol]
        need = np.flatnonzero(x < low)
        x[need] = (x[need] << thirty_two) | words[at : at + len(need)]
        at += len(need)
        state[: len(x)] = x
    return out


def record(kind: bytes, body: bytes) -> bytes:
    return struct.pack(_HEAD, kind, len(body)) + body


def heads(stream):
    """(kind, offset of the body, its bytes) of a file's records, without reading the blocks; raises where the file is cut or damaged."""
    at, size = 0, stream.size()
    while at < size:
        stream.seek(at)
        head = stream.read(struct.calcsize(_HEAD))
        if len(head) < struct.calcsize(_HEAD):
            raise ValueError("damaged token file")
        kind, length = struct.unpack(_HEAD, head)
        at += struct.calcsize(_HEAD)
        if kind not in (b"RTB1", b"RBK1") or at + length + 1 > size:
            raise ValueError("damaged token file")
        yield kind, at, length
        at += length
        stream.seek(at)
        if stream.read(1) != b"\n":
            raise ValueError("damaged token file")
        at += 1


def pack_block(first: int, ids: np.ndarray, docs: list[tuple[int, int, int]], table: FrequencyTable) -> bytes:
    """A block's record from its ids and the (id, first token, tokens) of its documents."""
    payload = encode_block(table.symbols(ids), table)
    of_docs = zlib.compress(np.array(docs, "<i8").tobytes(), 1)
    return record(b"RBK1", struct.pack(_BLOCK, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(payload), len(of_docs)) + of_docs + payload)


def unpack_block(body: bytes, table: FrequencyTable) -> tuple[int, np.ndarray, np.ndarray]:
    """(first token, ids, documents) of a block's body; checksums are verified."""
    first, n, of_ids, of_payload, size = struct.unpack_from(_BLOCK, body)
    at = struct.calcsize(_BLOCK)
    docs = np.frombuffer(zlib.decompress(body[at : at + size]), "<i8").reshape(-1, 3)
    payload = bytes(body[at + size :])
    if zlib.crc32(payload) != of_payload:
        raise ValueError("block payload does not match its checksum")
    ids = table.ids[decode_block(payload, n, table)] if n else np.zeros(0, np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != of_ids:
        raise ValueError("decoded ids do not match their checksum")
    return first, ids, docs


_NO_ID = -(1 << 63)
COUNTS = -1


def _library_encoder(vocabulary: str) -> TextEncoder:
    """Whole texts to ids by the tokenizers library's own model, called once for each distinct piece."""
    encoders, key = kept("rans"), hash(vocabulary)
    keep_only("rans", "hashers")
    if key not in encoders:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(vocabulary)
        special = {t.content: k for k, t in library.get_added_tokens_decoder().items()}
        alphabet = {b: c for c, b in byte_alphabet().items()}
        model = library.model

        def piece(text: str) -> list[int]:
            return [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(alphabet))]

        encoders[key] = TextEncoder(special, library.get_vocab_size(), piece)
    return encoders[key]


def range_bounds(docs: DataFrame, id_col: str) -> np.ndarray:
    """The smallest id of each of about as many ranges as there are shuffle partitions; reads ids alone."""
    spark = docs.sparkSession
    ranges = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").repartitionByRange(partitions(spark), "doc_id")
    rows = ranges.groupBy(F.spark_partition_id().alias("part")).agg(F.min("doc_id").alias("first")).toPandas()
    return np.sort(rows["first"].to_numpy(np.int64))


def tokenize(docs: DataFrame, vocabulary_path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(part, doc_id, n, ids): each text's packed ids with the end id, and the range of ids it belongs to.

    Texts are encoded where they are read; only packed ids are ever moved.  Each
    task's last row, of the part ``COUNTS``, holds how often it saw each id.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((read_vocabulary(vocabulary_path), range_bounds(docs, id_col)))
    tail = [] if end_id is None else [end_id]

    def run(batches):
        vocabulary, bounds = shared.value
        encoder = _library_encoder(vocabulary)
        kind = encoder.kind if max(tail, default=0) < 1 << 16 else "<u4"
        end, seen = np.array(tail, kind), np.zeros(1 << 16, np.int64)
        for batch in batches:
            doc = np.asarray(batch.column(0).fill_null(_no_id()))
            parts = np.maximum(0, np.searchsorted(bounds, doc, "right") - 1).astype(np.int32)
            for a, b, data, offsets in blocks(batch.column(1)):
                flat, at = encoder.block_ids(data, offsets)
                found = np.bincount(flat, minlength=len(seen))
                if len(found) > len(seen):
                    seen = np.pad(seen, (0, len(found) - len(seen)))
                seen += found
                for k in tail:
                    seen[k] += b - a
                ids = [np.concatenate([flat[x:y].astype(kind), end]) for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(parts[a:b]), batch.column(0).slice(a, b - a), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "doc_id", "n", "ids"])
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([COUNTS], pa.int32()), pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.array([np.stack([on, seen[on]]).astype("<i8").tobytes()], pa.binary())], names=["part", "doc_id", "n", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, doc_id long, n long, ids binary")


def unpack(ids: bytes, n: int) -> np.ndarray:
    """Ids packed in two or four bytes each, as unsigned 32-bit integers."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")


def _no_id() -> int:
    return _NO_ID


def count_ids(tokens: DataFrame) -> FrequencyTable:
    """Frequencies over the whole corpus from the tasks' counts; one row for each distinct id reaches the driver."""

    def run(batches):
        for batch in batches:
            for value in batch.column(0).to_pylist():
                ids, counts = np.frombuffer(value, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts)], names=["id", "n"])

    rows = tokens.where(F.col("part") == COUNTS).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return FrequencyTable(rows["id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


def write_files(tokens: DataFrame, path: str) -> None:
    """Write tokenised documents to coded files, one for each range partition of ids."""
    spark = tokens.sparkSession
    table = count_ids(tokens)
    tokens = tokens.where(F.col("part") != COUNTS)
    totals = {r["part"]: r["n"] for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    first, at = {}, 0
    for part in sorted(totals):
        first[part] = at
        at += totals[part]
    shared = spark.sparkContext.broadcast((table.pack(), first))

    def run(batches):
        packed, firsts = shared.value
        table = FrequencyTable.unpack(packed)
        waiting, size, at, docs, opened, doc_at = [], 0, 0, [], False, 0

        def out(*parts):
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["record"])

        for batch in batches:
            for part, doc, n, value in zip(*batch.columns, strict=True):
                n = n.as_py()
                if not opened:
                    opened, at = True, firsts[part.as_py()]
                    doc_at = at
                    yield out(record(b"RTB1", packed))
                docs.append((doc.as_py() if doc.is_valid else _NO_ID, doc_at, n))
                doc_at += n
                waiting.append(unpack(value.as_py(), n))
                size += n
                if size < BLOCK_TOKENS:
                    continue
                ids = np.concatenate(waiting)
                for k in range(0, size - BLOCK_TOKENS + 1, BLOCK_TOKENS):
                    end = at + BLOCK_TOKENS
                    yield out(pack_block(at, ids[k : k + BLOCK_TOKENS], [d for d in docs if d[1] < end or d[1] == end and not d[2]], table))
                    docs = [d for d in docs if d[1] + d[2] > end]
                    at = end
                waiting = [ids[size - size % BLOCK_TOKENS :]]
                size %= BLOCK_TOKENS
        if size or docs:
            yield out(pack_block(at, np.concatenate(waiting), docs, table))

    # one task for each range partition, by its number: its rows stay together and in order
    placed = tokens.select("part", "doc_id", "n", "ids").repartitionById(1 + max(first, default=0), F.col("part")).sortWithinPartitions("part", "doc_id")
    write_records(placed.mapInArrow(_by_part(run), "record binary"), "record", path, "\n")


def _by_part(run):
    """Apply ``run`` to each part of a task in turn."""

    def parts(batches):
        def rows():
            for batch in batches:
                column = np.asarray(batch.column(0))
                cuts = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a:
                        yield int(column[a]), batch.slice(a, b - a)

        for _, group in groupby(rows(), key=lambda x: x[0]):
            yield from run(batch for _, batch in group)

    return parts


def list_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, table, table_bytes, offset, bytes) of every block of coded files and of the table it needs, from the heads alone."""

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                table, rows = None, []
                with open_file(f"{path}/{file}") as stream:
                    for kind, at, length in heads(stream):
                        if kind == b"RTB1":
                            table = (at, length)
                        else:
                            rows.append((file, *table, at, length))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["file", "table", "table_bytes", "offset", "bytes"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.mapInArrow(run, "file string, table long, table_bytes long, offset long, bytes long")


def read_parts(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, at, ids, ids_crc32): each document's tokens of each block it is in; ``at`` is where the part begins.

    Blocks are dealt one by one.  ``ids`` of documents that are whole in a block are left out unless asked for.
    """

    def run(batches):
        known, table = b"", None
        for batch in batches:
            for file, table_at, table_size, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_file(f"{path}/{file}") as stream:
                    stream.seek(table_at)
                    packed = stream.read(table_size)
                    if packed != known:
                        known, table = packed, FrequencyTable.unpack(packed)
                    stream.seek(at)
                    first, ids, docs = unpack_block(stream.read(size), table)
                packed, rows = ids.astype("<u4").tobytes(), []
                for doc, start, n in docs.tolist():
                    a, b = max(start, first) - first, min(start + n, first + len(ids)) - first
                    piece = packed[4 * a : 4 * b]
                    rows.append((None if doc == _NO_ID else doc, start, n, first + a - start, piece if with_ids or b - a < n else None, zlib.crc32(piece)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns, kinds)], names=["doc_id", "start", "n_tokens", "at", "ids", "ids_crc32"])

    blocks_ = list_blocks(spark, path).repartition(partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    return blocks_.mapInArrow(run, "doc_id long, start long, n_tokens long, at long, ids binary, ids_crc32 long")


def read_files(spark: SparkSession, path: str, with_ids: bool = True) -> tuple[DataFrame, list[str]]:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document in coded files, and the tables it reads; documents of several blocks are put together."""
    parts, stage = settle(read_parts(spark, path, with_ids), "token-parts")

    def run(batches):
        held, key = [], None

        def whole():
            ids = b"".join(x for *_, x in held)
            doc, start, n, _ = held[0]
            if len(ids) != 4 * n:
                raise ValueError("a block is missing")
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([ids if with_ids else None], pa.binary()), pa.array([zlib.crc32(ids)], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

        for batch in batches:
            for doc, start, n, ids in zip(*batch.columns, strict=True):
                if start.as_py() != key and held:
                    yield whole()
                    held = []
                key = start.as_py()
                held.append((doc.as_py(), key, n.as_py(), ids.as_py()))
        if held:
            yield whole()

    one = parts.where("octet_length(ids) = 4 * n_tokens or ids is null").select("doc_id", "start", "n_tokens", "ids", "ids_crc32")
    more = parts.where("octet_length(ids) < 4 * n_tokens").repartition(partitions(spark), "start").sortWithinPartitions("start", "at")
    return one.unionByName(more.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")), [stage]


def write_corpus(docs: DataFrame, path: str, vocabulary_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenise whole texts and write them to coded files in ascending id order."""
    tokens, stage = settle(tokenize(docs, vocabulary_path, end_id, id_col, text_col), "tokens")
    write_files(tokens, path)
    discard(docs.sparkSession, stage)
    return path


def digests(docs: DataFrame, vocabulary_path: str, end_id: int) -> DataFrame:
    """Write, read back and digest: (doc_id, start, n_tokens, ids_crc32) from the files."""
    spark = docs.sparkSession
    path = write_corpus(docs, new_path(spark, "token-files"), vocabulary_path, end_id)
    found, stages = read_files(spark, path, with_ids=False)
    result, _ = settle(found.select("doc_id", "start", "n_tokens", "ids_crc32"), "token-digests")
    discard(spark, path, *stages)
    return result
