"""Web archives with a two-level capture index.

Archives.  One gzip member per record, so any record can be read by its range.
Of captures with equal payloads of ``REVISIT_BYTES`` or more, that of the
smallest page id is a response and the others are revisits of it.  Spark's text
sink writes the members: it ends rows with a separator, which here is the zero
byte by which a gzip member of less than 16 MiB ends anyway (a larger one is
followed by an empty member, which does too).

Index.  Captures are sorted by reversed-host URL key and cut into compressed
blocks of ``BLOCK_LINES``; index files are made of such blocks, range after
range of keys.  A sparse directory holds each block's first and last key and its
range of bytes.

Lookup.  Keys are dealt to the index files whose key ranges hold them (one row
for each file is known to all tasks).  A task binary-searches the file's part of
the directory, reads the block's range, binary-searches the block, and so gets
the ranges of the records, which are dealt anew and read from the archives:
no archive is read but by ranges.  Tasks open files below the shared folder
through Arrow's file systems; a store that Arrow can't open is an error.

Payloads move at most once, by page id and digest: who revisits whom is found
from ids and digests alone, and payloads too short for a revisit don't move.

Cases: null payload counts as empty; a null URL has the empty key; control
characters and spaces in URLs are percent-encoded; rows that repeat a page give
records of their own, equal in type; a null page id is kept, is a response and
is never referred to; a URL with very many captures spans blocks and files; an
empty table gives archives without records; extra columns are dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import discard, new_path, open_file, partitions, settle, write_records

REVISIT_BYTES = 100
BLOCK_LINES = 3000
READ_BYTES = 4 << 20  # neighbouring ranges are read together up to this size
STRIPE_BYTES = 32 << 20  # ranges of one archive are dealt in stripes of this size
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the archive format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``org,example)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else "//" + url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe="/?&=%:;,.~-_+")
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return quote(f"{host}{f':{port}' if port else ''}){parts.path or '/'}{query}", safe="/?&=%:;,.~-_+)!$'(*@[]")


def target_uri(url: str) -> str:
    """A URL as it stands in a record: control characters, spaces and other scripts percent-encoded."""
    return quote(url, safe="".join(map(chr, range(33, 127))))


def lookup_key(url: str | None) -> str:
    """The key under which a page's capture is indexed."""
    return url_key(None if url is None else target_uri(url))


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    out = b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return out if out[-1] == 0 else out + gzip_member(b"")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One archive record: a response with its HTTP block, or a revisit without payload."""
    page = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:capture:{page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + target_uri(url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:capture:{refers_to}>"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(pieces) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each record in an archive that comes piece by piece; an empty member belongs to the record before."""
    pieces, rest, at, pending = iter(pieces), b"", 0, None
    while True:
        if not rest and not (rest := next(pieces, b"")):
            break
        machine, parts, size = zlib.decompressobj(31), [], 0
        while True:
            parts.append(machine.decompress(rest))
            size += len(rest) - len(machine.unused_data)
            rest = machine.unused_data
            if machine.eof:
                break
            if not (rest := next(pieces, b"")):
                raise ValueError("cut archive")
        content = b"".join(parts)
        if pending and not content:
            pending = (pending[0], at + size - pending[0], pending[2])
        else:
            if pending:
                yield pending
            pending = (at, size, content)
        at += size
    if pending:
        yield pending


def pieces_of(path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file from its beginning, a piece at a time."""
    with open_file(path) as stream:
        while piece := stream.read(size):
            yield piece


def read_ranges(folder: str, ranges) -> Iterator[tuple[str, int, bytes]]:
    """(file, offset, bytes) of (file, offset, length) in order; neighbours are read together."""
    for file, group in groupby(ranges, key=lambda r: r[0]):
        with open_file(f"{folder}/{file}") as stream:
            held: list[tuple[int, int]] = []

            def read(held, stream=stream, file=file):
                start = held[0][0]
                stream.seek(start)
                data = stream.read(held[-1][0] + held[-1][1] - start)
                for offset, length in held:
                    yield file, offset, data[offset - start : offset - start + length]

            for _, offset, length in group:
                if held and (offset != held[-1][0] + held[-1][1] or offset + length - held[0][0] > READ_BYTES):
                    yield from read(held)
                    held = []
                held.append((offset, length))
            if held:
                yield from read(held)


def parse_record(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    cut = content.index(b"\r\n\r\n")
    lines = content[:cut].decode("latin-1").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not an archive record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = content[cut + 4 : cut + 4 + int(headers["Content-Length"])]
    return headers, block[block.index(b"\r\n\r\n") + 4 :]


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:capture:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write one record per page to archive files below ``path``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= REVISIT_BYTES
    # who revisits whom, from ids and digests alone; written, so that joins can split a common digest
    known, p0 = settle(rows.where(large & F.col("page_id").isNotNull()).select("page_id", "digest"), "payload-digests")
    firsts, p1 = settle(known.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "first-payloads")
    revisits, p2 = settle(known.join(firsts, "digest").where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    typed = rows.where(large).join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")
    typed = typed.unionByName(rows.where(~large).withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out = [gzip_member(record_bytes(i, u, p.encode(), d, r))[:-1] for i, u, p, d, r in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    write_records(typed.mapInArrow(run, "record binary"), "record", path, "\0")
    discard(spark, p0, p1, p2)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The names of a folder's files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))


_CAPTURE = "key string, page_id long, file string, offset long, length long"
_DIRECTORY = "file string, first_key string, last_key string, captures long, offset long, length long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def _batches(rows, schema: str, size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def write_index(spark: SparkSession, archives: str, path: str) -> str:
    """Index the archives: files of sorted compressed blocks and their sparse directory."""

    def scan(batches):
        def rows():
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    for offset, length, content in members(pieces_of(f"{archives}/{file}")):
                        headers, _ = parse_record(content)
                        yield url_key(headers.get("WARC-Target-URI")), _page(headers["WARC-Record-ID"]), file, offset, length

        yield from _batches(rows(), _CAPTURE)

    captures, stage = settle(_files(spark, archives).mapInArrow(scan, _CAPTURE), "captures")
    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def pack(batches):
        lines: list[str] = []

        def block(part):
            return pa.RecordBatch.from_arrays([pa.array([gzip_member("\n".join(part).encode())[:-1]], pa.binary())], names=["record"])

        for batch in batches:
            lines += [f"{k} {'-' if i is None else i} {f} {o} {n}" for k, i, f, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            while len(lines) >= BLOCK_LINES:
                yield block(lines[:BLOCK_LINES])
                del lines[:BLOCK_LINES]
        if lines:
            yield block(lines)

    write_records(ordered.mapInArrow(pack, "record binary"), "record", f"{path}/blocks", "\0")

    def places(batches):
        def rows():
            for batch in batches:
                for file in batch.column(0).to_pylist():
                    for offset, length, content in members(pieces_of(f"{path}/blocks/{file}")):
                        lines = content.decode().split("\n")
                        yield file, lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0], len(lines), offset, length

        yield from _batches(rows(), _DIRECTORY)

    _files(spark, f"{path}/blocks").mapInArrow(places, _DIRECTORY).write.parquet(f"{path}/directory")
    discard(spark, stage)
    return path


def directory(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.schema(_DIRECTORY).parquet(f"{index}/directory")


def block_captures(lines: list[str], low: str | None, high: str | None) -> Iterator[tuple]:
    """The captures of a block's lines whose key lies between two keys, ends included, by binary search."""
    key = lambda line: line[: line.index(" ")]
    a = 0 if low is None else bisect.bisect_left(lines, low, key=key)
    b = len(lines) if high is None else bisect.bisect_right(lines, high, key=key)
    for line in lines[a:b]:
        k, page, file, offset, length = line.split(" ")
        yield k, None if page == "-" else int(page), file, int(offset), int(length)


def block_lines(folder: str, ranges) -> Iterator[list[str]]:
    """The lines of index blocks, read by their ranges."""
    for _, _, data in read_ranges(folder, ranges):
        ((_, _, content),) = members([data])
        yield content.decode().split("\n")


def captures_between(spark: SparkSession, index: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Captures whose key lies between two keys, ends included: only ranges of blocks that can hold them are read."""
    wanted = directory(spark, index)
    if low is not None:
        wanted = wanted.where(F.col("last_key") >= low)
    if high is not None:
        wanted = wanted.where(F.col("first_key") <= high)

    def run(batches):
        def rows():
            for batch in batches:
                for lines in block_lines(f"{index}/blocks", zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    yield from block_captures(lines, low, high)

        yield from _batches(rows(), _CAPTURE)

    return wanted.select("file", "offset", "length").mapInArrow(run, _CAPTURE)


def search_blocks(entries: list[tuple], folder: str, keys) -> Iterator[tuple]:
    """Captures of sorted keys in one index file: binary search in its directory, then in the blocks it names."""
    lasts, at, lines = [e[1] for e in entries], -1, []
    for key in keys:
        k = bisect.bisect_left(lasts, key)
        while k < len(entries) and entries[k][0] <= key:
            if k != at:
                at, (lines,) = k, block_lines(folder, [entries[k][2:]])
            yield from block_captures(lines, key, key)
            k += 1


def lookup_keys(spark: SparkSession, index: str, keys: DataFrame) -> DataFrame:
    """Captures of all keys in the column ``key``, each key once."""
    parts = directory(spark, index).groupBy("file").agg(F.min("first_key").alias("low"), F.max("last_key").alias("high")).collect()
    files = sorted((r["low"], r["high"], r["file"]) for r in parts)  # one row for each index file
    shared = spark.sparkContext.broadcast((files, [high for _, high, _ in files]))
    schema = "file string, kind long, key string, last_key string, offset long, length long"

    def deal(batches):
        files, highs = shared.value

        def rows():
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    k = bisect.bisect_left(highs, key)
                    while k < len(files) and files[k][0] <= key:
                        yield files[k][2], 1, key, None, None, None
                        k += 1

        yield from _batches(rows(), schema)

    asked = keys.select("key").where("key is not null").distinct().mapInArrow(deal, schema)
    entries = directory(spark, index).select("file", F.lit(0).cast("long").alias("kind"), F.col("first_key").alias("key"), "last_key", "offset", "length")
    dealt = asked.unionByName(entries).repartition(partitions(spark), "file").sortWithinPartitions("file", "kind", "offset", "key")

    def run(batches):
        def lines():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def rows():
            for file, group in groupby(lines(), key=lambda r: r[0]):
                found: list[tuple] = []

                def sought(group=group, found=found, file=file):
                    for _, kind, key, last, offset, length in group:
                        if kind:
                            yield key
                        else:
                            found.append((key, last, file, offset, length))

                keys = sought()
                first = next(keys, None)
                if first is not None:
                    yield from search_blocks(found, f"{index}/blocks", _after(first, keys))

        yield from _batches(rows(), _CAPTURE)

    return dealt.mapInArrow(run, _CAPTURE)


def _after(first, rest):
    yield first
    yield from rest


def lookup(spark: SparkSession, index: str, url: str) -> DataFrame:
    """Captures of one URL."""
    return lookup_keys(spark, index, spark.createDataFrame([(lookup_key(url),)], "key string"))


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_captures(spark: SparkSession, archives: str, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of captures, by their ranges.

    Ranges are dealt in stripes of the archives and read in order.  A response's
    digest and length must agree with what was read.
    """

    def run(batches):
        def wanted():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        held, size = [], 0
        for _, _, data in read_ranges(archives, wanted()):
            held.append(data)
            size += len(data)
            if len(held) == 256 or size >= READ_BYTES:
                yield _digested(held, payloads)
                held, size = [], 0
        if held:
            yield _digested(held, payloads)

    stripe = F.floor(F.col("offset") / STRIPE_BYTES)
    ranges = captures.select("file", "offset", "length").repartition(partitions(spark), "file", stripe).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(run, _RECORD)


def _digested(raw: list[bytes], payloads: bool) -> pa.RecordBatch:
    out = []
    for member in raw:
        ((_, _, content),) = members([member])
        headers, payload = parse_record(content)
        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["WARC-Payload-Length"])
        kind = headers["WARC-Type"]
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError("payload does not match its digest")
        out.append((_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, kind, _page(headers.get("WARC-Refers-To")), payload if payloads else None))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [f.split(" ")[0] for f in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def page_keys(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The index keys of pages' URLs."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lookup_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "key string")


def archived(pages: DataFrame) -> DataFrame:
    """Write, index, look every page's URL up and read its captures back: one row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    archives = write_archives(pages, f"{path}/records")
    index = write_index(spark, archives, f"{path}/index")
    found = read_captures(spark, archives, lookup_keys(spark, index, page_keys(pages)), payloads=False)
    result, _ = settle(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "archived")
    discard(spark, path)
    return result
