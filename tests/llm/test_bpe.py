import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from citeweave.llm import bpe, rans
from citeweave.llm.text_blocks import blocks

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "é", "日", "'s", "'ll", "1", "23", "!", "<|endoftext|>", " ", "　", "the", "ing", "\x1c", "aaaa", "🙂", "_", "́", "\x85"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducer():
    return bpe._transducer(bpe.read_vocabulary(PATH))


def by_block(texts, encoder):
    out = []
    for _, _, data, offsets in blocks(pa.array(texts, pa.string())):
        ids, at = encoder.block_ids(data, offsets)
        out += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def test_matches_library(library, transducer):
    merges, encoder = transducer
    draw = random.Random(1)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, by_block(texts, encoder), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want and encoder.ids(text).tolist() == want
        assert "".join(bpe.decoded_text(np.array(ids, np.int64), merges)) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "theinganorst", "=-", "0123456789", "日本語é"])
def test_long_pieces_need_only_the_lookahead(library, transducer, alphabet):
    merges, encoder = transducer
    assert merges.lookahead < 1000
    draw = random.Random(2)
    for n in (40, 600, 5000):
        text = "".join(draw.choice(alphabet) for _ in range(n))
        assert by_block([text], encoder)[0] == library.encode(text, add_special_tokens=False).ids


def test_more_chunks_than_slots(library, transducer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 40)
    monkeypatch.setattr(bpe, "SLOTS_LOG2", 6)
    merges, _ = transducer
    machine = bpe.Encoder(merges)
    encoder = bpe.TextEncoder(merges.special, len(merges.token_bytes), lambda p: machine.piece(p.encode()))
    texts = [" ".join(f"{k * 7919:x}" for k in range(n)) for n in (10, 500, 300)]
    for text in [*texts, *texts]:
        assert by_block([text], encoder)[0] == library.encode(text, add_special_tokens=False).ids
        assert encoder.entries <= 40


def thue_morse(n):
    """Two unequal strings of n bytes that every polynomial hash modulo 2**64 takes for equal."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_strings_that_weak_hashes_confuse(spark, library):
    texts = [t for n in (1024, 2048, 4096) for t in thue_morse(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in enumerate(texts)}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs, PATH).collect()} == want
    found = {r.doc_id: r.ids_crc32 for r in rans.digests(docs, PATH, 2).collect()}
    assert found == {d: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for d, ids in want.items()}


def test_equal_hashes_are_compared(library, transducer, monkeypatch):
    merges, _ = transducer
    machine = bpe.Encoder(merges)
    encoder = bpe.TextEncoder(merges.special, len(merges.token_bytes), lambda p: machine.piece(p.encode()))

    class Weak:
        def sums(self, data):
            return data

        def hashes(self, data, starts, ends):
            return data[starts].astype(np.uint64) << np.uint64(50)

    monkeypatch.setattr(bpe, "span_hasher", lambda base: Weak())
    texts = ["the cat", "the cow then", "a dog", "the cat sat", "the", "cat cat cow"]
    for _ in range(2):
        assert by_block(texts, encoder) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_go_window_by_window(library, transducer, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 64)
    merges, _ = transducer
    machine = bpe.Encoder(merges)
    encoder = bpe.TextEncoder(merges.special, len(merges.token_bytes), lambda p: machine.piece(p.encode()))
    draw = random.Random(8)
    for longest in (1 << 24, 256):
        monkeypatch.setattr(bpe, "_LONGEST", longest)
        for _ in range(200):
            text = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 300)))
            parts = list(encoder.stream(np.frombuffer(text.encode(), np.uint8)))
            assert [t for p in parts for t in p.tolist()] == library.encode(text, add_special_tokens=False).ids
    words = " ".join(f"word{k}" for k in range(500))
    assert max(map(len, encoder.stream(np.frombuffer(words.encode(), np.uint8)))) <= 64


def test_stream_in_small_parts(transducer):
    merges, _ = transducer
    data = b"theinganorst" * 500
    machine = bpe.Encoder(merges)
    out = []
    for k in range(0, len(data), 7):
        out += machine.feed(data[k : k + 7])
        assert len(machine.held) <= machine.window + 7
    assert out + machine.finish() == bpe.Encoder(merges).piece(data)


def test_cases(spark, library):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> a", "x"), (3, "<|endoftext|> a", "x"), (None, "b", "x")], "doc_id long, text string, n_tokens string")
    rows = bpe.round_trip(docs, PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("None", 1)]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in again) == ["", "", "<|endoftext|> a", "<|endoftext|> a", "b"]


def test_coder_round_trip():
    draw = np.random.default_rng(3)
    for n in (0, 1, 5, rans.LANES, rans.LANES + 1, 20000):
        ids = draw.zipf(1.3, n) % 50000
        values, counts = np.unique(ids, return_counts=True)
        table = rans.FrequencyTable.unpack(rans.FrequencyTable(values, counts).pack())
        data = rans.encode_block(table.symbols(ids), table)
        assert (table.ids[rans.decode_block(data, n, table)] == ids).all()
    one = rans.FrequencyTable(np.array([7]), np.array([5]))
    assert (rans.decode_block(rans.encode_block(np.zeros(3000, np.int64), one), 3000, one) == 0).all()


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_token_files(spark, library, monkeypatch, block):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", block)
    docs = [(k * 3 % 50, f"text {k} " * (k % 7)) for k in range(50)] + [(100, None), (101, "x" * 3000), (101, "x" * 3000), (None, "no id"), (102, "a b " * 64)]
    table = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, start string").repartition(3)
    rows = rans.digests(table, PATH, 2).orderBy("start").collect()
    at = 0
    for r, (d, t) in zip(rows, sorted(docs, key=lambda x: -1 if x[0] is None else x[0]), strict=True):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert rans.digests(table.limit(0), PATH, 2).count() == 0


def test_blocks_are_read_by_their_ranges(spark, library, tmp_path, monkeypatch):
    """Every block can be decoded alone, from the checkpoint it carries; documents without tokens are kept."""
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 32)
    docs = [(k, "" if k % 5 == 0 else f"some words {k} " * (k % 9)) for k in range(60)]
    path = rans.write_corpus(spark.createDataFrame(docs, "doc_id long, text string"), f"file://{tmp_path}/files", PATH)
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in docs}
    listed = rans.list_blocks(spark, path).collect()
    assert len(listed) >= sum(map(len, ids.values())) // 32
    (folder,) = [tmp_path / "files"]
    for r in listed[:20]:
        data = (folder / r.file).read_bytes()
        table = rans.FrequencyTable.unpack(data[r.table : r.table + r.table_bytes])
        first, tokens, of = rans.unpack_block(data[r.offset : r.offset + r.bytes], table)
        for d, start, n in of.tolist():
            a, b = max(first, start), min(first + len(tokens), start + n)
            assert tokens[a - first : b - first].tolist() == ids[d][a - start : b - start]
    found, _ = rans.read_files(spark, path)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in found.collect()} == ids


def test_damage_is_found():
    table = rans.FrequencyTable(np.array([1, 2]), np.array([3, 5]))
    good = rans.record(b"RTB1", table.pack()) + b"\n"
    assert [k for k, *_ in rans.heads(pa.BufferReader(good))] == [b"RTB1"]
    for bad in (good + b"x", good[:-1] + b"x", good[:-1], b"XXXX" + good[4:]):
        with pytest.raises(ValueError):
            list(rans.heads(pa.BufferReader(bad)))
    body = rans.pack_block(0, np.array([1, 2, 2], np.uint32), [(5, 0, 3)], table)[8:]
    assert rans.unpack_block(body, table)[1].tolist() == [1, 2, 2]
    with pytest.raises(ValueError):
        rans.unpack_block(body[:-9] + b"\0" * 9, table)
