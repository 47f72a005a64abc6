import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from citeweave.llm import token_alignment as ta
from citeweave.llm.bpe import read_vocabulary
from citeweave.llm.text_blocks import blocks

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", "ing", "ation", " ", "  ", "   ", "\n", "\t", "é", "日本", "'s", "12", "!", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "🙂", "ﬁ", "́", "\x00", " ", "Ａ", "x" * 30]
ODD = ["▁", "a▁b c", "", " ", "  ", "\n", "a", "ａ"]
FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 16))) for _ in range(n)] + ODD


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(id, start, end) of both sides, or none."""
    a, b = libraries
    of_bytes = {c: k for c, k in __import__("citeweave.llm.bpe", fromlist=["byte_alphabet"]).byte_alphabet().items()}
    if not text:
        return [], []
    ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
    spelt = [
        [bytes(of_bytes[c] for c in a.id_to_token(k)) for k in ids[0]],
        [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids[1]],
    ]
    if any(b"".join(s) != (" " + text).encode() for s in spelt):
        return [], []
    out = []
    for side, parts in zip(ids, spelt, strict=True):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append([(k, e - len(p), e) for k, p, e in zip(side, parts, ends, strict=True)])
    return out


def brute(libraries, rows):
    """The whole contract in plain loops."""
    found, held = [], defaultdict(set)
    for n, (doc, text) in enumerate(rows):
        a, b = tokens(libraries, text)
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        for low, high in zip([0, *common], common, strict=False):
            groups.append("|".join(",".join(str(k) for k, s, e in side if low <= s and e <= high) for side in (a, b)))
        for link in links:
            held[link].add(n)
        found.append((doc, a, b, groups, links))
    highest = defaultdict(int)
    for (x, _), docs in held.items():
        highest[x] = max(highest[x], len(docs))
    out = []
    for doc, a, b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        best = sum(len(held[k]) == highest[k[0]] for k in links)
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(len(held[k]) for k in links), digest))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", *FIELDS).collect())


def test_piece_encoder_matches_library(libraries):
    aligner = ta.Aligner(read_vocabulary(A), open(B, "rb").read())
    assert aligner.b.cuts
    some = [t for t in texts(3000, 1) if t]
    for whole in (True, False):
        aligner.b.cuts = whole
        have = []
        for _, _, data, offsets in blocks(pa.array([" " + t for t in some], pa.string())):
            ids, at = aligner.b.block_ids(data, offsets)
            have += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)]
        assert have == libraries[1].encode(some)


def test_alignment_matches_brute_force(spark, libraries):
    rows = [(k, t) for k, t in enumerate(texts(400, 2))] + [(1, "the same"), (1, "the same"), (None, "the end"), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(libraries, rows)
    assert got(ta.alignment(docs, A, B)) == want
    # few pairs, or none, in the broadcast table: the rest goes through the join
    assert got(ta.alignment(docs, A, B, most=40)) == want
    assert got(ta.alignment(docs, A, B, most=0)) == want


def test_long_text_in_pieces(libraries):
    aligner = ta.Aligner(read_vocabulary(A), open(B, "rb").read())
    draw = random.Random(3)
    text = " ".join("".join(draw.choice(PARTS) for _ in range(4)) for _ in range(800))
    data = np.frombuffer((" " + text).encode(), np.uint8)
    one, other = ta._Rows(), ta._Rows()
    ta._short_texts(aligner, data, np.array([0, len(data)]), one)
    for step in (1, 37, 1 << 20):
        ta._long_text(aligner, data, other, step=step)
    for field in ta._Rows.FIELDS:
        for value in other.columns[field]:
            assert np.array_equal(value, one.columns[field][0])
    ta._long_text(aligner, np.frombuffer(" ▁".encode(), np.uint8), other)
    assert [other.columns[f][-1] for f in ta._Rows.FIELDS[:5]] == [0, 0, 0, 0, ""]


def test_long_text_through_the_query(spark, libraries):
    draw = random.Random(4)
    long = " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 9))) for _ in range(250_000))
    unbroken = "".join(draw.choice("ab1é日") for _ in range(500_000))
    rows = [(1, long), (2, "short text"), (3, unbroken)]
    out = {r.doc_id: r for r in ta.alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    a, b = libraries
    for doc, text in rows:
        assert (out[doc].n_a, out[doc].n_b) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
        assert 0 < out[doc].n_groups <= out[doc].n_links
        # each link ends where a token ends: links and groups make up the tokens
        assert out[doc].n_links == out[doc].n_a + out[doc].n_b - out[doc].n_groups


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment(empty, A, B).collect() == []
    clash = spark.createDataFrame([(1, "a b", 1, "x", 2)], "doc_id long, text string, row int, pairs string, n_a int")
    assert ta.alignment(clash, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ta.alignment(clash, A, B).collect()[0].n_a == 2
