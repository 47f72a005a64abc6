"""The pipeline against a brute-force version of its stages."""

import hashlib
import random

import numpy as np
import pytest

from citeweave.llm import langid
from tests.llm.test_dedup import jaccard_groups
from tests.llm.test_models import brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def cut(docs):
    """Texts without the bytes of strings of 100 bytes that start earlier too; documents with nothing left go."""
    first, out = {}, {}
    for d, t in docs:
        b = t.encode()
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (d, i))
    for d, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        parts, k = [], 0
        while k < len(b):
            e = k
            while e < len(b) and gone[e] == gone[k]:
                e += 1
            if not gone[k]:
                parts.append(b[k:e].decode("utf-8", "ignore"))
            k = e
        left = "".join(parts)
        if left.strip() or not any(gone):
            out[d] = left
    return out


def test_pipeline(spark, tmp_path):
    draw = random.Random(11)
    word = {"en": "the of and with thing ing there", "de": "der und nicht schön über lich keit"}
    say = lambda lang, n: " ".join(draw.choice(word[lang].split()) + draw.choice(["", draw.choice("abcdefgh")]) for _ in range(n))
    passages = [say("en", 60) for _ in range(3)]
    items = [(k, say("en", 15)) for k in range(4)]
    docs = []
    for d in range(80):
        lang = draw.choice(["en", "de"])
        text = say(lang, draw.randint(5, 90))
        if draw.random() < 0.3:
            text += " " + draw.choice(passages) + " " + say(lang, 10)
        if draw.random() < 0.1:
            text = items[draw.randrange(4)][1] + " " + say(lang, 20)
        docs.append((d, text, lang, "s", len(text)))
    docs += [(100 + k, docs[k][1] + draw.choice(["", " x"]), docs[k][2], "s", 1) for k in range(15)]
    docs += [(200, None, "en", None, None), (201, "123 %%% 456", "en", "s", 1), (202, "", None, "s", 0)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.fit(table)
    kept = [(d, t) for d, t, *_ in docs if (p := model.predict(t))[0] != "und" and p[1] >= 0.5]
    groups = jaccard_groups(kept, 5, 80, 100)
    kept = [(d, t) for d, t in kept if groups[d][1] == d]
    kept = cut(sorted(kept))
    bad = brute(kept.items(), items)
    kept = {d: t for d, t in kept.items() if not bad[d][4]}
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = {}
    for d, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    found = {r[0]: tuple(r[1:]) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == want and 30 < len(found) < 80
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.where("doc_id < 30"), folder).columns == table.columns, name


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    """Stages keep all columns of documents, whatever their names, and take empty tables and rows without an id."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, cls long, copy boolean, marks string, component_id string, id string"
    rows = [(k, f"the words of text number {k} with some more of them", "en", "s", 1, 5, True, "m", "c", "i") for k in range(12)]
    rows += [(20, rows[0][1], "en", "s", 1, 5, True, "m", "c", "i"), (None, rows[1][1], "en", None, None, None, None, None, None, None), (21, None, None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, "nothing of this occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, table, str(tmp_path))
        assert found.columns == table.columns, name
        assert found.where("doc_id = 3").first().marks == "m", name
        assert stage(spark, table.limit(0), str(tmp_path)).count() == 0, name
    assert {r.doc_id for r in corpus_pipeline.join_near_duplicates(spark, table, str(tmp_path)).collect()} == {*range(12), None, 21}
    assert corpus_pipeline.tokenize(spark, table.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
