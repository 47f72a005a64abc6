import hashlib
import random
import re

import numpy as np
import pytest

from citeweave.llm import decontaminate, langid, toxicity, warc, weak_label

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SF = "/root/testdata/sf0.01"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(docs, items):
    windows = {}
    for name, t in items:
        w = WORD.findall(low(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    out = {}
    for d, t in docs:
        w = WORD.findall(low(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    found |= names
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block", [2_000_000, 30])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
    draw = random.Random(7)
    words = lambda n: " ".join(draw.choice("alpha Beta gamma delta é1 x".split()) for _ in range(n))
    items = [(k, words(draw.choice([0, 1, 4, 12, 13, 30]))) for k in range(12)] + [(90, None), (91, "Alpha! beta")]
    docs = [(d, draw.choice([". ", " "]).join([words(draw.randint(0, 40)), items[draw.randrange(12)][1], words(draw.randint(0, 200))])) for d in range(60)] + [(100, None), (101, "")]
    table = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {r[0]: tuple(r[1:]) for r in decontaminate.judge(table, bench).collect()} == want
    clean = decontaminate.remove_contaminated(table, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, x in want.items() if not x[4]} and clean.columns == table.columns
    assert decontaminate.judge(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judge(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_decontamination_row_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
    one, two, three = (" ".join(f"{c}{k}" for k in range(20)) for c in "abc")
    bench = spark.createDataFrame([(1, one), (2, two), (None, three), (None, "lone")], "item_id long, text string")
    texts = [(5, one), (5, two + " x"), (5, "x y"), (None, one + " " + two), (None, "x"), (None, three), (6, one + " lone " + three), (None, None)]
    table = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(texts)], "doc_id long, text string, n long")
    digest = lambda *ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    want = [(5, 20, 20, 1, digest("1"), True), (5, 21, 20, 1, digest("2"), True), (5, 2, 0, 0, digest(), False), (None, 40, 40, 2, digest("1", "2"), True), (None, 1, 0, 0, digest(), False), (None, 20, 20, 1, digest(), True), (6, 41, 41, 2, digest("1"), True), (None, 0, 0, 0, digest(), False)]
    assert sorted(map(str, map(tuple, decontaminate.judge(table, bench).collect()))) == sorted(map(str, want))
    assert sorted(r.n for r in decontaminate.remove_contaminated(table, bench).collect()) == [2, 4, 7]


def test_words_that_weak_hashes_confuse(spark):
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    x, y = ("".join(c[b] for b in bits) for c in ("ab", "ba"))
    bench = spark.createDataFrame([(1, x)], "item_id long, text string")
    docs = [(1, f"a {x} b"), (2, f"a {y} b")]
    rows = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute(docs, [(1, x)])


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_longest_matches(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", block)
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(15))
    bench = spark.createDataFrame([("p", one), ("q", two), ("r", "lone")], "item_id string, text string")
    texts = [(1, f"x {one} y lone"), (2, " ".join(one.split()[5:25]) + " z " + two), (3, " ".join(one.split()[:12])), (4, None)]
    rows = decontaminate.find_matches(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {r.doc_id: sorted((m.at, m.words, m.item) for m in r.matches) for r in rows} == {1: [(1, 40, "p"), (42, 1, "r")], 2: [(0, 20, "p"), (21, 15, "q")], 3: [], 4: []}


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (None, "the of", "en")], "doc_id long, text string, lang string")
    assert sorted((str(r.doc_id), r.lang_pred == "und") for r in langid.predict(odd, model).collect()) == [("1", True), ("2", True), ("3", True), ("None", False)]
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(odd.limit(0))).collect()} == {"und"}
    assert langid.keep_identified(odd, model).columns == odd.columns


@pytest.mark.parametrize("text", ["🙂", "🙂🙂 !! 🎉", "🙂 123", "𝟙𝟚𝟛 🀄", "\U0010ffff"])
def test_high_code_points_without_letters_are_no_language(text):
    assert not len(langid.gram_counts(text)[0])
    assert [x.tolist() for x in langid.gram_counts(f"the{text}of")] == [x.tolist() for x in langid.gram_counts("the of")]


def test_high_letters_stay():
    assert len(langid.gram_counts("𐌰𐌱")[0]) and len(langid.gram_counts("𠀀")[0])


def test_labels_meet_texts_either_way(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    sent = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "MOST_SENT", 3)
    joined = toxicity.fit(docs, labels)
    assert (sent.feature == joined.feature).all() and np.allclose(np.sort(sent.weights), np.sort(joined.weights), atol=1e-6)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = toxicity.severity(docs, model).withColumnRenamed("toxic", "found").join(labels, "doc_id").collect()
    found = [r for r in rows if r.found]
    assert len([r for r in found if r.toxic]) / len(found) > 0.9
    assert len([r for r in found if r.toxic]) / len([r for r in rows if r.toxic]) > 0.75
    none = toxicity.fit(docs.limit(0), labels)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert toxicity.severity(odd, none).where("toxic").count() == 0 and toxicity.severity(odd, model).count() == 2


def test_toxicity_of_documents_it_was_not_fitted_on(spark):
    """Fitted on the labels of four of five documents, judged on the fifth; brute force over the same features gives the same scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.where("doc_id % 5 <> 0"))
    rows = toxicity.severity(docs, model).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    found, toxic = [r for r in rows if r.found], [r for r in rows if r.toxic]
    assert len(toxic) > 20 and sum(r.found for r in toxic) / len(toxic) > 0.75 and sum(1 for r in found if r.toxic) / max(1, len(found)) > 0.85
    text = docs.where("doc_id = 5").first().text
    words = {w for w in WORD.findall(low(text))}
    hashes = {w: decontaminate.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), toxicity.FEATURE_BASE)[0][0] for w in words}
    features = {int(model.feature[int(h >> np.uint64(64 - toxicity.BUCKETS_LOG2))]) for h in hashes.values()} - {-1}
    score = sum(model.weights[k] for k in features)
    (row,) = toxicity.severity(docs.where("doc_id = 5"), model).collect()
    assert abs(row.expected_severity - toxicity.sigmoid(score - model.thresholds).sum()) < 1e-9


def test_odd_tables_of_models(spark):
    """Clashing columns, repeated rows, null ids and very long texts, for each of the three models."""
    docs = [(k, f"plain words number {k % 7} of text. " * 3, "en" if k % 2 else "de") for k in range(40)] + [(k, f"vile nasty words {k % 5} of text. " * 3, "de") for k in range(40, 60)]
    docs += [(3, docs[3][1], "en"), (None, "plain words", "en"), (70, None, "en"), (71, "", None), (72, "vile nasty " * 60_000, "de"), (73, "x" * 700_000, None)]
    table = spark.createDataFrame([(*d, 9, 9.0, True, "z", 1) for d in docs], "doc_id long, text string, lang string, severity int, score double, keep boolean, posterior string, toxic int")
    labels = spark.createDataFrame([(k, int(k >= 40)) for k in range(60)] + [(3, 0), (3, 1), (41, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    rows = toxicity.severity(table, model).collect()
    assert len(rows) == len(docs) and len({r.expected_severity for r in rows if r.doc_id == 3}) == 1
    of = {r.doc_id: r for r in rows}
    assert of[72].toxic and of[45].toxic and not of[5].toxic and of[70].expected_severity == of[71].expected_severity
    assert toxicity.severity(table.limit(0), model).count() == 0
    one_kind = toxicity.fit(table, labels.where("toxic = 0"))
    assert toxicity.severity(table, one_kind).where("toxic").count() == 0
    weak = weak_label.fit(table)
    rows = weak_label.score(table, weak).collect()
    assert len(rows) == len(docs) and len({(r.posterior, r.score, r.keep) for r in rows if r.doc_id == 3}) == 1
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in rows) and all((r.score, r.keep) == (0.0, False) for r in rows if r.doc_id in (70, 71))
    assert weak_label.score(table.limit(0), weak).count() == 0
    tongue = langid.fit(table)
    rows = langid.predict(table, tongue).collect()
    assert len(rows) == len(docs) and len({(r.lang_pred, r.score) for r in rows if r.doc_id == 3}) == 1
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {70, 71} and all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert langid.predict(table.limit(0), tongue).count() == 0 and langid.keep_identified(table, tongue).columns == table.columns


def test_ties_between_languages_go_by_the_alphabet(spark):
    docs = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string")
    model = langid.Model(["a", "b"], np.ones(langid.BUCKETS), np.zeros((langid.BUCKETS, 2), np.float32), 1.0)
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("a", 0.5)}


def test_ordinal_thresholds_share_weights():
    rng = np.random.default_rng(2)
    rows = [rng.choice(6, rng.integers(0, 5), replace=False) for _ in range(600)]
    grades = np.array([min(3, sum(x < 3 for x in r)) for r in rows])
    weights, thresholds = toxicity.fit_ordinal(rows, grades, 6, 4)
    assert weights[:3].min() > weights[3:].max() + 1 and (np.diff(thresholds) > 0).all()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = weak_label.fit(docs)
    rows = weak_label.score(docs, model).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.keep for r in good]) > 0.98 and np.mean([not r.keep for r in bad]) > 0.8
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.keep for r in weak_label.score(odd, model).collect()] == [False, False]
    assert weak_label.score(odd, weak_label.fit(odd.limit(0))).count() == 2


def test_labellers_by_expectation_maximisation():
    rng = np.random.default_rng(3)
    y = rng.random(20000) < 0.8
    patterns = np.full((20000, weak_label.LABELLERS), 2)
    for k in range(4):
        patterns[:, k] = np.where(~y & (rng.random(20000) < 0.6), 0, 2)
    patterns[:, 8] = np.where(y & (rng.random(20000) < 0.7), 1, 2)
    grid, counts = np.unique(patterns, axis=0, return_counts=True)
    model = weak_label.fit_labels(grid, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.08 and ((model.posterior(patterns) > 0.5) == y).mean() > 0.95


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    path = f"file://{tmp_path}"
    big = "y" * (17 << 20)
    pages = [(1, "http://www.b.org/x y", "a" * 200), (2, "http://a.b.org:8080/q?z=1\r\n", "a" * 200), (3, None, None), (4, "x", "é" * 60), (5, "http://b.org/x", "small"), (6, "u", "small"), (None, "n", "a" * 200), (8, "http://b.org/big", big), (9, "http://b.org/zero", "\0" * 500), (10, "", ""), (11, "http://[bad", "é")]
    pages += [(20 + k, "http://b.org/hot", f"{k}" * 150) for k in range(9)]
    table = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int")
    warc.write_archives(table, f"{path}/records")
    warc.write_index(spark, f"{path}/records", f"{path}/index")
    every = warc.captures_between(spark, f"{path}/index")
    rows = {r.page_id: r for r in warc.read_captures(spark, f"{path}/records", every).collect()}
    assert len(rows) == len(pages) and rows[2].refers_to == 1 and rows[2].record_type == "revisit" and rows[6].record_type == "response" and rows[None].record_type == "response"
    for i, _, html in pages:
        raw = (html or "").encode()
        assert rows[i].payload_bytes == len(raw) and rows[i].payload_digest == hashlib.sha256(raw).hexdigest()
    asked = warc.lookup_keys(spark, f"{path}/index", warc.page_keys(table.unionByName(table)))
    assert {r.page_id: r for r in warc.read_captures(spark, f"{path}/records", asked).collect()} == rows and asked.count() == len(pages)
    for url in {u for _, u, _ in pages if u}:
        found = warc.lookup(spark, f"{path}/index", url)
        key = warc.lookup_key(url)
        assert {r.page_id for r in found.collect()} == {i for i, u, _ in pages if warc.lookup_key(u) == key}
    (hit,) = warc.read_captures(spark, f"{path}/records", warc.lookup(spark, f"{path}/index", "http://b.org/big")).collect()
    assert hit.payload == big.encode()
    assert warc.lookup(spark, f"{path}/index", "http://nowhere.org/").count() == 0
    between = warc.captures_between(spark, f"{path}/index", "org,b)/big", "org,b)/x")
    assert {r.page_id for r in between.collect()} == {5, 8, *range(20, 29)}
    assert warc.archived(table.limit(0)).count() == 0
    assert warc.url_key("http://www.Example.org:80/a?b") == "org,example:80)/a?b"


def test_repeated_pages(spark):
    body = "b" * 120
    pages = [(1, "u", body), (1, "u", body), (2, "u", body), (2, "v", "c" * 200), (None, "u", body), (None, None, body), (3, "u", "b" * 99), (4, "u", "b" * 99)]
    rows = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in rows) == sorted([("1", 120, "response", "None")] * 2 + [("2", 120, "revisit", "1"), ("2", 200, "response", "None"), ("None", 120, "response", "None"), ("None", 120, "response", "None"), ("3", 99, "response", "None"), ("4", 99, "response", "None")])


def test_a_lookup_reads_few_bytes(tmp_path, monkeypatch):
    """A key is found by the ranges of one or two blocks, not by the index file as a whole."""
    blocks = [[f"k{n:05d} {n} f 0 1" for n in range(a, a + 50)] for a in range(0, 5000, 50)]
    data, entries = b"", []
    for lines in blocks:
        member = warc.gzip_member("\n".join(lines).encode())
        entries.append((lines[0][:6], lines[-1][:6], "part", len(data), len(member)))
        data += member
    (tmp_path / "part").write_bytes(data)
    read, real = [], warc.read_ranges
    monkeypatch.setattr(warc, "read_ranges", lambda folder, ranges: real(folder, [read.append(r) or r for r in ranges]))
    keys = ["k00007", "k02500", "k02501", "k09999"]
    assert [c[1] for c in warc.search_blocks(entries, str(tmp_path), keys)] == [7, 2500, 2501]
    assert len(read) == 2 and sum(r[2] for r in read) < len(data) / 20
