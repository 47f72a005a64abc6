import collections
import hashlib
import random
import re

import numpy as np
import pytest

from citeweave.llm import components, itq_dedup, jaccard_join, suffix_dedup

DRAW = random.Random(5)
WORD = re.compile("[^\x20\x09-\x0d]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def linked_groups(names, links):
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(200, 260)] + [(5000, 5000), (7, 8), (8, 7)]
    found, _ = components.components(spark.createDataFrame(links, "a long, b long"))
    want = linked_groups({x for p in links if p[0] != p[1] for x in p}, [p for p in links if p[0] != p[1]])
    assert {r.node: r.component for r in found.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long"))[0].count() == 0


def test_divide_skip():
    for _ in range(300):
        lists = [sorted(DRAW.sample(range(30), DRAW.randint(0, 20))) for _ in range(DRAW.randint(1, 8))]
        least = DRAW.randint(1, len(lists))
        count = collections.Counter(x for items in lists for x in items)
        want = {k: v for k, v in count.items() if v >= least}
        assert jaccard_join.divide_skip(lists, least) == want and jaccard_join.divide_skip(lists, least, DRAW.randint(0, 5)) == want


def test_sketches_never_rule_out_links():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * rng.uniform(0.8, 1))], rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64)]))
        if len(y) and jaccard_join.linked(x, y, 8, 10):
            assert jaccard_join.may_link(jaccard_join.sketch_of(x), len(x), jaccard_join.sketch_of(y), len(y), 8, 10)


def jaccard_groups(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = WORD.findall(low(t or ""))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    groups = linked_groups(sets, links)
    return {d: (len(sets[d]), groups[d]) for d in sets}


def test_similar(spark):
    base = [[DRAW.choice("abcdefghijklmnop") for _ in range(DRAW.randint(1, 60))] for _ in range(12)]
    docs = []
    for d in range(150):
        w = list(DRAW.choice(base))
        for _ in range(DRAW.randint(0, 3)):
            w[DRAW.randrange(len(w))] = DRAW.choice("qrst")
        docs.append((d, DRAW.choice([" ", "\n"]).join(w)))
    docs += [(300, None), (301, ""), (302, " \t"), (303, "A b"), (304, "a B"), (305, "long " * 3000)]
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, component_id int")
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar(table, size=k, num=num, den=den).collect()}
        assert found == jaccard_groups(docs, k, num, den)
    assert jaccard_join.similar(table.limit(0)).count() == 0
    twice = jaccard_join.similar(table.unionByName(table)).count()
    assert twice == 2 * len(docs)
    kept = jaccard_join.keep_one_each(table, size=3, num=90, den=100)
    want = {d for d, (_, g) in jaccard_groups(docs, 3, 90, 100).items() if d == g}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == table.columns


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    docs = [(d, f"one two three four five six {d // 2}") for d in range(40)] + [(None, "one two three four five six 3"), (1, "a row that repeats an id")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large table of dropped ids, as Spark judges it
    try:
        sent = jaccard_join.keep_one_each(table, size=3, num=99, den=100)
        plan = sent._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        monkeypatch.setattr(jaccard_join, "MOST_SENT", 0)
        joined = jaccard_join.keep_one_each(table, size=3, num=99, den=100)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text)
        assert sorted(sent.collect(), key=key) == sorted(joined.collect(), key=key)
        assert {r.doc_id for r in sent.collect()} == {None, *range(0, 40, 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "GROUP", 5)
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    words = [f"w{k}" for k in range(40)]
    docs = [(d, " ".join([*words, f"x{d}"])) for d in range(60)] + [(100, " ".join(words[:20]))]
    # one list of many classes in several components
    docs += [(200 + d, " ".join([*words[:3], *(f"{d % 7}y{k}" for k in range(4)), *(["z"] * (d % 3))])) for d in range(90)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for small, part in ((32, 4096), (4, 16), (1, 4)):
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "PART", part)
        for num in (60, 80):
            found = {r.doc_id: r.component_id for r in jaccard_join.similar(table, size=3, num=num, den=100).collect()}
            assert found == {d: g for d, (_, g) in jaccard_groups(docs, 3, num, 100).items()}


def test_search_finds_what_comparison_finds():
    rng = np.random.default_rng(2)
    for _ in range(100):
        pool = np.unique(rng.integers(0, 1 << 62, 60).astype(np.uint64))
        sets = [np.sort(rng.choice(pool, rng.integers(1, len(pool)), replace=False)) for _ in range(12)]
        index = jaccard_join.Inverted(sets)
        for query in sets:
            for num in (30, 70, 90, 100):
                assert sorted(index.similar(query, num, 100)) == [k for k, x in enumerate(sets) if jaccard_join.linked(query, x, num, 100)]


def test_every_link_is_found_by_the_search(monkeypatch):
    """The Arrow function of the registered query takes its links from divide_skip alone."""
    import pyarrow as pa

    calls, real = [], jaccard_join.divide_skip
    monkeypatch.setattr(jaccard_join, "divide_skip", lambda lists, least, long=None: calls.append(len(lists)) or real(lists, least, long))
    sets = [np.arange(k, 50 + k % 3, dtype=np.uint64) for k in range(8)]
    heads = {0: [0, 2], 1: [1, 3]}
    rows = [(7, piece, 0, kind, c, list(heads[piece]) if kind else None, sets[c].tobytes()) for piece in (0, 1) for kind, c in [*((0, h) for h in heads[piece]), *((1, c) for c in range(8))]]
    kinds = [("g", pa.int64()), ("p", pa.int32()), ("s", pa.int32()), ("k", pa.int32()), ("c", pa.int64()), ("h", pa.list_(pa.int64())), ("i", pa.binary())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])
    found = [(r["a"], r["b"]) for cut in (4, 9, 13) for b in jaccard_join._search(80, 100)([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
    want = [(h, c) for h in (0, 2, 1, 3) for c in range(8) if h != c and jaccard_join.linked(sets[h], sets[c], 80, 100)]
    assert sorted(found) == sorted(want * 3) and calls == [len(sets[c]) for c in range(8)] * 6


def test_members_meet_their_heads_in_one_place(spark):
    pairs = [(1, k) for k in range(10, 3000)] + [(k, 5000) for k in range(10, 3000, 2)] + [(8000, 8001), (8001, 8002)]
    rows = jaccard_join.grouped(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((min(r.h, r.b), max(r.h, r.b)) for r in rows) == sorted(pairs)
    assert {r.g for r in rows if r.b < 3000} == {1} and {r.h for r in rows if r.b < 3000} == {1, 5000}
    assert len({r.salt for r in rows if r.g == 1}) > 1 and {(r.g, r.h, r.b) for r in rows if r.h > 8000} == {(8001, 8001, 8000), (8001, 8001, 8002)}


def test_texts_that_weak_hashes_confuse(spark):
    docs = []
    for n in (1024, 2048, 4096):
        bits = [bin(k).count("1") & 1 for k in range(n)]
        docs += [(n, "".join("ab"[b] for b in bits)), (n + 1, "".join("ba"[b] for b in bits)), (n + 2, "".join("ab"[b] for b in bits))]
    found = {r.doc_id: r.component_id for r in jaccard_join.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {d: d - (d % 1024 == 2) * 2 for d, _ in docs}


def test_names_shared_by_unequal_sets(spark, monkeypatch):
    real = jaccard_join.names_of
    docs = [(d, f"{w} b c d e") for d, w in enumerate("xyxzy")] + [(9, "other words here now")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(jaccard_join, "names_of", lambda grams: (7, real(grams)[1]))
    found = {r.doc_id: (r.class_id, r.component_id) for r in jaccard_join.similar(table, size=3).collect()}
    assert found == {0: (0, 0), 1: (1, 1), 2: (0, 0), 3: (3, 3), 4: (1, 1), 9: (9, 9)}


def test_rows_without_id(spark):
    same = "one two three four five six"
    docs = [(None, same), (4, same), (3, same), (None, "lone text is here"), (None, None), (8, None)]
    rows = jaccard_join.similar(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == sorted([("None", 4, "3"), ("4", 4, "3"), ("3", 4, "3"), ("None", 2, "None"), ("None", 0, "None"), ("8", 0, "8")])


def test_chains_through_rows_without_id(spark):
    """A row without an id may be all that joins two others, whichever of them the drawn base makes the query."""
    docs = []
    for c in range(12):
        words = [f"c{c}w{k}" for k in range(120)]
        one, between, two = words[:102], words[1:103], words[3:105]
        docs += [(10 * c + 1, one), (10 * c + 2, two), (10 * c + 5, words[20:60]), (None, words[21:61]), (None, words[22:62]), (10 * c + 6, words[23:63])] + [(None, between)] * 3
    docs = [(d, " ".join(w)) for d, w in docs]
    DRAW.shuffle(docs)
    rows = jaccard_join.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size=3, num=94, den=100).collect()
    sets = [frozenset(zip(t.split(), t.split()[1:], t.split()[2:], strict=False)) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(len(docs)):
            if 100 * len(sets[a] & sets[b]) >= 94 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((d for (d, _), h in zip(docs, group, strict=True) if h == g and d is not None), default=None) for g in group}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == sorted((str(d), str(least[g])) for (d, _), g in zip(docs, group, strict=True))
    assert all(least[group[k]] == d - 1 for k, (d, _) in enumerate(docs) if d is not None and d % 10 == 2)


def test_deep_shallow_sort():
    for t in range(150):
        width, n = DRAW.choice([5, 8, 12, 40, 100]), DRAW.randint(1, 60)
        base = [bytes(DRAW.choice(b"ab\x00\xff") for _ in range(width)) for _ in range(3)]
        rows = []
        for _ in range(n):
            b = bytearray(DRAW.choice(base))
            if DRAW.random() < 0.7:
                b[DRAW.randrange(width)] = DRAW.choice(b"abc\x00")
            rows.append(bytes(b))
        order, common = suffix_dedup.deep_shallow_sort(np.frombuffer(b"".join(rows), np.uint8).reshape(n, width), DRAW.choice([8, 16, 32]))
        assert list(order) == sorted(range(n), key=lambda k: (rows[k], k))
        for i in range(1, n):
            a, b = rows[order[i - 1]], rows[order[i]]
            assert common[i] == next((k for k in range(width) if a[k] != b[k]), width)


def removed(docs):
    first, out = {}, {}
    for d, b in docs:
        for i in range(len(b) - 99):
            first.setdefault(b[i : i + 100], (d, i))
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] != (d, i):
                gone[i : i + 100] = b"\1" * 100
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, r in zip(b, gone, strict=True) if not r)
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_long_texts_have_the_same_anchors(monkeypatch):
    draw = np.random.default_rng(6)
    data = draw.integers(97, 101, 9000).astype(np.uint8)
    data[5000:6000] = data[1000:2000]

    def of_each_string():
        found = suffix_dedup.anchors(data, np.array([0, len(data)]))
        out = {}
        for place, first, last in zip(found["place"], found["first"], found["last"], strict=True):
            out |= {start: place for start in range(first, last + 1)}
        return out

    whole = of_each_string()
    assert len(whole) == len(data) - 99
    monkeypatch.setattr(suffix_dedup, "_PLACE_BITS", 10)
    pieces = of_each_string()
    assert len(pieces) == len(whole)
    for start in range(1000, 1900):  # equal strings have equal anchors wherever pieces end
        assert pieces[start] - start == pieces[start + 4000] - start - 4000


def test_one_point_of_each_hash_goes_to_its_shard():
    rows = np.zeros(7, suffix_dedup._POINT)
    rows["doc"], rows["place"] = [3, 1, 2, 2, 9, 9, 4], [5, 5, 5, 5, 1, 1, 0]
    hashes = np.array([7, 7, 7, 7, 8, 8, 6], np.uint64)
    one, several = suffix_dedup.known_twice(rows, hashes)
    assert sorted(hashes[one]) == [6, 7, 8] and sorted(zip(rows["doc"][several], rows["place"][several], strict=True)) == [(1, 5), (2, 5), (3, 5)]


def test_rows_without_id_and_rows_left(spark):
    passage = "".join(DRAW.choice("abcdefgh") for _ in range(250))
    docs = [(None, passage), (5, passage), (7, "start " + passage), (8, "x" + passage[:120]), (9, passage), (None, None), (10, "short")]
    table = spark.createDataFrame([(d, t, "e") for d, t in docs], "doc_id long, text string, extra string")
    want = removed(sorted((d, t.encode()) for d, t in docs if d is not None))
    rows = suffix_dedup.digests(table).collect()
    assert {r[0]: tuple(r[1:]) for r in rows if r[0] is not None} == want
    assert sorted((r[1], r[2]) for r in rows if r[0] is None) == [(0, 0), (250, 0)]
    left = suffix_dedup.remove_repeats(table).collect()
    assert sorted((str(r.doc_id), str(r.text), r.extra) for r in left) == sorted([("None", passage, "e"), ("5", passage, "e"), ("7", "start ", "e"), ("8", "x", "e"), ("None", "None", "e"), ("10", "short", "e")])


def test_repeated_strings(spark):
    passages = ["".join(DRAW.choice("abcdeé ") for _ in range(DRAW.randint(90, 400))) for _ in range(6)] + ["x" * 300, "ab" * 200]
    docs = []
    for d in range(60):
        t = ""
        for _ in range(DRAW.randint(0, 5)):
            a = DRAW.randint(0, 60)
            t += DRAW.choice(passages)[a : a + DRAW.randint(50, 400)] if DRAW.random() < 0.6 else "".join(DRAW.choice("fghijk") for _ in range(DRAW.randint(0, 150)))
        docs.append((d, t))
    docs += [(200 + k, docs[k][1]) for k in range(20)] + [(300, None), (301, "")]
    table = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, n_bytes string")
    want = removed(sorted((d, (t or "").encode()) for d, t in docs))
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(table).collect()} == want
    twice = suffix_dedup.digests(table.unionByName(table)).collect()
    assert len(twice) == 2 * len(docs) and all(tuple(r[1:]) == want[r[0]] for r in twice)
    assert suffix_dedup.digests(table.limit(0)).count() == 0
    left = suffix_dedup.remove_repeats(table.where("text is not null"))
    assert left.columns == table.columns and {r.doc_id for r in left.collect()} <= {d for d, _ in docs}


def test_repeated_ids_keep_their_own_columns(spark):
    rows = [(1, "hello", "en", "s1"), (1, "bonjour", "fr", "s2"), (1, None, "de", "s3"), (2, "hello", "en", "s4"), (1, "bonjour", "fr", "s2")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for parts in (1, 3):
        left = suffix_dedup.remove_repeats(table.repartition(parts)).collect()
        assert sorted((r.doc_id, r.text or "", r.lang, r.source) for r in left) == sorted((d, t or "", x, s) for d, t, x, s in rows)


def vector_links(rows):
    good = [(v, np.array(x, float), y) for v, x, y in rows if v is not None and y is not None and x is not None and None not in x and np.isfinite(x).all() and np.any(x)]
    good = [(v, x / np.abs(x).max(), y) for v, x, y in good]
    return [(a, b) for k, (a, x, s) in enumerate(good) for b, y, t in good[:k] if s == t and len(x) == len(y) and x @ y >= 0.98 * np.linalg.norm(x) * np.linalg.norm(y)]


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for v in range(400):
        x = rng.standard_normal(16) if v < 150 else np.array(rows[v - 150][1]) + rng.standard_normal(16) * 0.05
        rows.append((v, x.astype(np.float32).tolist(), v % 150 % 2))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], None), (502, None, 0), (503, [0.0] * 16, 0), (504, [float("nan")] * 16, 0), (505, [1.0, None], 0), (506, [1.0, 2.0], 0), (507, [1.0, 2.0], 0), (508, [], 0), (509, [float("inf")] * 16, 1)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, n_links string")
    links = vector_links(rows)
    degree = collections.Counter(x for p in links for x in p)
    groups = linked_groups([r[0] for r in rows], links)
    for block in (512, 7):
        monkeypatch.setattr(itq_dedup, "BLOCK", block)
        found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq_dedup.near_duplicates(table).collect()}
        assert sum(n for n, _, _ in found.values()) >= 0.9 * 2 * len(links)
        for v, (n, component, kept) in found.items():
            assert n <= degree[v] and component >= groups[v] and kept == (v == component)
        assert found[506][:2] == (1, 506) and found[507][1] == 506 and all(found[v][0] == 0 for v in (501, 502, 503, 504, 505, 508, 509))
    assert itq_dedup.near_duplicates(table.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, rows[0][1], 0), (None, rows[0][1], 0), (1, rows[0][1], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in itq_dedup.near_duplicates(nobody).collect()) == [("1", 0, True), ("None", 0, False), ("None", 0, False)]


def test_near_vectors_in_double_precision(spark):
    """Doubles beyond floats, a difference floats can't hold, many lengths and repeated rows."""
    angle = np.arccos(0.98)
    pair = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    rows = [(1, [1.0, 0.0, 0.0], "x"), (2, pair(angle - 1e-10), "x"), (3, pair(angle + 1e-10), "y"), (4, [1.0, 0.0, 0.0], "y")]
    rows += [(10, [1e300, 1e300], "x"), (11, [1e300, 1.01e300], "x"), (12, [1e-300, 1e-300], "x")]
    rows += [(100 + k, [1.0] * (k + 4), "x") for k in range(40)] + [(200 + k, [1.0] * (k + 4), "x") for k in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in itq_dedup.near_duplicates(table).collect()}
    assert found[1] == (1, 1) and found[2] == (1, 1) and found[3] == (0, 3) and found[4] == (0, 4)
    assert [found[k] for k in (10, 11, 12)] == [(2, 10)] * 3
    assert all(found[100 + k] == (1, 100 + k) and found[200 + k] == (1, 100 + k) for k in range(40))
    twice = itq_dedup.near_duplicates(table.unionByName(table)).collect()
    assert len(twice) == 2 * len(rows) and {r.n_links for r in twice if r.vec_id in (1, 2)} == {3}


def planted(dimension, spectrum, offset, seed, n=1500):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dimension)) * spectrum + offset
    x /= np.linalg.norm(x, axis=1)[:, None]
    way = rng.standard_normal((300, dimension)) * spectrum
    way -= (way * x[:300]).sum(1)[:, None] * x[:300]
    way /= np.linalg.norm(way, axis=1)[:, None]
    cosine = rng.uniform(0.9801, 0.99, 300)[:, None]
    return np.vstack([x, cosine * x[:300] + np.sqrt(1 - cosine**2) * way])


def test_recall_and_buckets_of_many_kinds_of_data():
    one = np.ones(64)
    for name, (spectrum, offset) in {"isotropic": (one, 0), "decaying": (1 / np.arange(1, 65) ** 0.5, 0), "common offset": (one, 3 * one), "large offset": (one, 10 * np.eye(64)[0])}.items():
        x = planted(64, spectrum, offset, 3)
        plan = itq_dedup.Plan(x[:1500], 1800, 0.98, 0.98, 7)
        codes = plan.codes(x)
        met = (codes[:300] == codes[1500:]).any(1).mean()
        largest = max(np.bincount(np.unique(codes[:1500, t], return_inverse=True)[1]).max() for t in range(plan.tables)) / 1500
        assert met >= 0.93 and largest <= 0.2, (name, met, largest, plan.width, plan.tables)


def test_a_length_is_planned_by_itself():
    rng = np.random.default_rng(1)
    x = itq_dedup.unit(rng.standard_normal((2000, 64)))
    for largest in (600, 10_000, 10_000_000):
        plan = itq_dedup.Plan(x, largest, 0.98, 0.98, 7)
        assert plan.recall >= 0.98 and plan.width >= min(16, np.log2(largest)) - 2
    # codes decide on small labels too, down to labels that one bucket of the usual size holds
    for largest, width in ((20, 0), (60, 1), (512, 4)):
        plan = itq_dedup.Plan(x, largest, 0.98, 0.98, 7)
        assert plan.recall >= 0.98 and plan.width == width and plan.codes(x).shape == (2000, plan.tables)


def test_a_plan_that_falls_short_compares_all_pairs(monkeypatch):
    monkeypatch.setattr(itq_dedup, "MOST_TABLES", 1)
    monkeypatch.setattr(itq_dedup, "LEAST_RECALL", 0.999)
    x = itq_dedup.unit(np.random.default_rng(1).standard_normal((2000, 64)))
    plan = itq_dedup.Plan(x, 1000, 0.9, 0.9999, 7)
    assert (plan.width, plan.tables, plan.recall) == (0, 1, 1.0) and not plan.codes(x).any()


def test_recall_of_the_whole_query(spark):
    """Labels of 2,000 and more vectors with planted links, compared with all pairs."""
    rows, want = [], set()
    for label, (spectrum, offset) in enumerate([(np.ones(64), 0), (1 / np.arange(1, 65) ** 0.5, np.eye(64)[0])]):
        x = planted(64, spectrum, offset, label, n=2000)
        first = len(rows)
        rows += [(first + k, v.tolist(), label) for k, v in enumerate(x)]
        a, b = np.nonzero(np.triu(itq_dedup.unit(x) @ itq_dedup.unit(x).T >= 0.98, 1))
        want |= {(first + i, first + j) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    degree = collections.Counter(v for pair in want for v in pair)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    found = {r.vec_id: r.n_links for r in itq_dedup.near_duplicates(table).collect()}
    assert len(want) >= 600 and all(n <= degree[v] for v, n in found.items())
    assert sum(found.values()) >= 0.95 * 2 * len(want)
