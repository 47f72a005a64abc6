import hashlib

from pyspark.sql import functions as F

from citeweave.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("v")).first()[0]


def test_tokens_and_jaccard(spark):
    tokens = lambda t: set(one(spark, T.content_tokens(F.col("t")), t=t))
    assert tokens("firm-123 obligation") == {"firm", "obligation"}
    assert tokens("the and or of") == set()
    jac = T.jaccard(T.content_tokens(F.col("a")), T.content_tokens(F.col("b")))
    assert one(spark, jac, a="", b="") == 0.0
    assert one(spark, jac, a="capital must hold", b="capital must hold") == 1.0


def test_cues(spark):
    hit = lambda kind, t: one(spark, T.cue(kind, F.col("t")), t=t)
    assert hit("definition", "this means the arrangement") and not hit("definition", "must hold adequate capital")
    assert hit("duration", "within 30 days")
    assert hit("threshold", "at least 8 percent")
    assert hit("exception", "Unless stated") and hit("exception", "Subject to this")


def test_leakage(spark):
    kinds = lambda q, r=None: one(spark, T.leakage_kinds(T.leakages(F.col("q"), F.col("r"))), q=q, r=r)
    assert kinds("Under Rule 3.2.1 what") == ["rule_ref"]
    assert kinds("see rule 3.2 now") == ["rule_ref"]
    for code in ("GEN 2.1.3", "COBS 11.2.1", "PRIN 2.1"):
        assert kinds(f"under {code} who") == ["corpus_code"]
    for clean in ("a general rule", "part of it", "28 April 2026", "3.5%", "£12.50 million", "GBP 3.5", "USD 1.5", "EUR 2.5", "AED 1.2", ""):
        assert kinds(clean) == []
    assert kinds("do the senior manager conduct rules apply", "Senior Manager Conduct Rules.") == ["reference_text"]


def test_titles_and_quality(spark):
    assert one(spark, T.is_title_like(F.col("t")), t="Definitions")
    assert one(spark, T.is_title_like(F.col("t")), t="")
    assert not one(spark, T.is_title_like(F.col("t")), t="A firm must notify the regulator in writing, within thirty days of the event, unless it is exempt; the notice must be kept.")
    reason = lambda t: one(spark, T.quality_reason(F.col("t")), t=t)
    assert reason(None) == "empty_or_null" and reason("short") == "too_short" and reason("x" * 12001) == "too_long"
    assert reason("a" * 50 + "....") == "contains_dot_leader" and reason("1" * 60) == "low_alpha_ratio" and reason("word " * 20) == "ok"


def test_scores_normalise_a_text_once(spark):
    def passes(column):
        rows = spark.createDataFrame([("Part 1 x",)], "t string").select(column.alias("v"))
        return rows._jdf.queryExecution().optimizedPlan().toString().count("(?U)")

    t = F.col("t")
    assert passes(T.title_score(t)) == 1 and passes(T.quality_reason(t)) == 1
    assert passes(T.rule_signal_score(t)) == 2 and passes(T.row_signals(t)) == 2  # the words of short texts once more
    assert one(spark, T.title_score(t), t="Part 1 of Scope") == 7 and one(spark, T.title_score(t), t=None) == 10
    assert one(spark, T.rule_signal_score(t), t="A firm must not act; it shall keep records") == 16 and one(spark, T.rule_signal_score(t), t=None) == -999


def test_navigation_needs_back_reference(spark):
    nav = lambda t: one(spark, T.looks_like_navigation(F.col("t")), t=t)
    assert nav("about some word some word") and nav("Contents of this") and nav("Home | Rules") and nav(None)
    assert not nav("a firm must do this thing and also that other thing.")


def test_spans_clauses_and_hooks(spark):
    clause = one(spark, T.core_clause(F.col("t")), t="Some words here. Each firm in scope must notify us. More.")
    assert clause["text"] == "Each firm in scope must notify us" and clause["start"] == 17
    assert one(spark, T.semantic_hook(F.col("t")), t="capital buffers of Rule 3.2.1, (see Part 2)") == "capital buffers of"
    assert one(spark, T.sentence_count(F.col("t")), t="One. Two! Three") == 3


def test_lcs_and_urls(spark):
    lcs = T.lcs_length(T.ascii_tokens(F.col("a")), T.ascii_tokens(F.col("b")))
    assert one(spark, lcs, a="a b c d", b="b x d") == 2 and one(spark, lcs, a="", b="b") == 0
    assert one(spark, T.normal_url(F.col("u")), u="HTTP://A.org/B/?q#f") == "http://a.org/B"
    assert one(spark, T.undated_url(F.col("u")), u="http://a.org/x/01-02-2020") == "http://a.org/x"
    assert one(spark, T.anchor_key(F.col("u")), u="Sec%2D1+b") == "sec1b"


def test_uid_matches_hashlib(spark):
    assert one(spark, T.uid(F.col("a"), F.col("b")), a="x", b=None) == hashlib.sha256(b"x||").hexdigest()[:16]


def test_question_and_flags(spark):
    assert one(spark, T.question_key(F.col("q")), q="What, is  it?") == "what is it"
    assert one(spark, T.question_type(F.col("q")), q="Which one") == "which" and one(spark, T.question_type(F.col("q")), q="Is it") == "other"
    assert one(spark, T.tri_state(F.col("q")), q=" Yes ") is True and one(spark, T.tri_state(F.col("q")), q="maybe") is None
