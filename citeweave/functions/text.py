"""Text predicates, scores and normalisers as column expressions.

Everything here is built from Spark's own functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Word lists, patterns and thresholds that results depend on.
TITLE_STOPWORDS = (
    "the and of to in for on by with a an or as is are at from that its be this these those "
    "must shall under rule section chapter part article"
).split()
CONTENT_STOPWORDS = (
    "a an the and or of in to for on by with is are was were be been being it its that this these those at from "
    "as has have had not but if no so do does did will would may might shall should can could into out up than such "
    "any each all also which who whom when where how what more other their there they them then s re"
).split()
HEADING = r"(?i)^(definitions?|scope|interpretation|glossary|enforcement procedure|financial reports?)$"
RULE_PREFIX = r"(?i)^(part|chapter|section|rule)\s+\d+([.\-]\d+)*"
PLACEHOLDER = r"(?i)^(repealed|omitted|deleted|revoked|reserved|removed|\.\.\.|none|n/?a)$"
NAV_PREFIX = (
    r"(?i)^(?:parts?\b|legal instruments that change this (?:part|rule|chapter|section|article)\b|policy statements?\b"
    r"|supervisory statements?\b|statements? of policy\b|related links?\b|contents\b|table of contents\b"
    r"|next\b|previous\b|back\b|print\b|download\b)"
)
POLICY_ID = r"(?i)\bps\d{1,3}/\d{2}\b"
REPEATED_TAIL = r"(?i)\b(.+?)\s+\1\s*$"
MENU_SEPARATOR = "[|›»•·]"
GLOSSARY_TERM = r"(?i)\bglossary-term-[a-f0-9]{16,}\b"
OBLIGATIONS = ("must", "must not", "shall", "shall not", "is required to", "are required to", "required to", "may not", "prohibited", "shall ensure", "must ensure")
PROHIBITIONS = ("must not", "shall not", "may not", "prohibited")
MODALS = ("must", "shall")
REQUIREMENTS = ("is required to", "are required to", "required to")
DEFINITIONS = ("means", "refers to", "is defined as", "definition")
ACTIONS = ("ensure", "establish", "maintain", "implement", "comply", "notify", "report", "submit", "retain", "keep", "review", "document", "record", "monitor", "assess", "manage")
CUES = {
    "definition": r"(?i)\b(means|meaning|defined\s+as|definition\s+of|refers\s+to|shall\s+mean|is\s+defined|definition)\b",
    "duration": r"(?i)(?:\d+\s*(?:calendar\s+|business\s+)?(?:day|days|month|months|year|years|week|weeks|hour|hours)|within\s+\d+|not\s+later\s+than|no\s+later\s+than|deadline|before\s+the\s+(?:end|date|expiry))",
    "threshold": r"(?i)(?:\d+(?:\.\d+)?\s*(?:%|percent|per\s+cent)|\b(?:at\s+least|at\s+most|no\s+more\s+than|no\s+less\s+than|minimum|maximum|threshold|exceeds?|below|above|greater\s+than|less\s+than))",
    "exception": r"(?i)\b(unless|except|provided\s+that|subject\s+to|notwithstanding|other\s+than|conditional|condition|requirement)\b",
}
CITATION = r"(?i)\b(?:rule|section|part|chapter|appendix|schedule)\b|\bFSMR\b|\b\d+(?:\.\d+)+(?:\([^)]+\))*\b"
LEAKAGE = (
    ("rule_ref", r"(?i)\bRules?\s+\d+(?:\.\d+)+(?:\s*\(\w+\))*"),
    ("section_ref", r"(?i)\bSections?\s+\d+(?:\.\d+)*(?:\s*\(\w+\))?"),
    ("article_ref", r"(?i)\bArticles?\s+\d+(?:\.\d+)*(?:\s*\(\w+\))?"),
    ("paragraph_ref", r"(?i)\bparagraphs?\s*\(\d+\)|\bparagraphs?\s+\d+(?:\.\d+)*"),
    ("subsection_ref", r"(?i)\bsubsections?\s+\d+(?:\.\d+)*(?:\s*\(\w+\))?"),
    ("part_ref", r"\bParts?\s+\d+[A-Za-z]?\b"),
    ("chapter_ref", r"\bChapters?\s+\d+(?:\.\d+)*\b"),
    ("schedule_ref", r"\bSchedules?\s+\d+(?:\.\d+)*\b"),
    ("corpus_code", r"\b[A-Z]{2,6}\s+\d+\.\d+(?:\.\d+)*\b"),
)
CURRENCIES = "GBP USD EUR AED CHF JPY CAD AUD NZD SGD HKD SEK NOK DKK CNY INR BRL MXN".split()
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which")
CORE_CLAUSE = r"(?i)(?:^|[.]\s+)((?:[^.]{10,220}?)\b(?:must|shall|may|is\s+required\s+to|subject\s+to|provided\s+that)\b[^.]{0,220})(?:[.]|$)"
HOOK_TAIL = r"(?i)\s*\(?(?:see|per|under|subject to)\s+[^)]*\)?$"
HOOK_CITATION = r"(?i)(?:\b(?:rule|section|part|chapter|appendix|schedule)\b\s*[:\-]?\s*(?:\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)(?:\s*[a-z])?)|\bFSMR\b|\b\d+(?:\.\d+)+(?:\([^)]+\))*\b"
FREEFORM_CHARS = 220
TRUE_WORDS = ("yes", "y", "true", "1", "pass", "valid")
FALSE_WORDS = ("no", "n", "false", "0", "fail", "invalid")


def absent(c: Column) -> Column:
    """Null, empty or blank."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def once(c: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def normal(c: Column) -> Column:
    """White space collapsed and trimmed, invisible marks removed; null becomes empty."""
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), "[‎‏﻿]", "")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """White-space separated words; the empty text has none."""
    return F.filter(F.split(normal(c), " "), lambda w: w != "")


def content_tokens(c: Column) -> Column:
    """Distinct lower-case letter runs that are no stop words and longer than one letter."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*CONTENT_STOPWORDS) & (F.length(t) > 1)))


def ascii_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def any_phrase(c: Column, phrases) -> Column:
    """Whether a lower-cased, space-padded text holds one of the phrases as words."""
    return once(_padded(c), lambda padded: _holds(padded, phrases))


def _padded(c: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(c, F.lit(""))), F.lit(" "))


def _holds(padded: Column, phrases) -> Column:
    return reduce(Column.__or__, [padded.contains(f" {p} ") for p in phrases])


def letter_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.lit(1), F.length(c))


def dot_ratio(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(".")))) / F.greatest(F.lit(1), F.length(c))


def titlecase_ratio(c: Column) -> Column:
    return once(words(c), lambda tokens: _share(tokens, lambda t: t.rlike(r"^\p{Lu}[\p{Ll}\P{L}]*\p{Ll}[\p{Ll}\P{L}]*$")))


def _share(tokens: Column, test) -> Column:
    return F.size(F.filter(tokens, test)) / F.greatest(F.lit(1), F.size(tokens))


def title_score(c: Column) -> Column:
    """How much a text looks like a heading; empty text scores the most."""
    return once(normal(c), _title_score)


def _title_score(text: Column) -> Column:
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" ")))
    tokens = F.filter(F.split(text, " "), lambda w: w != "")
    capital = once(tokens, lambda ws: _share(ws, lambda t: t.rlike(r"^[A-Z][a-zA-Z0-9\-]*$")))
    stops = once(F.regexp_extract_all(text, F.lit("[a-zA-Z]+"), F.lit(0)), lambda ws: _share(ws, lambda t: F.lower(t).isin(*TITLE_STOPWORDS)))
    signals = [
        ((F.length(text) <= 80) & (spaces <= 12), 2),
        (~text.rlike("[.!?]$"), 1),
        (capital >= 0.40, 1),
        (stops <= 0.18, 1),
        (~text.rlike("[,;:]"), 1),
        (text.rlike(HEADING), 2),
        (text.rlike(RULE_PREFIX), 2),
    ]
    score = reduce(Column.__add__, [F.when(test, points).otherwise(0) for test, points in signals])
    return F.when(text == "", 10).otherwise(score)


def is_title_like(c: Column) -> Column:
    return title_score(c) >= 3


def quality_reason(c: Column, least: int = 40, most: int = 12_000, letters: float = 0.35, dots: float = 0.22) -> Column:
    """Why a passage fails the hard gate, ``ok`` if it doesn't; the first reason counts."""
    return once(normal(c), lambda text: _quality_reason(text, least, most, letters, dots))


def _quality_reason(text: Column, least: int, most: int, letters: float, dots: float) -> Column:
    bare = F.regexp_replace(text, r"^[ .]+|[ .]+$", "")
    return (
        F.when(text == "", "empty_or_null")
        .when(F.length(text) < least, "too_short")
        .when(F.length(text) > most, "too_long")
        .when((F.length(text) < 90) & bare.rlike(PLACEHOLDER), "keyword_placeholder")
        .when(text.rlike(r"\.{4,}"), "contains_dot_leader")
        .when(dot_ratio(text) > dots, "high_dot_density")
        .when(letter_ratio(text) < letters, "low_alpha_ratio")
        .otherwise("ok")
    )


def looks_like_navigation(c: Column, repeated_tail: bool = True) -> Column:
    """Signs of menus, index entries and captions; a penalty, not a filter."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"^[ \t\r\n\-–—|]+|[ \t\r\n\-–—|]+$", "")
    return once(bare, lambda text: _looks_like_navigation(text, repeated_tail))


def _looks_like_navigation(text: Column, repeated_tail: bool) -> Column:
    duty = any_phrase(text, OBLIGATIONS)
    size = F.length(text)
    tests = [
        text == "",
        text.rlike(NAV_PREFIX),
        (size < 240) & text.rlike(POLICY_ID) & ~duty,
        (size < 180) & text.rlike(MENU_SEPARATOR) & ~duty,
        (size < 240) & (titlecase_ratio(text) >= 0.65) & ~duty & ~text.rlike("[.;:]"),
    ]
    if repeated_tail:
        tests.append((size < 260) & ~duty & text.rlike(REPEATED_TAIL))
    return reduce(Column.__or__, tests)


def rule_signal_score(c: Column, repeated_tail: bool = True) -> Column:
    """How much a passage reads like a rule; -999 for empty text."""
    return once(normal(c), lambda text: _rule_signal_score(text, repeated_tail))


def _rule_signal_score(text: Column, repeated_tail: bool) -> Column:
    groups = ((PROHIBITIONS, 8), (MODALS, 6), (REQUIREMENTS, 4), (DEFINITIONS, 2), (ACTIONS, 1))
    phrases = once(_padded(text), lambda padded: reduce(Column.__add__, [F.when(_holds(padded, g), p).otherwise(0) for g, p in groups]))
    points = [
        (text.rlike("[.;:]"), 1),
        (F.length(text) >= 200, 1),
        (F.length(text) >= 400, 1),
        (F.length(text) >= 800, 1),
        (looks_like_navigation(text, repeated_tail), -10),
    ]
    return F.when(text == "", -999).otherwise(reduce(Column.__add__, [F.when(t, p).otherwise(0) for t, p in points], phrases))


def is_glossary_reference(reference: Column, source: Column, target: Column) -> Column:
    near = F.concat_ws(" ", normal(reference), F.substring(normal(source), 1, 300), F.substring(normal(target), 1, 300))
    return near.rlike(GLOSSARY_TERM)


def row_score(reference: Column, source: Column, target: Column, duty: str = "none", repeated_tail: bool = True) -> Column:
    """Rank of a cross-reference by both passages; ``duty`` is none, either or both."""
    a, b = any_phrase(source, OBLIGATIONS), any_phrase(target, OBLIGATIONS)
    bonus = {
        "none": F.lit(0),
        "either": F.when(a | b, 3).otherwise(-2),
        "both": F.when(a & b, 6).when(a | b, 1).otherwise(-5),
    }[duty]
    s, t = normal(source), normal(target)
    return (
        rule_signal_score(source, repeated_tail)
        + rule_signal_score(target, repeated_tail)
        + bonus
        + F.when(is_glossary_reference(reference, source, target), -50).otherwise(0)
        + F.when(s.rlike("[.;:]") & t.rlike("[.;:]"), 1).otherwise(0)
        + F.when((s != "") & (s == t), -5).otherwise(0)
    )


def row_signals(c: Column, repeated_tail: bool = True) -> Column:
    """What :func:`row_score` needs of one passage, as a struct, so that it is computed once for each passage."""
    signals = lambda text: F.struct(_rule_signal_score(text, repeated_tail).alias("signal"), any_phrase(c, OBLIGATIONS).alias("duty"), text.rlike("[.;:]").alias("marks"), F.substring(text, 1, 300).alias("head"), F.sha2(text, 256).alias("digest"), (text == "").alias("empty"))
    return once(normal(c), signals)


def score_of_signals(reference: Column, source: Column, target: Column, duty: str = "none") -> Column:
    """:func:`row_score` from both passages' :func:`row_signals`."""
    a, b = source["duty"], target["duty"]
    bonus = {"none": F.lit(0), "either": F.when(a | b, 3).otherwise(-2), "both": F.when(a & b, 6).when(a | b, 1).otherwise(-5)}[duty]
    glossary = F.concat_ws(" ", normal(reference), source["head"], target["head"]).rlike(GLOSSARY_TERM)
    return (
        source["signal"]
        + target["signal"]
        + bonus
        + F.when(glossary, -50).otherwise(0)
        + F.when(source["marks"] & target["marks"], 1).otherwise(0)
        + F.when(~source["empty"] & (source["digest"] == target["digest"]), -5).otherwise(0)
    )


def cue(kind: str, c: Column) -> Column:
    return F.coalesce(c.rlike(CUES[kind]), F.lit(False))


def is_citation_like(c: Column) -> Column:
    return F.coalesce(c.rlike(CITATION), F.lit(False))


def reference_normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[().,;:'\"/\\]", ""), r"[\s\-_]+", " "))


def leakages(question: Column, reference: Column | None = None) -> Column:
    """Distinct (kind, span) of citations in a question, kinds in order; the reference itself comes last."""
    found = []
    for kind, pattern in LEAKAGE:
        spans = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(pattern), F.lit(0))
        if kind == "corpus_code":
            spans = F.filter(spans, lambda s: ~F.regexp_extract(s, "^[A-Z]+", 0).isin(*CURRENCIES))
        found.append(F.transform(spans, _span_of(kind)))
    if reference is not None:
        wanted = reference_normal(reference)
        hit = (wanted != "") & reference_normal(question).contains(wanted) & ~absent(question)
        found.append(F.when(F.coalesce(hit, F.lit(False)), F.array(F.struct(F.lit("reference_text").alias("kind"), F.substring(reference, 1, 120).alias("span")))).otherwise(F.array().cast("array<struct<kind:string,span:string>>")))
    return F.array_distinct(F.concat(*found))


def _span_of(kind: str):
    return lambda span: F.struct(F.lit(kind).alias("kind"), span.alias("span"))


def leakage_kinds(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda x: x["kind"]))


def sentence_count(c: Column) -> Column:
    """Pieces between runs of terminators, without the empty one after a final terminator."""
    text = F.coalesce(c, F.lit(""))
    return F.size(F.split(text, r"[.!?]+", -1)) - F.when(text.rlike(r"[.!?]$"), 1).otherwise(0)


def core_clause(c: Column) -> Column:
    """The first sentence with a modal, else the first sentence, of at most FREEFORM_CHARS characters."""
    text = F.coalesce(c, F.lit(""))
    modal = F.trim(F.regexp_extract(text, CORE_CLAUSE, 1))
    trimmed = F.trim(text)
    first = F.rtrim(F.substring(F.regexp_extract(trimmed, r"(?s)^[^.?!]*[.?!]?", 0), 1, FREEFORM_CHARS))
    clause = F.when(modal != "", modal).otherwise(F.nullif(first, F.lit("")))
    start = F.when(modal != "", F.instr(text, modal) - 1).otherwise(0)
    return F.when(clause.isNotNull(), F.struct(start.alias("start"), (start + F.length(clause)).alias("end"), clause.alias("text")))


def semantic_hook(c: Column, most: int = 12) -> Column:
    """A short description without citations."""
    text = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), HOOK_TAIL, "")
    text = F.regexp_replace(F.regexp_replace(text, HOOK_CITATION, ""), r"\s+", " ")
    text = F.regexp_replace(text, r"^[ ,.;:\-]+|[ ,.;:\-]+$", "")
    return F.array_join(F.slice(F.filter(F.split(text, " "), lambda w: w != ""), 1, most), " ")


def source_only_hints(source: Column, target: Column, k: int = 5) -> Column:
    """The first k distinct content words of the source that the target lacks."""
    return F.slice(F.array_except(content_tokens(source), content_tokens(target)), 1, k)


def question_key(c: Column) -> Column:
    """Letters and digits in lower case, single spaces: equal for questions that differ in form only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))


def question_type(c: Column) -> Column:
    first = F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"[a-z0-9]+", 0)
    return F.when(first.isin(*QUESTION_WORDS), first).otherwise("other")


def tri_state(c: Column) -> Column:
    """True, false or unknown from the usual words."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, one row of the table as the bits of a number."""
    places: dict = {}
    for k, token in enumerate(b):
        places[token] = places.get(token, 0) | (1 << k)
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        match = row & places.get(token, 0)
        row = ((row + match) | (row - match)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays; no built-in function has it."""
    return pd.Series([_lcs(x, y) for x, y in zip(a, b, strict=True)])


def f1(overlap: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0) | (overlap == 0), 0.0).otherwise(2.0 * overlap / (a + b))


def normal_url(c: Column) -> Column:
    """Scheme and host in lower case, no fragment, query or final slash."""
    bare = F.regexp_replace(F.trim(c), r"[#?].*$", "")
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", 0)
    path = F.substr(bare, F.length(head) + 1)
    return F.concat(F.lower(head), F.regexp_replace(path, "/+$", ""))


def undated_url(c: Column) -> Column:
    """Without a trailing dd-mm-yyyy segment."""
    return F.regexp_replace(c, r"/\d{2}-\d{2}-\d{4}/?$", "")


def anchor_key(c: Column) -> Column:
    """Percent-decoded, lower-case letters and digits of a fragment; a plus sign stays a plus sign."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.lower(F.coalesce(decoded, c)), "[^a-z0-9]+", "")


def is_bad_href(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True)) | F.lower(F.trim(c)).rlike("^(mailto:|javascript:|tel:|data:|#$)")


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def uid(*parts: Column, caps=None, size: int = 16, separator: str = "||") -> Column:
    """First characters of the SHA-256 of joined parts; null counts as empty."""
    kept = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    if caps:
        kept = [F.substring(p, 1, n) if n else p for p, n in zip(kept, caps, strict=True)]
    return F.substring(F.sha2(F.concat_ws(separator, *kept), 256), 1, size)


def draw(seed: int, *key: Column) -> Column:
    """A fixed pseudo-random order of rows by their key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))


def strict_bool(c: Column) -> Column:
    """True, false or unknown in the narrow vocabulary of model replies."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)


def word_set(c: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores of any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words as a share of all words of two texts; null if either has none."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def question_key_unicode(c: Column) -> Column:
    """Letters and digits of any script and question marks in lower case, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}\s?]", " "), r"\s+", " "))


def question_key_ascii(c: Column) -> Column:
    """ASCII letters and digits and question marks in lower case; outer spaces are those that marks leave."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s?]", " "), r"\s+", " ")


def question_key_tokens(c: Column) -> Column:
    """Words without their marks, and question marks, as tokens."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\?|[^\s?]+"), F.lit(0))
    bare = F.transform(found, lambda t: F.when(t == "?", t).otherwise(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")))
    return F.array_join(F.filter(bare, lambda t: t != ""), " ")


# Beginnings of target texts that are navigation, and the suffix of numbered passages.
TARGET_NAVIGATION = (r"^legal instruments that change this part\b", r"^parts?\b", r"^policy statements?\b", r"^supervisory statements?\b")
PASSAGE_SUFFIX = r"::p(\d{6})$"


def navigation_reason(c: Column) -> Column:
    """Why a target text looks like navigation: empty, a pattern it begins with, or capitals without a sentence; null if it does not."""
    bare = F.coalesce(normal(c), F.lit(""))
    reason = F.when(bare == "", "empty")
    for pattern in TARGET_NAVIGATION:
        reason = reason.when(bare.rlike("(?i)" + pattern), pattern)
    small = F.length(F.regexp_replace(bare, r"[^\p{Ll}]", ""))
    return reason.when(~bare.rlike("[.;:!?]") & (small < 3), "titlecase_no_punct")


def first_text(*options: Column) -> Column:
    """The first option that holds more than white space, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])
