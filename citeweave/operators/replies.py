"""Asking models and reading what they say.

A model is a callable from a prompt to a text; it is called in Arrow batches on
the executors, and each call gives a struct (ok, content, error, attempts), so
failures are data.  Nothing here opens a connection: callers bring the callable,
or :func:`replay` answers from a table.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import curation

REPLY = "ok boolean, content string, error string, attempts int"
PERSONA_BLOCKS = "map<string,array<struct<question:string,answer:string>>>"


def lenient_json(text: str):
    """The object in a reply: as it is, without a fence, or from the first to the last brace; None if there is none."""
    bare = re.sub(r"^```[A-Za-z]*\s*|\s*```$", "", text.strip())
    braces = re.search(r"\{.*\}", bare, re.DOTALL)
    for piece in (bare, braces[0] if braces else ""):
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    return None


class ReplyLog:
    """Replies by a digest of their prompt, one small file each, below a folder that all executors share.

    A file is written under another name and then moved, so it is there whole or not at all.
    Failed calls are not logged: they are asked again.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, prompt: str):
        from pyarrow import fs

        name = hashlib.sha256(prompt.encode()).hexdigest()
        path = f"{self.folder.rstrip('/')}/{name[:2]}/{name}"
        if path.startswith(("file:", "/")):
            return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(path)

    def get(self, prompt: str) -> str | None:
        system, path = self._place(prompt)
        try:
            with system.open_input_file(path) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, prompt: str, content: str) -> None:
        system, path = self._place(prompt)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as f:
            f.write(content.encode())
        system.move(draft, path)


def one_call(model: Callable[[str], str], prompt: str, retries: int, wants_json: bool, wait: float, log: ReplyLog | None = None) -> tuple[bool, str, str | None, int]:
    """A call with its retries: (ok, content, error, attempts); each wait is twice the one before, a logged reply takes no attempt."""
    if log is not None and (known := log.get(prompt)) is not None:
        return True, known, None, 0
    error = None
    for attempt in range(1, retries + 2):
        try:
            content = (model(prompt) or "").strip()
            if wants_json and lenient_json(content) is None:
                raise ValueError("invalid_json")
            if not content:
                raise ValueError("empty_response")
            if log is not None:
                log.put(prompt, content)
            return True, content, None, attempt
        except Exception as e:  # whatever a model raises becomes the row's error
            error = str(e)
            if attempt <= retries and wait:
                time.sleep(wait * 2 ** (attempt - 1))
    return False, "", error, retries + 1


def ask(prompts: DataFrame, model: Callable[[str], str], key: str = "item", prompt_col: str = "prompt", retries: int = 2, wants_json: bool = True, wait: float = 0.0, at_once: int = 1, log: ReplyLog | None = None) -> DataFrame:
    """(key, ok, content, error, attempts) of each prompt.

    A task has up to ``at_once`` calls under way, and asks equal prompts of an
    Arrow batch once.  With a log, what was answered before, by a task that was
    lost too, is not asked again; attempts are then 0.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches):
        call = partial(one_call, model, retries=retries, wants_json=wants_json, wait=wait, log=log)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                asked = [p or "" for p in batch.column(1).to_pylist()]
                once = list(dict.fromkeys(asked))
                answers = dict(zip(once, pool.map(call, once) if at_once > 1 else map(call, once), strict=True))
                columns = list(zip(*(answers[p] for p in asked), strict=True)) or [[]] * 4
                kinds = (pa.bool_(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["key", "ok", "content", "error", "attempts"])

    return prompts.select(F.col(key).alias("key"), prompt_col).mapInArrow(run, f"key {kind}, {REPLY}").withColumnRenamed("key", key)


def replay(prompts: DataFrame, replies: DataFrame, key: str = "item") -> DataFrame:
    """The same table from replies recorded by key; a key without one is a failed call."""
    known = replies.select(key, F.col("content").alias("_content"))
    ok = F.coalesce(F.trim("_content") != "", F.lit(False))
    rows = prompts.select(key).join(known, key, "left")
    return rows.select(key, ok.alias("ok"), F.when(ok, F.col("_content")).otherwise("").alias("content"), F.when(~ok, "no_reply").alias("error"), F.lit(1).alias("attempts"))


def _block(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"{title}:\n"), F.coalesce(body, F.lit("")), F.lit("\n\n"))


def question_prompt(source: Column, target: Column, reference: Column, personas: tuple[str, ...], per_persona: int = 2, no_citations: bool = False) -> Column:
    """Asks for questions that need both passages, as JSON lists by persona."""
    shape = json.dumps({p: [{"question": "...", "answer": "..."}] for p in personas})
    rule = "Name no rule, section or article. " if no_citations else ""
    task = f"Write up to {per_persona} questions for each of {', '.join(personas)} that only both passages together answer. {rule}Mark what you use with [#SRC:id] and [#TGT:id]. Reply with JSON of this form: {shape}"
    return F.concat(_block("Source passage", source), _block("Target passage", target), _block("Reference", reference), F.lit(task))


def judge_prompt(question: Column, answer: Column, source: Column, target: Column) -> Column:
    """Asks whether a question needs the reference, as the checks that are read back."""
    shape = json.dumps({"binary_checks": dict.fromkeys(curation.CHECKS, "true or false"), "final_score": "0 to 10", "confidence": "0 to 1"})
    return F.concat(_block("Question", question), _block("Answer", answer), _block("Source passage", source), _block("Target passage", target), F.lit(f"Judge whether the question depends on the reference from source to target. Reply with JSON of this form: {shape}"))


def answer_prompt(question: Column, context: Column) -> Column:
    """Asks for an answer from retrieved passages alone."""
    return F.concat(_block("Passages", context), _block("Question", question), F.lit("Answer from the passages alone and mark each one you use with [#ID:its id]."))


def extract_questions(replies: DataFrame, personas: tuple[str, ...], cap: int = 2, no_citations: bool = False, dedup: bool = True) -> DataFrame:
    """Every question of every reply with the first reason to drop it, null for those kept.

    ``replies``: pair_uid, source_uid, target_uid, content.  Reasons in order:
    invalid (an empty side), missing_tags, citation_policy, duplicate (of an
    earlier one in the order of pairs, personas and places), over_cap (more than
    ``cap`` kept ones of a pair and persona).
    """
    raw = F.regexp_extract(F.coalesce("content", F.lit("")), r"(?s)\{.*\}", 0)
    blocks = F.coalesce(F.from_json(raw, PERSONA_BLOCKS), F.create_map().cast(PERSONA_BLOCKS))
    each = F.filter(F.map_entries(blocks), lambda e: e["key"].isin(*personas))
    rows = replies.select("pair_uid", "source_uid", "target_uid", F.explode(each).alias("e")).select("pair_uid", "source_uid", "target_uid", F.col("e.key").alias("persona"), F.posexplode(F.coalesce("e.value", F.array().cast("array<struct<question:string,answer:string>>"))).alias("place", "qa"))
    rows = rows.select("pair_uid", "source_uid", "target_uid", "persona", "place", T.normal(F.col("qa.question")).alias("question"), T.normal(F.col("qa.answer")).alias("answer"))
    tagged = lambda tag, uid: F.coalesce(F.col("answer").contains(F.concat(F.lit(f"[#{tag}:"), F.col(uid), F.lit("]"))), F.lit(False))
    cites = T.is_citation_like(F.col("question")) | T.is_citation_like(F.col("answer"))
    reason = F.when(T.absent(F.col("question")) | T.absent(F.col("answer")), "invalid").when(~tagged("SRC", "source_uid") | ~tagged("TGT", "target_uid"), "missing_tags").when(F.lit(no_citations) & cites, "citation_policy")
    rows = rows.withColumn("reason", reason).withColumn("_key", T.question_key_unicode(F.col("question")))
    if dedup:
        first = rows.where("reason is null").groupBy("_key").agg(F.min(F.struct("pair_uid", "persona", "place")).alias("_first"))
        rows = rows.join(first, "_key", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.struct("pair_uid", "persona", "place") != F.col("_first")), "duplicate").otherwise(F.col("reason"))).drop("_first")
    from pyspark.sql import Window as W

    kept = F.sum(F.when(F.col("reason").isNull(), 1).otherwise(0)).over(W.partitionBy("pair_uid", "persona").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_kept", kept).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_kept") > cap), "over_cap").otherwise(F.col("reason"))).drop("_key", "_kept")


def method_of(method: Column, hook: Column) -> Column:
    """The method a row names, else the one whose trace it carries."""
    return F.coalesce(F.nullif(F.trim(method), F.lit("")), F.when(hook.isNotNull(), "SCHEMA").otherwise("DPEL"))


def persona_of(persona: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(persona), F.lit("")), F.lit("unknown"))


def pair_of(pair: Column, source: Column, target: Column) -> Column:
    """The pair a row names, else its two passages; null without them."""
    both = F.when((source != "") & (target != ""), F.concat_ws("__", source, target))
    return F.coalesce(F.nullif(F.trim(pair), F.lit("")), both)
