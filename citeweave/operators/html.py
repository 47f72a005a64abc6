"""Passages and links of web pages, parsed in Arrow batches with the standard library."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that hold no content, marks of page furniture, and texts that only lead elsewhere.
SKIPPED = frozenset("script style noscript header footer nav aside".split())
BAD_TOKENS = frozenset("cookie consent sidebar advert advertisement promo banner".split())
VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())
BLOCKS = frozenset(("p", "li"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAST_CHARS, LEAST_WORDS, CONTEXT = 25, 4, 4
DOT_LEADER = re.compile(r"\.{4,}")
NAVIGATION = re.compile(r"^(legal instruments that change this (part|rule|chapter)\b|parts?\b|policy statements?\b|annex(es)?\b|appendix\b)", re.IGNORECASE)


def is_meaningful(text: str, chars: int = LEAST_CHARS, words: int = LEAST_WORDS) -> bool:
    """Long enough, and neither a table of contents nor navigation."""
    return len(text) >= chars and len(text.split()) >= words and not DOT_LEADER.search(text) and not NAVIGATION.match(text)


# The HTML standard's element groups that decide which end tags are implied.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul dd dt xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
SPECIAL = CLOSES_P | SCOPE | frozenset("body button colgroup frameset head iframe noembed noframes noscript script select style tbody textarea tfoot thead title tr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
# a start tag ends what is open of these, up to the limits given
TABLE_PARTS = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"})}
TABLE_PARTS |= {t: ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")}


class _Open:
    """An open element; what is collected for it is complete when it closes."""

    __slots__ = ("tag", "attrs", "number", "noise", "bad", "event", "before")

    def __init__(self, tag, attrs, number, noise, bad):
        self.tag, self.attrs, self.number, self.noise, self.bad = tag, attrs, number, noise, bad
        self.event, self.before = None, 0


class _Machine(HTMLParser):
    """A stack of open elements with implied end tags; elements and texts are reported as they open and close.

    Subclasses see elements outside page furniture only; no tree is kept.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = [_Open("", {}, 0, False, False)]
        self.count, self.open_tags = 0, Counter()
        self.data: list[str] = []

    def opened(self, element: _Open) -> None: ...

    def closed(self, element: _Open) -> None: ...

    def said(self, text: str) -> None: ...

    def _flush(self) -> None:
        """Neighbouring pieces of text are one text."""
        if self.data:
            text = "".join(self.data)
            self.data = []
            if not self.stack[-1].noise and (text := text.strip()):
                self.said(text)

    def _end(self, element: _Open) -> None:
        self.open_tags[element.tag] -= 1
        if not element.noise:
            self.closed(element)

    def _pop(self) -> None:
        self._end(self.stack.pop())

    def _pop_to(self, depth: int) -> None:
        """Close elements until ``depth`` are open."""
        while len(self.stack) > depth:
            self._pop()

    def _in_scope(self, tags, limits) -> int:
        """The place of the innermost of ``tags`` that no limit hides; 0 for none."""
        if not any(self.open_tags[t] for t in tags):
            return 0
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                return depth
            if tag in limits:
                return 0
        return 0

    def _imply_ends(self, tag: str) -> None:
        if tag in CLOSES_P and (depth := self._in_scope({"p"}, BUTTON_SCOPE)):
            self._pop_to(depth)
        if tag == "li":
            self._end_item({"li"}, LIST_SCOPE)
        elif tag in ("dd", "dt"):
            self._end_item({"dd", "dt"}, SCOPE)
        elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop()
        elif tag == "a" and (depth := self._in_scope({"a"}, SPECIAL)):
            self._pop_to(depth)
        elif tag in ("option", "optgroup") and self.stack[-1].tag == "option":
            self._pop()
        elif tag in TABLE_PARTS:
            parts, limits = TABLE_PARTS[tag]
            if depth := self._in_scope(parts, limits):
                self._pop_to(depth)

    def _end_item(self, tags, limits) -> None:
        if not any(self.open_tags[t] for t in tags):
            return None
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                return self._pop_to(depth)
            if tag in limits or (tag in SPECIAL and tag not in ("address", "div", "p")):
                return None
        return None

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in ("html", "body", "head") and self.open_tags[tag]:
            return
        self._imply_ends(tag)
        self._open(tag, attrs)
        if tag in VOID:
            self._pop()

    def _open(self, tag, attrs) -> None:
        above = self.stack[-1]
        self.count += 1
        named = {k: v or "" for k, v in reversed(attrs)}  # the first of repeated attributes counts
        marks = set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}".lower()))
        inherited = above.bad and tag not in ("body", "html")
        element = _Open(tag, named, self.count, above.noise or tag in SKIPPED, inherited or (tag not in ("body", "html") and bool(marks & BAD_TOKENS)))
        self.stack.append(element)
        self.open_tags[tag] += 1
        if not element.noise:
            self.opened(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._flush()
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "p":
            depth = self._in_scope({"p"}, BUTTON_SCOPE)
        elif tag == "li":
            depth = self._in_scope({"li"}, LIST_SCOPE)
        elif tag in HEADINGS:
            depth = self._in_scope(HEADINGS, SCOPE)
        elif tag in SPECIAL:
            depth = self._in_scope({tag}, SCOPE - {tag})
        else:
            depth = self._in_scope({tag}, SPECIAL)
        if depth:
            self._pop_to(depth)
        elif tag in FORMATTING and (depth := self._in_scope({tag}, SCOPE)):
            # it ends in spite of the open blocks inside it, which stay open
            self._end(self.stack.pop(depth))

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()
        self._pop_to(1)


class _Container(_Machine):
    """Finds the element that holds a page's content: its number in order of opening, 0 for the whole page."""

    TESTS = (
        lambda tag, at: tag == "main",
        lambda tag, at: tag == "article",
        lambda tag, at: tag == "div" and at.get("id") == "content",
        lambda tag, at: tag == "div" and at.get("id") == "main",
        lambda tag, at: tag == "div" and at.get("role") == "main",
        lambda tag, at: tag == "div" and "content" in at.get("class", "").split(),
        lambda tag, at: tag == "div" and "main-content" in at.get("class", "").split(),
    )

    def __init__(self):
        super().__init__()
        self.first = [0] * len(self.TESTS)
        self.blocks, self.best, self.most, self.body = 0, 0, 0, 0

    def opened(self, element):
        for k, test in enumerate(self.TESTS):
            if not self.first[k] and test(element.tag, element.attrs):
                self.first[k] = element.number
        if element.tag == "body" and not self.body:
            self.body = element.number
        self.blocks += element.tag in BLOCKS
        element.before = self.blocks

    def closed(self, element):
        if element.tag == "div":
            inside = self.blocks - element.before
            if inside > self.most or (inside == self.most and 0 < element.number < self.best):
                self.best, self.most = element.number, inside

    def found(self) -> int:
        return next((n for n in self.first if n), self.best if self.most else self.body)


def _drop_last(held: list, thing) -> None:
    """Take a thing out of a list that has it near its end, if it has it."""
    for k in range(len(held) - 1, -1, -1):
        if held[k] is thing:
            del held[k]
            return


class _Blocks(_Machine):
    """Headings, blocks, links and anchors below one element, in order of opening."""

    def __init__(self, container: int):
        super().__init__()
        self.container, self.inside = container, container == 0
        self.events: list[dict] = []
        self.listening: list[dict] = []  # events that collect texts: headings, blocks and links
        self.around: list[dict] = []  # events of all open elements

    def opened(self, element):
        if not self.inside:
            self.inside = element.number == self.container
            return
        at, tag = element.attrs, element.tag
        event = {"tag": tag, "bad": element.bad, "texts": [], "own": at.get("id", "").strip(), "anchors": [], "ids": [], "names": [], "links": []}
        element.event = event
        if tag == "a":
            # an anchor names itself and every element around it
            anchors = [at[k].strip() for k in ("id", "name") if at.get(k, "").strip()]
            for other in (*self.around, event):
                other["anchors"] += anchors
                if other is not event:
                    other["ids"] += [at["id"].strip()] if "id" in at else []
                    other["names"] += [at["name"].strip()] if "name" in at else []
            if at.get("href", "").strip():
                event["href"] = at["href"].strip()
                for other in self.around:
                    other["links"].append(event)
        if tag in HEADINGS or tag in BLOCKS or "href" in event:
            self.listening.append(event)
        self.around.append(event)
        self.events.append(event)

    def closed(self, element):
        if element.number == self.container:
            self.inside = False
        event = element.event
        if event is not None:
            for held in (self.around, self.listening):
                _drop_last(held, event)
            event["text"] = " ".join(" ".join(event.pop("texts")).split())

    def said(self, text):
        for event in self.listening:
            event["texts"].append(text)


def parse(html: str):
    """(passages, links): (position, tag, anchor, anchors, headings, text) and (position, href, text).

    Every paragraph and list item of the content is a passage, nested ones too, if its text is
    long enough and it does not stand in page furniture.  Its name is its id, else the first id or
    name of an anchor in it, else a number; its anchors are its name and those met since the last
    passage, headings the last four before it.
    """
    chooser = _Container()
    chooser.feed(html)
    chooser.close()
    machine = _Blocks(chooser.found())
    machine.feed(html)
    machine.close()
    passages, links, headings, waiting, seen, numbered = [], [], [], [], set(), 0
    for event in machine.events:
        tag, text = event["tag"], event["text"]
        if tag in HEADINGS and text:
            headings = [*headings, text][-CONTEXT:]
        waiting += [event["own"], *event["anchors"]] if event["own"] else event["anchors"]
        if tag not in BLOCKS or event["bad"] or not is_meaningful(text):
            continue
        name = event["own"] or next(iter(event["ids"]), "") or next(iter(event["names"]), "")
        if not name:
            numbered += 1
            name = f"p{numbered:06d}"
        if name in seen:
            name = f"{name}__dup_{hashlib.sha1(text.encode(errors='ignore')).hexdigest()[:12]}"
        seen.add(name)
        at = len(passages)
        passages.append((at, tag, name, list(dict.fromkeys([name, *waiting])), headings, text))
        links += [(at, a["href"], a["text"] or a["href"]) for a in event["links"]]
        waiting = []
    return passages, links


def passages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, position, tag, anchor, anchors, headings, text) of every content block."""

    def run(batches):
        for batch in batches:
            out = []
            for page, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(page, *p) for p in parse(html or "")[0]]
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "position", "tag", "anchor", "anchors", "headings", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, position int, tag string, anchor string, anchors array<string>, headings array<string>, text string")


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, position, href, absolute, text) of every link inside a content block."""
    from urllib.parse import urljoin

    def run(batches):
        for batch in batches:
            out = []
            for page, html, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for at, href, text in parse(html or "")[1]:
                    try:
                        full = urljoin(url or "", href)
                    except ValueError:
                        full = href
                    out.append((page, at, href, full, text))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "position", "href", "absolute", "text"])

    return pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string"), F.col(url_col).cast("string")).mapInArrow(run, "page_id long, position int, href string, absolute string, text string")


def decode(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, html) of binary files, in the first encoding that fits."""

    def run(batches):
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                for name in ("utf-8-sig", "cp1252", "latin-1"):  # the last one fits anything
                    try:
                        out.append((raw or b"").decode(name))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", "html"])

    return files.select(path_col, content_col).mapInArrow(run, "path string, html string")
