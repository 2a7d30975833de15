"""HTML extraction with wrappers: union-free expressions inferred from all pages of a host.

A page is a stream of tags and texts. The streams of a host's pages are aligned one after
the other, level by level: tokens below the same chain of open elements are at one place
of the expression. What one stream has and another lacks there becomes an optional group,
what a stream has more often than what it lies in becomes a repeated one, and texts that
differ become a slot; a text that stays the same is the template's own. Two streams'
results are aligned like two streams, in any order with the same result, so tasks align
their pages first and only the places' summaries are shuffled and added up. Pages with an
article and pages without one have an expression each.

The text of a page is what stands in the content slots of its host's expression, read by
walking the page along the expression: with an article, the slots inside it that are in no
frame; without one, those outside frames, but for texts that are the same in all of at
least ``LEAST`` different pages, if any other text of the template varies. A frame is an
element that by its tag, class, id or role never holds the article's text.

Content slots are sent to all tasks only after their number has been checked against
``PLACES``; beyond it pages join theirs. Null pages are empty, null urls share the empty
host, repeated rows keep a row each, empty tables give no rows, and only the named columns
are read and returned. Malformed markup is read in one pass: a tag that doesn't end is
text, and after a quote that doesn't end quotes are taken as they come.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, numbered
from .urls import host_of

#: Different pages that a text has to be the same in, content slots that are sent to all tasks, places that a task adds up at a time.
LEAST, PLACES, HELD = 3, 400_000, 100_000

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"']+)*")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Elements whose content is no markup and no text of the page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript", "svg", "iframe", "object", "select", "textarea", "title")}
#: Elements, and words of class, id or role, that never hold the article's text.
FRAME_TAGS = {"nav", "header", "footer", "aside", "form", "button", "head", "menu", "dialog", "label"}
FRAME_WORDS = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
    "cookies", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup",
    "promo", "related", "share", "sharing", "sidebar", "social", "sponsored", "subscribe", "toolbar", "widget",
}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Closing tags that don't end a frame which was opened after their element, and elements that end one of their kind before them.
LOOSE, NEXT = INLINE | {"p"}, {"p", "li", "dt", "dd", "tr", "td", "th", "option"}


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(tag, text or key, closes): texts have the tag ``""``; keys are the tag with its class, id and role words."""
    at, n, quotes, ends = 0, len(page), True, True
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "", page[at:], False
            return
        if begin > at:
            yield "", page[at:begin], False
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        m, end = _NAME.match(page, begin), -1
        if m and ends:
            if quotes:
                end = _ATTRIBUTES.match(page, m.end()).end()
                if end >= n or page[end] != ">":
                    quotes, end = False, -1
            if end < 0:
                end = page.find(">", m.end())
        elif not m and ends and page[begin + 1 : begin + 2] in ("!", "?", "/"):
            end = page.find(">", begin + 1)
            if end >= 0:
                at = end + 1
                continue
        else:
            yield "", "<", False
            at = begin + 1
            continue
        if end < 0:  # no tag ends any more
            ends = False
            yield "", "<", False
            at = begin + 1
            continue
        tag, at = m[2].lower(), end + 1
        if m[1]:
            yield tag, tag, True
            continue
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = n if stop is None else stop.end()
            continue
        given = page[m.end() : end]
        names = sorted({w for v in _NAMES.findall(given) for w in re.split(r"[^a-z0-9]+", v.lower()) if w.isalpha()}) if "=" in given else []
        yield tag, ".".join([tag, *names]), False


@dataclass
class Page:
    """A page's texts and block ends in order, and the places of its elements."""

    #: (text or None for the end of a block, place, whether it is in a frame)
    parts: list = field(default_factory=list)
    #: place: (place around it, key, inside an article, in a frame, how far in the page)
    places: dict = field(default_factory=dict)
    counts: Counter = field(default_factory=Counter)

    @property
    def article(self) -> bool:
        return any(inside and not framed for _, _, inside, framed, _ in self.places.values())


def read(page: str) -> Page:
    """Walk a page's tokens along its nesting."""
    out = Page()
    nest: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, place, inside an article, in a frame
    opened: dict[str, list[int]] = {}
    frames: list[int] = []

    def close(depth: int) -> None:
        while len(nest) > depth:
            opened[nest.pop()[0]].pop()
        while frames and frames[-1] >= depth:
            frames.pop()

    for tag, key, closes in tokens(page):
        _, place, inside, framed = nest[-1]
        if not tag:
            out.parts.append((key, place, framed))
        elif closes:
            depth = opened[tag][-1] if opened.get(tag) else 0
            # a closing tag of inline text doesn't end a frame that was opened after it
            if depth and not (tag in LOOSE and frames and frames[-1] > depth):
                close(depth)
            if tag not in INLINE:
                out.parts.append((None, nest[-1][1], nest[-1][3]))
        else:
            words = key.split(".")[1:]
            frame = tag in FRAME_TAGS or tag not in ("html", "body", "article", "main") and not FRAME_WORDS.isdisjoint(words)
            if tag in NEXT and nest[-1][0] == tag:
                close(len(nest) - 1)
                _, place, inside, framed = nest[-1]
            if tag not in INLINE and not frame:
                out.parts.append((None, place, framed))
            if tag in VOID or tag in INLINE and not frame and not framed:
                continue
            own = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), place & (1 << 64) - 1)
            own -= own >> 63 << 64
            inside, framed = inside or tag in ("article", "main"), framed or frame
            out.counts[own] += 1
            out.places.setdefault(own, (place, key, inside, framed, len(out.places)))
            opened.setdefault(tag, []).append(len(nest))
            if frame:
                frames.append(len(nest))
            nest.append((tag, own, inside, framed))
    out.places[0] = (0, "", False, False, -1)  # what lies in no element
    out.counts[0] = 1
    return out


#: The columns of a place: the one around it, its key, whether it is inside an article and in a frame, pages that have it,
#: whether it is repeated, least and greatest hash of its text, some different pages, and how far in a page it is at least.
COLUMNS = ("around", "key", "inside", "framed", "pages", "repeated", "low", "high", "seen", "place_no")


def stream(page: str, read_: Page | None = None) -> dict[int, tuple]:
    """One page as an expression without groups: place to ``COLUMNS``."""
    p = read_ or read(page)
    texts: dict[int, list[str]] = {}
    for text, place, _ in p.parts:
        if text is not None:
            texts.setdefault(place, []).append(text)
    own = xxhash.xxh64_intdigest(page.encode("utf-8", "replace"))
    out = {}
    for place, (around, key, inside, framed, at) in p.places.items():
        text = " ".join(" ".join(texts.get(place, ())).split())
        h = xxhash.xxh64_hexdigest(text.encode("utf-8", "replace")) if text else ""
        out[place] = (around, key, inside, framed, 1, p.counts[place] > p.counts[around], h, h, [own - (own >> 63 << 64)], at)
    return out


def align(a: dict[int, tuple], b: dict[int, tuple]) -> dict[int, tuple]:
    """Two expressions, or streams, as one; into ``a``."""
    for place, y in b.items():
        x = a.get(place)
        a[place] = y if x is None else (*x[:4], x[4] + y[4], x[5] or y[5], min(x[6], y[6]), max(x[7], y[7]), sorted({*x[8], *y[8]})[:LEAST], min(x[9], y[9]))
    return a


def content(places: dict[int, tuple], article: bool) -> frozenset[int]:
    """The places whose slots hold the article's text."""
    varies = any(not x[3] and x[6] != x[7] for x in places.values())

    def is_content(x: tuple) -> bool:
        if x[3] or not x[7]:
            return False
        return x[2] if article else not (varies and x[6] == x[7] and len(x[8]) >= LEAST)

    return frozenset(place for place, x in places.items() if is_content(x))


@dataclass
class Wrapper:
    """The expressions of pages without (False) and with (True) an article."""

    places: dict[bool, dict[int, tuple]]

    def slots(self, article: bool) -> frozenset[int]:
        return content(self.places.get(article, {}), article)

    def expression(self, article: bool) -> list:
        """Nested groups: [kind, key, slot, groups inside]; kinds are one, optional, repeated and optional repeated, slots none, fixed and text."""
        places = self.places.get(article, {})
        inside: dict[int, list[int]] = {}
        for place, x in sorted(places.items(), key=lambda p: (p[1][9], p[0])):
            if place:
                inside.setdefault(x[0], []).append(place)

        def group(place: int) -> list:
            x = places[place]
            kind = " ".join(w for w, yes in (("optional", x[4] < places[x[0]][4]), ("repeated", x[5])) if yes) or "one"
            slot = "none" if not x[7] else "fixed" if x[6] == x[7] else "text"
            return [kind, x[1], slot, [group(p) for p in inside.get(place, ())]]

        return [group(p) for p in inside.get(0, ())]


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages of a host, aligned one after the other."""
    out = Wrapper({})
    for page in pages:
        p = read(page)
        align(out.places.setdefault(p.article, {}), stream(page, p))
    return out


def apply(wrapper: Wrapper, page: str) -> str:
    """The text of a page: its content slots' blocks, joined by one space. A page with places that the wrapper lacks has one of its own."""
    p = read(page)
    if not p.places.keys() <= wrapper.places.get(p.article, {}).keys():
        wrapper = infer([page])
    return text_of(p, wrapper.slots(p.article))


def text_of(p: Page, slots: frozenset[int]) -> str:
    out: list[str] = []
    block: list[str] = []
    for text, place, framed in p.parts:
        if text is None:
            if block and not framed:
                out.append("".join(block))
                block = []
        elif place in slots:
            block.append(text)
    out.append("".join(block))
    return " ".join(x for b in out if (x := " ".join(entities.unescape(b).split())))


_KINDS = "host string, article boolean, place long, around long, key string, inside boolean, framed boolean, pages long, repeated boolean, low string, high string, seen array<long>, place_no long"
_TYPES = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64()]


def wrappers(pages: DataFrame, ws: Workspace, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, article, place, ``COLUMNS``, content): the expressions of all hosts, a row for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], dict[int, tuple]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*at, place, *x) for at, places in known.items() for place, x in places.items()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 13, _TYPES)], names=["host", "article", "place", *COLUMNS])

        held = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text := page.as_py():
                    p = read(text)
                    places = known.setdefault((host, p.article), {})
                    held -= len(places)
                    align(places, stream(text, p))
                    held += len(places)
                    if held > HELD:
                        yield flush()
                        held = 0
        yield flush()

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("page")).mapInArrow(run, _KINDS)
    first = [F.first(c).alias(c) for c in ("around", "key", "inside", "framed")]  # equal in all rows of a place
    seen = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, LEAST)  # a few of each task
    places = rows.groupBy("host", "article", "place").agg(*first, F.sum("pages").alias("pages"), F.bool_or("repeated").alias("repeated"), F.min("low").alias("low"), F.max("high").alias("high"), seen.alias("seen"), F.min("place_no").alias("place_no"))
    places = ws.save(places, "places")
    varies = places.groupBy("host", "article").agg(F.bool_or(F.expr("not framed and low <> high")).alias("varies"))
    same = F.expr(f"varies and low = high and size(seen) >= {LEAST}")
    slot = F.expr("not framed and high <> ''") & F.when(F.col("article"), F.col("inside")).otherwise(~same)
    return ws.save(places.join(varies, ["host", "article"]).withColumn("content", slot).drop("varies"), "wrappers")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text), a row for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ws = Workspace(pages.sparkSession, "html")
    slots = wrappers(rows, ws).where("content").select("host", "article", "place")
    kind = rows.schema["page_id"].dataType.simpleString()
    if slots.count() > PLACES:
        return _extract_by_join(numbered(rows, ws), slots, kind)
    known: dict[tuple[str, bool], set[int]] = {}
    for r in slots.toLocalIterator():
        known.setdefault((r.host, r.article), set()).add(r.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for host, page in zip(batch.column(3).to_pylist(), batch.column(2)):
                p = read(page.as_py() or "")
                text.append(text_of(p, known.get((host, p.article), frozenset())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return rows.withColumn("host", host_of(F.col("url"))).mapInArrow(run, f"page_id {kind}, url string, text string")


def _extract_by_join(rows: DataFrame, slots: DataFrame, kind: str) -> DataFrame:
    """Each page with those of its own places that are content, which meet the slots by place."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(rid, host, p.article, place) for rid, host, page in zip(*(c.to_pylist() for c in batch.columns)) for p in [read(page or "")] for place in p.places]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int64(), pa.string(), pa.bool_(), pa.int64()))], names=["rid", "host", "article", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [text_of(read(page or ""), frozenset(places or ())) for page, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    own = rows.select("rid", host_of(F.col("url")).alias("host"), "html").mapInArrow(placed, "rid long, host string, article boolean, place long")
    held = own.join(slots, ["host", "article", "place"]).groupBy("rid").agg(F.collect_list("place").alias("places"))  # as many as a page has
    return rows.join(held, "rid", "left").select("page_id", "url", "html", "places").mapInArrow(run, f"page_id {kind}, url string, text string")
