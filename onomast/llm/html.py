"""Main text of web pages by site style trees.

Pages of a host are merged: elements with one path of tags and classes are one element
node of the host's style tree. A node keeps, over the pages that have it, the
*presentation styles* (sequences of its child elements) and the *contents* (texts of the
blocks right under it). With m pages, the presentation importance is the entropy of the
styles with base m, the content importance of a text on n pages 1 - log_m(n): 1 if every
page differs, 0 if all are the same; with one page both are 1. A node's importance is
(1 - g^l) * presentation + g^l * content, for l styles and g = 0.9, where content is the
mean over its own texts and, by their size, the importance of the nodes below it.

The tree decides on every host with two different pages or more:

* A branch carries the information of its texts: their code points times their content
  importance, per page. From the root down, the child with ``DOMINANT`` of its parent's
  information is followed as long as there is one; paragraphs, lists and the like are not
  entered. Where that ends is the host's main branch.
* Beside the main branch a node's importance is weighed by its share of the host's
  information (up to ``SHARE`` it counts in proportion; main headings count in full). A
  branch all of whose nodes are below ``threshold`` is noise and removed from each page;
  so are branches inside the main one with repeated texts, but for prose without a class.
* On what is left open, a branch beside the main one of too much weight to be removed,
  markup decides, as it does for what is noise inside the main branch (forms, adverts,
  reader comments), whose texts differ as much as the article's.

A host with one page (equal pages count once, by weights that add up to 1), or without a
main branch, is judged by markup alone: scripts, styles, forms, menus, headers and
footers of the page, side bars, and elements whose class, id or role names adverts,
notices, comments and the like are noise. A class or id names such a thing if all its
words do (``cookie-notice``, ``ad-box``; neither ``ad-free`` nor ``has-sidebar``); it says
nothing on ``html``, ``body`` and main parts, nor on what holds a ``main``, nor on what
holds an ``article`` if no main part is outside. Where a page marks an article
(``article``, ``main``, role ``main``), the text is taken from it.

What is kept: blocks in page order, character references decoded, white space inside a
block made one space, trimmed, joined by one line end; nothing is cut. Null or empty
pages have an empty text. A null URL, or one without ``://``, has the empty host, whose
pages are merged like any other host's. Repeated rows are extracted alike. Other columns
are carried, but ``text`` and ``n_chars`` among them are replaced. An empty table gives an
empty result. A page is read in one pass with work and memory in proportion to its length,
however deep it nests and whatever it leaves unclosed.

Statistics are added up per (host, node, text) before anything meets in one place, so a
host with a third of all pages is no hot spot; one task then sees a host's nodes, not its
pages. The nodes to remove are broadcast if their counted size allows, else joined by host.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from onomast.llm._common import materialise, maybe_broadcast, without
from onomast.llm.urlfilter import host

THRESHOLD, GAMMA, DOMINANT, SHARE = 0.2, 0.9, 0.6, 0.5
#: Size up to which the nodes to remove are broadcast, in bytes.
PLAN_BYTES = 8 << 20

#: Fixed values of HTML: elements without content, with raw text, that are blocks, that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas video audio select xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption caption".split())
NOISE_TAGS = frozenset("head nav aside footer form button label fieldset menu dialog search".split()) | RAW
MAIN_TAGS = frozenset(["article", "main"])
HEADINGS = frozenset(["h1"])
#: Words of a class, id or role that mark what is not the article.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense alert announcement breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer form gdpr login menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split())
#: Only noise outside an article, where they may be parts of it.
OUTER_WORDS = frozenset("header banner masthead".split())
#: Say nothing besides other words of a name.
NEUTRAL_WORDS = frozenset("area bar block body box bottom button buttons container content inner item items left link links list outer panel right section slot top unit wrap wrapper".split())
_NAMING = NOISE_WORDS | OUTER_WORDS | NEUTRAL_WORDS

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _key(parent: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{name}".encode(), digest_size=8).digest(), "little", signed=True)


_keys: dict[tuple[int, str], int] = {}


def key(parent: int, name: str) -> int:
    found = _keys.get((parent, name))
    if found is None:
        if len(_keys) > 100_000:
            _keys.clear()
        found = _keys[parent, name] = _key(parent, name)
    return found


class Frame:
    """An open element: where it hangs in the style tree, and what its markup says."""

    __slots__ = ("inside", "mark", "node", "noise", "prose", "tag")

    def __init__(self, tag: str, node: int, noise: int | None, inside: bool, prose: bool, mark: Mark | None):
        self.tag, self.node, self.inside, self.prose, self.mark = tag, node, inside, prose, mark
        self.noise = noise  # the node at which what is noise by its kind begins


class Mark:
    """An element that its words mark as noise, until a main part is found in it."""

    __slots__ = ("above", "holds", "node")

    def __init__(self, above: Mark | None, node: int):
        self.above, self.node, self.holds = above, node, True

    def clear(self) -> None:
        """The marks around a main part say nothing; those above a cleared one are cleared too."""
        at: Mark | None = self
        while at is not None and at.holds:
            at.holds = False
            at = at.above


class Span:
    """A marked inline element that is open: what it holds is dropped if it is closed."""

    __slots__ = ("block", "dropped", "hidden", "mains", "pending")

    def __init__(self, pending: int, mains: int, hidden: bool):
        self.pending, self.mains, self.hidden = pending, mains, hidden
        self.block: int | None = None  # its first block, once the text before it is one
        self.dropped = False


#: What start tags close by themselves: the tags closed, and the tags beyond which they are not looked for.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select", "fieldset"))}
IMPLIED |= {"dd": IMPLIED["dt"], "th": IMPLIED["td"]}


class Page:
    """Blocks of a page, each with its element, and the nodes' child sequences, in one pass."""

    __slots__ = ("_inline", "_open", "_pending", "_plain", "_raw", "_spans", "_stack", "_unsettled", "blocks", "children", "flags", "has_main", "mains", "parents")

    def __init__(self, html: str):
        self.blocks: list[tuple[Frame, str]] = []
        self.children: dict[int, list[str]] = {}
        self.parents: dict[int, int] = {}
        self.flags: dict[int, int] = {}  # 1: prose, 2: a main heading
        self.has_main, self.mains = False, 0
        self._stack = [Frame("", key(0, ""), None, False, False, None)]
        self._open: dict[str, list[int]] = {}  # places in the stack, by tag
        self._inline: dict[str, list[Span | None]] = {}  # open inline elements, from the first marked one on
        self._spans: list[Span] = []  # open marked ones, in order
        self._unsettled: list[Span] = []  # those that begin within the pending text
        self._pending: list[str] = []
        self._raw: list[tuple[Frame, str, bool]] = []  # blocks as written; whether they go on from the one before
        self._plain = False  # quotes are broken: a tag ends at the next >
        doubtful: list[Mark] = []  # around articles
        self._read(html, doubtful)
        self._flush()
        self._settle()
        if doubtful and not self.has_main:
            self.has_main = True
            for mark in doubtful:
                mark.clear()

    def _flush(self) -> None:
        pending, at = self._pending, 0
        for span in self._unsettled:  # what a marked element holds may yet be dropped
            self._raw.append((self._stack[-1], "".join(pending[at : span.pending]), at > 0))
            span.block, at = len(self._raw), span.pending
        if pending:
            self._raw.append((self._stack[-1], "".join(pending[at:] if at else pending), bool(self._unsettled)))
            self._pending = []
        self._unsettled = []

    def _settle(self) -> None:
        """The blocks: what was parted for the sake of marked elements is one again."""
        raw, self._raw = self._raw, []
        i = 0
        while i < len(raw):
            frame, parts = raw[i][0], [raw[i][1]]
            i += 1
            while i < len(raw) and raw[i][2] and raw[i][0] is frame:
                parts.append(raw[i][1])
                i += 1
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                self.blocks.append((frame, text))

    def _tag_end(self, html: str, at: int) -> int:
        """The place of the > that ends a tag, past quoted values; -1 if there is none."""
        if not self._plain:
            i = at
            while m := _STOP.search(html, i):
                if m[0] == ">":
                    return m.start()
                i = html.find(m[0], m.end()) + 1
                if not i:
                    break
            self._plain = True
        return html.find(">", at)

    def _read(self, html: str, doubtful: list[Mark]) -> None:
        at, size = 0, len(html)
        while at < size:
            m = _OPEN.search(html, at)
            if m is None:
                self._pending.append(html[at:])
                return
            if m.start() > at:
                self._pending.append(html[at : m.start()])
            if m[2] is None:
                comment = m[0] == "<!--"
                close = html.find("-->" if comment else ">", m.end())
                at = size if close < 0 else close + (3 if comment else 1)
                continue
            close = self._tag_end(html, m.end())
            if close < 0:  # no tag ends any more
                self._pending.append(html[m.start() :])
                return
            rest, tag, at = html[m.end() : close], m[2].lower(), close + 1
            if m[1]:
                self._end(tag)
            elif tag in RAW and not rest.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s>/])", re.I).search(html, at)
                close = -1 if end is None else html.find(">", end.end())
                at = size if close < 0 else close + 1
                self._pending.append(" ")
            elif tag == "br":
                self._pending.append(" ")
            elif tag == "hr":
                self._flush()
            elif tag not in VOID:
                attributes = self._attributes(rest) if len(rest) > 1 else None
                if tag in BLOCK:
                    self._start(tag, attributes, doubtful)
                else:
                    self._start_inline(tag, attributes)

    def _start_inline(self, tag: str, attributes) -> None:
        top = self._stack[-1]
        hidden = bool(attributes) and attributes[2]
        if hidden or (attributes and (attributes[1] or (attributes[4] and not top.inside))):
            span = Span(len(self._pending), self.mains, hidden)
            self._inline.setdefault(tag, []).append(span)
            self._spans.append(span)
            self._unsettled.append(span)
        elif tag in self._inline:
            self._inline[tag].append(None)

    def _end(self, tag: str) -> None:
        """An end tag closes up to its start tag, if that is open."""
        if tag in BLOCK:
            if self._open.get(tag):
                self._flush()
                self._cut(self._open[tag][-1])
            elif tag == "p":
                self._flush()
        elif opened := self._inline.get(tag):
            span = opened.pop()
            if span is not None and not span.dropped:
                self._close(span)
            if not opened:
                del self._inline[tag]

    def _close(self, span: Span) -> None:
        """Drop what the element held, unless that is a main part; elements open inside are over as well."""
        drop = span.hidden or span.mains == self.mains
        while True:
            last = self._spans.pop()
            last.dropped = True
            if self._unsettled and self._unsettled[-1] is last:
                self._unsettled.pop()
            if last is span:
                break
        if drop and span.block is None:
            del self._pending[span.pending :]
        elif drop:
            del self._raw[span.block :]
            self._pending.clear()
        if drop:
            self._pending.append(" ")

    def _cut(self, place: int) -> None:
        for frame in self._stack[place:]:
            self._open[frame.tag].pop()
        del self._stack[place:]

    def _imply(self, tag: str) -> None:
        """Close what a start tag closes by itself: p before a block; li, dt, dd, tr, td, option."""
        if self._stack[-1].tag == "p":
            self._cut(len(self._stack) - 1)
        if tag in IMPLIED:
            last = [max((self._open[t][-1] for t in tags if self._open.get(t)), default=0) for tags in IMPLIED[tag]]
            if last[0] > last[1]:
                self._cut(last[0])

    def _start(self, tag: str, attributes, doubtful: list[Mark]) -> None:
        self._flush()
        self._imply(tag)
        top = self._stack[-1]
        name = tag + ("." + attributes[0] if attributes and attributes[0] else "")
        node = key(top.node, name)
        self.children.setdefault(top.node, []).append(name)
        self.parents[node] = top.node
        if tag in PROSE:
            self.flags[node] = 1 | 2 * (tag in HEADINGS)
        starts_main = tag in MAIN_TAGS or bool(attributes and attributes[3])
        marked = bool(attributes) and (attributes[1] or (attributes[4] and not top.inside))
        noise = top.noise
        if noise is None and (tag in NOISE_TAGS or bool(attributes and attributes[2]) or (tag == "header" and not top.inside)):
            noise = node
        mark = Mark(top.mark, node) if marked and not starts_main and tag not in ("html", "body") else top.mark
        main = starts_main and noise is None
        self.mains += starts_main
        if main:
            if tag != "article" and mark is not None:
                mark.clear()
            if mark is not None and mark.holds:
                doubtful.append(mark)
            else:
                self.has_main = True
        prose = starts_main or (tag in PROSE and not (attributes and attributes[0]))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(Frame(tag, node, noise, top.inside or main, prose, mark))

    @staticmethod
    def _attributes(source: str):
        """Normalised class and id, named as noise, hidden, marks the main part, named as noise outside it."""
        names, noise, hidden, main, outer = [], False, False, False, False
        for a in _ATTRIBUTE.finditer(source):
            what, value = a[1].lower(), (a[2] or "").strip("\"'")
            if what in ("class", "id"):
                parts = _CAMEL.sub("-", value).lower()
                names.append("".join(c for c in parts if not c.isdigit()))
                for name in parts.split():
                    words = {w for w in _WORD.findall(name) if len(w) > 1}
                    if words <= _NAMING:
                        noise = noise or bool(words & NOISE_WORDS)
                        outer = outer or bool(words & OUTER_WORDS)
            elif what == "role":
                noise = noise or value.lower() in NOISE_WORDS
                outer = outer or value.lower() in OUTER_WORDS
                main = main or value.lower() == "main"
            elif what == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            else:
                hidden = hidden or value.lower() != "false"
        return "|".join(names), noise, hidden, main, outer

    def features(self) -> Iterator[tuple[int, int, int, int]]:
        """(node, kind, feature, size): a style (0) once per page and node, the node above (2, and its
        flags more); each different text (1) with its code points."""
        texts: dict[int, set[str]] = {}
        for frame, text in self.blocks:
            texts.setdefault(frame.node, set()).add(text)
        for node in {key(0, ""), *self.parents}:
            names = self.children.get(node, ())
            yield node, 0, key(node, ">".join(n for i, n in enumerate(names) if not i or names[i - 1] != n)), 0
            if node in self.parents:
                yield node, 2 + self.flags.get(node, 0), self.parents[node], 0
        for node, found in texts.items():
            for text in found:
                yield node, 1, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True), len(text)

    def _marked(self, frame: Frame) -> bool:
        return frame.noise is not None or (self.has_main and not frame.inside) or (frame.mark is not None and frame.mark.holds)

    def text(self, low: frozenset | set = frozenset(), main: int | None = None) -> str:
        """The text without nodes in ``low``; ``main``: the host's main branch, without which markup decides."""
        if main is None:
            return "\n".join(text for frame, text in self.blocks if not self._marked(frame))
        within: dict[int, bool] = {main: True}

        def under(node: int | None) -> bool:
            chain = []
            while node is not None and node not in within:
                chain.append(node)
                node = self.parents.get(node)
            found = node is not None and within[node]
            within.update(dict.fromkeys(chain, found))
            return found

        out = []
        for frame, text in self.blocks:
            if under(frame.node):
                if frame.node in low and not frame.prose:
                    continue
                # markup above the main branch is overruled
                if (frame.noise is not None and under(frame.noise)) or (frame.mark is not None and frame.mark.holds and frame.mark.node != main and under(frame.mark.node)):
                    continue
            elif frame.node in low or self._marked(frame):
                continue
            out.append(text)
        return "\n".join(out)


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for name, html, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            for feature in Page(html.as_py() or "").features():
                found[name, *feature] += weight
                if len(found) > 200_000:
                    yield _counts(found)
                    found = Counter()
        yield _counts(found)


def _counts(found: Counter) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], [], [], []]
    return pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int32()), pa.array(list(found.values()), pa.float64())], ["host", "node", "kind", "feature", "size", "n"])


def tree(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """The statistics of every node of every host's style tree.

    ``host, node, parent, flags, pages, styles, shown`` (presentation importance), ``content``
    (mean content importance of its texts, null without), ``chars`` and ``logs``: the sums of
    code points and of code points times log(pages) over all occurrences of its texts.
    """
    given = pages.select(host(F.col(f"`{url}`")).alias("host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    same = ["host", "digest", "length"]
    given = given.withColumns({"digest": F.xxhash64("html"), "length": F.length("html")})
    copies = materialise(given.groupBy(*same).count().filter("count > 1"))
    given = given.join(maybe_broadcast(copies, 96), same, "left").select("host", "html", (1.0 / F.coalesce("count", F.lit(1))).alias("weight"))
    seen = given.mapInArrow(_observe, "host string, node long, kind int, feature long, size int, n double")
    # the weights of all copies of a page add up to 1, so each sum is a whole number
    seen = seen.groupBy("host", "node", "kind", "feature").agg(F.round(F.sum("n")).alias("n"), F.max("size").alias("size"))
    logs, style, text, up = F.log("n"), F.col("kind") == 0, F.col("kind") == 1, F.col("kind") >= 2
    node = seen.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.sum(F.when(style, F.col("n") * logs)).alias("nlogn"),
        F.count(F.when(style, 1)).alias("styles"),
        F.avg(F.when(text, logs)).alias("mean_log"),
        F.coalesce(F.sum(F.when(text, F.col("n") * F.col("size"))), F.lit(0.0)).alias("chars"),
        F.coalesce(F.sum(F.when(text, F.col("n") * F.col("size") * logs)), F.lit(0.0)).alias("logs"),
        F.max(F.when(up, F.col("feature"))).alias("parent"),
        F.coalesce(F.max(F.when(up, F.col("kind") - 2)), F.lit(0)).alias("flags"),
    )
    base = F.log("pages")
    # entropy of the styles over log m: (log m - sum(n log n) / m) / log m
    shown = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), (base - F.col("nlogn") / F.col("pages")) / base)).otherwise(F.lit(1.0))
    content = F.when(F.col("mean_log").isNotNull(), F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("mean_log") / base)).otherwise(F.lit(1.0)))
    return node.select("host", "node", "parent", "flags", F.col("pages").cast("long").alias("pages"), "styles", shown.alias("shown"), content.alias("content"), "chars", "logs")


class Host:
    """A host's style tree: importance of its nodes, its main branch, and what is noise.

    ``rows``: (node, parent, flags, pages, styles, shown, content, chars, logs).
    """

    def __init__(self, rows: list[tuple], threshold: float = THRESHOLD):
        self.of = {r[0]: r for r in rows}
        self.below: dict[int, list[int]] = {}
        for r in rows:
            if r[1] is not None and r[1] in self.of:
                self.below.setdefault(r[1], []).append(r[0])
        root = key(0, "")
        self.order = [root] if root in self.of else []
        for node in self.order:  # each node before those below it
            self.order.extend(self.below.get(node, ()))
        pages = self.of[root][3] if self.order else 0
        self.main: int | None = None
        self.low: list[int] = []
        self.importance: dict[int, float] = {}
        self.information: dict[int, float] = {}
        if pages < 2:
            return
        size: dict[int, float] = {}
        for node in reversed(self.order):
            _, _, _, _, styles, shown, content, chars, logs = self.of[node]
            under = self.below.get(node, ())
            self.information[node] = max(0.0, chars - logs / math.log(pages)) + sum(self.information[c] for c in under)
            size[node] = chars + sum(size[c] for c in under)
            parts = [(chars, content)] if content is not None else []
            parts += [(size[c], self.importance[c]) for c in under]
            total = sum(w for w, _ in parts)
            inner = sum(w * x for w, x in parts) / total if total else sum(x for _, x in parts) / len(parts) if parts else shown
            weight = GAMMA**styles
            self.importance[node] = (1 - weight) * shown + weight * inner
        self._choose(root)
        if self.main is not None:
            self._prune(threshold)

    def _choose(self, root: int) -> None:
        """Follow the information from the root: the branch that ends outside ``html`` and ``body`` is the main one."""
        at, depth = root, 0
        while self.information[at] > 0:
            best = max(self.below.get(at, ()), key=lambda c: (self.information[c], c), default=None)
            if best is None or self.of[best][2] & 1 or self.information[best] < DOMINANT * self.information[at]:
                break
            at, depth = best, depth + 1
        if depth and at not in {key(root, "html"), key(root, "body"), key(key(root, "html"), "body")}:
            self.main = at

    def _prune(self, threshold: float) -> None:
        inside, kept = {self.main}, set()
        for node in self.order:
            if self.of[node][1] in inside:
                inside.add(node)
        whole = self.information[key(0, "")]
        for node in reversed(self.order):
            value = self.importance[node]
            if node not in inside and not self.of[node][2] & 2:
                value *= min(1.0, self.information[node] / whole / SHARE)
            if value >= threshold or node == self.main or any(c in kept for c in self.below.get(node, ())):
                kept.add(node)
        self.low = [node for node in self.order if node not in kept]


def _plans(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, mains, lows = [], [], []
            for name, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Host([tuple(r.values()) for r in rows.as_py()], threshold)
                if found.main is not None:
                    names.append(name)
                    mains.append(found.main)
                    lows.append(found.low)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(mains, pa.int64()), pa.array(lows, pa.list_(pa.int64()))], ["host", "main", "low"])

    return run


def plans(pages: DataFrame, *, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """``host, main, low`` of each host that its tree decides: the main branch and the nodes to remove."""
    rows = F.collect_list(F.struct("node", "parent", "flags", "pages", "styles", "shown", "content", "chars", "logs"))
    return tree(pages, url=url, html=html).groupBy("host").agg(rows.alias("t")).mapInArrow(_plans(threshold), "host string, main long, low array<long>")


def extract(pages: DataFrame, *, url: str = "url", html: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """All columns but the page itself, with ``text`` and ``n_chars`` (code points)."""
    spark = pages.sparkSession
    plan = materialise(plans(pages, url=url, html=html, threshold=threshold))
    size = plan.agg(F.sum(F.size("low") * 8 + F.length("host") + 64)).first()[0] or 0
    kept = without(pages.drop(html), "text", "n_chars")
    names = kept.columns
    n = len(names)
    given = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{html}`").alias("html"), host(F.col(f"`{url}`")).alias("host"))
    shared = None
    if size <= PLAN_BYTES:
        shared = spark.sparkContext.broadcast({r["host"]: (frozenset(r["low"]), r["main"]) for r in plan.collect()})  # PLAN_BYTES at most
    else:
        given = given.join(plan, "host", "left").select(*[f"c{i}" for i in range(n)], "html", "host", "main", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else {}
        for batch in batches:
            texts = []
            for i, (page, name) in enumerate(zip(batch.column(n), batch.column(n + 1).to_pylist(), strict=True)):
                if shared is None and name not in known:
                    if len(known) > 64:
                        known.clear()
                    known[name] = (frozenset(batch.column(n + 3)[i].as_py() or ()), batch.column(n + 2)[i].as_py())
                low, main = known.get(name, (frozenset(), None))
                texts.append(Page(page.as_py() or "").text(low, main))
            yield pa.record_batch([*batch.columns[:n], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*[f"c{i}" for i in range(n)], "text", "n_chars"])

    schema = T.StructType([*[T.StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(names)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return given.mapInArrow(run, schema).toDF(*names, "text", "n_chars")
