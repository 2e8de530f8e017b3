"""Main text of web pages: what the kind of an element gives away, and what a site repeats, goes; the article stays.

Every page is parsed twice in the tasks that read it, and no page is shuffled.  The first
pass takes off elements whose tag, role, class or id tells what they are (menus, forms,
comments, ...), hashes the remaining element subtrees that may be a template's, and sends
(host, hash, kin) on, where kin is the least hash of the page's word triples: copies and
most near copies of a page have one kin.  Spark counts distinct kins, so a subtree counts by
the unrelated pages it is on, and an article of which a site holds a thousand copies is no template.
The second pass deletes subtrees that are on many unrelated pages of their host.

A host's list of template hashes is bounded: each is on at least ``SHARE`` of its pages.
The lists are broadcast if there are few (``BROADCAST`` hashes, counted first), else joined by host.

What a page's author put into its article as plain prose (paragraphs, headings, quotes
without a class) is never taken for a template, however often it recurs.  Null and empty
pages give empty texts; a null or unreadable address counts as host ``""``; rows with equal
ids or addresses are pages of their own; an empty table gives an empty table.  Unclosed and
misnested tags are closed as browsers do; texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import cut, free_name, small_batches

#: A subtree is a template's if it is on so many unrelated pages of its host, and on this share of them; plain prose outside an article needs the second share.
LEAST, SHARE, PROSE_SHARE = 4, 0.05, 0.5
BROADCAST = 500_000

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?|</[^>]*>?|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?""", re.S
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOLD = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title svg template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = _HEADING | frozenset("p blockquote pre li dd dt td th tr tbody thead tfoot table ul ol dl figcaption figure caption".split())
_SCOPE = frozenset("html table td th caption marquee object applet".split())
_IN_HEAD = frozenset("title meta link style script base noscript template".split())
#: A start tag closes an open element of the first set unless one of the second stands between.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

_DROP = frozenset("head nav header footer aside form dialog menu search button select option datalist input object embed audio video canvas map progress meter".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
_COMMENT = frozenset("comment comments commentlist commentarea disqus respond replies responses".split())
_NAMED = _COMMENT | frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adsbygoogle alert alerts aside banner banners breadcrumb breadcrumbs ccpa consent cookie
    cookies copyright disclaimer footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications overlay pager
    pagination paywall popup popups promo promos promoted promotion rail recommendations recommended related search searchbox share sharebar sharing sidebar signin signup skip
    skiplink social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar trending widget widgets""".split()
)
_LAYOUT = frozenset("no has with without is show hide".split())
_BOX = frozenset("div section ul ol dl table aside details".split())
_PLACE = frozenset("area bar block bottom box buttons col column container content form group inner items left links list main outer panel posts right row section slot thread top unit wrap wrapper".split())


def _named(attrs: dict[str, str], tag: str) -> frozenset[str]:
    """The words in class and id that tell what an element is; an id may be a heading's words, so it must say little else."""
    if tag in _HEADING:
        return frozenset()
    found = set()
    for name in attrs.get("class", "").split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in _LAYOUT:
            found |= {parts[0], parts[-1]} & _NAMED
    parts = [p.lower() for p in _PARTS.findall(attrs.get("id", ""))] if tag in _BOX else []
    if parts and parts[0] not in _LAYOUT:
        found |= {parts[-1]} & _NAMED
        if len(parts) == 1 or parts[1] in _PLACE or parts[1].isdigit():
            found |= {parts[0]} & _NAMED
    return frozenset(found)


class Page:
    """A parsed page: nodes in document order and events (open ``i``, close ``~i``, or a text)."""

    def __init__(self, source: str):
        self.tags: list[str] = ["html"]
        self.parent: list[int] = [-1]
        self.label: list[str] = [""]
        self.dropped: list[int] = [0]  # 1 by a name, 2 by its tag or role, 3 as comments
        self.main: list[bool] = [False]
        self.events: list[int | str] = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        tags, events, stack, at, low = self.tags, self.events, [0], 0, None
        body = False

        def close(depth: int) -> None:
            while len(stack) > depth:
                events.append(~stack.pop())

        def found(names: set | frozenset, barrier: set | frozenset) -> int:
            for d in range(len(stack) - 1, 0, -1):
                t = tags[stack[d]]
                if t in names:
                    return d
                if t in barrier:
                    return 0
            return 0

        def text(a: int, b: int) -> None:
            piece = source[a:b]
            if piece:
                if tags[stack[-1]] == "head" and not piece.isspace():
                    close(len(stack) - 1)
                events.append(html.unescape(piece) if "&" in piece else piece)

        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                text(at, end)
                break
            if m.start() > at:
                text(at, m.start())
            at = m.end()
            kind = m.lastgroup
            if kind == "end":
                tag = m["end"].lower()
                if tag == "br":
                    events.append(" ")
                elif tag in _BLOCK or tag == "head":
                    d = 0 if tag in ("html", "body") else found({tag}, _SCOPE - {tag})
                    if d:
                        close(d)
                    elif tag == "p":
                        events += [self._node("p", "", stack[-1]), ~(len(tags) - 1)]
                else:
                    d = found({tag}, _BLOCK)
                    if d:
                        close(d)
            elif m["tag"]:
                tag = m["tag"].lower()
                if tag == "html" or (tag == "body" and body):
                    continue
                body = body or tag == "body"
                if tags[stack[-1]] == "head" and tag not in _IN_HEAD:
                    close(len(stack) - 1)
                if tag in _BLOCK:
                    d = found({"p"}, _SCOPE)
                    if d:
                        close(d)
                    if tag in _CLOSES:
                        d = found(*_CLOSES[tag])
                        if d:
                            close(d)
                if tag == "br":
                    events.append(" ")
                elif tag in _VOID:
                    if tag in _BLOCK:
                        events += [self._node(tag, "", stack[-1]), ~(len(tags) - 1)]
                elif tag in _RAW:
                    if not m["attrs"].endswith("/") or tag != "svg":
                        low = low or source.lower()
                        low = low if len(low) == end else re.sub("[A-Z]", lambda x: x[0].lower(), source)
                        stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)").search(low, at)
                        at = end if stop is None else (source.find(">", stop.end()) + 1 or end)
                else:
                    events.append(self._node(tag, m["attrs"], stack[-1]))
                    stack.append(len(tags) - 1)
        close(0)

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        label, drop, main = "", 2 if tag in _DROP else 0, tag in ("article", "main")
        if attrs and not attrs.isspace():
            told = {n.lower(): a or b or c for n, a, b, c in reversed(_ATTR.findall(attrs)) if n.lower() in _TOLD}
            if told:
                label = f"{told.get('class', '')} {told.get('id', '')} {told.get('role', '')}".strip()
                role = told.get("role", "").lower()
                named = _named(told, tag)
                if role in _ROLES or "hidden" in told or told.get("aria-hidden", "").lower() == "true" or "display:none" in told.get("style", "").lower().replace(" ", ""):
                    drop = 2
                elif named and tag not in ("body", "html", "main"):
                    drop = 3 if named & _COMMENT else max(drop, 1)
                main = main or role == "main" or told.get("itemprop", "").lower() == "articlebody"
        self.tags.append(tag)
        self.parent.append(parent)
        self.label.append(label)
        self.dropped.append(drop)
        self.main.append(main)
        return len(self.tags) - 1

    def settle(self) -> None:
        """Find the roots of the article, and pardon what only seems droppable: what an article stands in, and what holds most of the page."""
        tags, parent, dropped, n = self.tags, self.parent, self.dropped, len(self.tags)
        inside = [0] * n  # whether dropped by itself or an element around it; in document order parents come first
        comments = [False] * n
        for i in range(1, n):
            inside[i] = dropped[i] or inside[parent[i]]
            comments[i] = dropped[i] == 3 or comments[parent[i]]
        mains = [i for i in range(1, n) if self.main[i] and not dropped[i]]
        clean = [i for i in mains if not inside[i]]
        if not clean:
            clean = [i for i in mains if not comments[i]]
            for i in clean:
                while (i := parent[i]) > 0:
                    dropped[i] = 0
        articles = [i for i in clean if tags[i] != "main"] or clean
        within = [False] * n
        self.roots = set()
        chosen = set(articles)
        for i in range(1, n):
            up = parent[i]
            within[i] = within[up] or up in chosen
            if i in chosen and not within[i]:
                self.roots.add(i)
        self.within = within
        if not self.roots and 1 in dropped:
            size, stack, seen = [0] * n, [], 0
            for e in self.events:
                if isinstance(e, str):
                    seen += len(e) - e.count(" ")
                elif e >= 0:
                    stack.append(seen)
                else:
                    size[~e] = seen - stack.pop()
            for i in range(1, n):
                if dropped[i] == 1 and 2 * size[i] > size[0]:
                    dropped[i] = 0

    def _candidate(self, i: int) -> int:
        """0: never a template, 1: plain prose outside an article, 2: other."""
        tag = self.tags[i]
        if tag not in _BLOCK or tag in ("html", "body") or i in self.roots:
            return 0
        if not self.within[i]:
            return 1 if tag in _PROSE and not self.label[i] else 2
        return 2 if self.label[i] and tag not in _PROSE else 0

    def hashes(self) -> dict[int, tuple[int, int]]:
        """(hash, class) of the kept subtrees that may be templates, by node."""
        out: dict[int, tuple[int, int]] = {}
        open_parts: list[list[str]] = []
        skip, depth = 0, 0
        for e in self.events:
            if isinstance(e, str):
                if depth and not skip:
                    words = e.split()
                    if words:
                        open_parts[-1].append(" ".join(words))
                continue
            i = e if e >= 0 else ~e
            if e >= 0:
                depth += 1
                if skip or self.dropped[i]:
                    skip += 1
                elif self.tags[i] in _BLOCK:
                    open_parts.append([])
            else:
                depth -= 1
                if skip:
                    skip -= 1
                elif self.tags[i] in _BLOCK:
                    parts = open_parts.pop()
                    if parts:
                        kind = self._candidate(i)
                        name = int.from_bytes(blake2b("\x1f".join((self.tags[i], self.label[i], *parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) | 1
                        if kind:
                            out[i] = name, kind
                        if open_parts:
                            open_parts[-1].append(f"\x1e{name}")
        return out

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the article, one a line."""
        gone = {i for i, (h, _) in self.hashes().items() if h in templates} if templates else set()
        for roots in (self.roots, {0}) if self.roots else ({0},):
            lines = self._blocks(roots, gone)
            if lines:
                return "\n".join(lines)
        return ""

    def _blocks(self, roots: set[int], gone: set[int]) -> list[str]:
        lines: list[str] = []
        now: list[str] = []
        skip = inside = bare = heading = 0

        def flush() -> None:
            line = " ".join("".join(now).split())
            now.clear()
            if line:
                lines.append(line)

        tags, dropped, within = self.tags, self.dropped, self.within
        for e in self.events:
            if isinstance(e, str):
                if inside and not skip and (not bare or heading):
                    now.append(e)
                continue
            opens = e >= 0
            i = e if opens else ~e
            tag = tags[i]
            if tag in _BLOCK and now:
                flush()
            # an article's own header keeps its headings
            own_header = tag == "header" and within[i] and dropped[i] == 2 or dropped[i] == 1 and within[i] and not self.main[i] and _is_header(self.label[i])
            if skip or (dropped[i] and not own_header) or i in gone:
                skip += 1 if opens else -1
                continue
            step = 1 if opens else -1
            if i in roots:
                inside += step
            if own_header:
                bare += step
            if tag in _HEADING:
                heading += step
        flush()
        return lines

    def kin(self) -> int:
        """The least hash of three neighbouring words of the article: alike for copies and most near copies."""
        words = self.text().encode("utf-8", "surrogatepass").split()
        h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        if len(h) < 3:
            return int(h.sum()) if len(h) else 0
        with np.errstate(over="ignore"):
            h = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return int(h.min() >> np.uint64(1))


def _is_header(label: str) -> bool:
    return any((parts := _PARTS.findall(name)) and parts[-1].lower() == "header" for name in label.split())


def parsed(source: str | None) -> Page:
    page = Page(source or "")
    page.settle()
    return page


def host(url: str | Column) -> Column:
    """The host of an address in lower case; none: an empty string."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, hashes): the subtrees on many unrelated pages of their host."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, names, kinds, kins = [], [], [], []
            for h, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parsed(s.as_py())
                found = {(0, 0), *page.hashes().values()}
                hosts += [h] * len(found)
                names += [x[0] for x in found]
                kinds += [x[1] for x in found]
                kins += [page.kin()] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.int64()), pa.array(kinds, pa.int32()), pa.array(kins, pa.int64())], ["host", "name", "kind", "kin"])

    rows = pages.select(host(url).alias("host"), source).mapInArrow(seen, "host string, name long, kind int, kin long")
    counted = cut(rows.distinct().groupBy("host", "name", "kind").agg(F.count(F.lit(1)).alias("n")))
    of_host = counted.where("kind = 0").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("kind") == 1, F.lit(PROSE_SHARE)).otherwise(F.lit(SHARE))
    many = (F.col("n") >= LEAST) & (F.col("n") >= share * F.col("pages"))
    return counted.where((F.col("kind") > 0) & (F.col("n") >= LEAST)).join(of_host, "host").where(many).groupBy("host").agg(F.collect_set("name").alias("hashes"))


def extract(pages: DataFrame, url: str = "url", source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``source`` in place of it, in a column ``text``."""
    small_batches(pages.sparkSession)
    lists = cut(templates(pages, url, source))
    name, hashes = free_name(pages, "__host"), free_name(pages, "__hashes")
    lists = lists.select(F.col("host").alias(name), F.col("hashes").alias(hashes))
    size = lists.agg(F.sum(F.size(hashes)).alias("hashes"), F.count(F.lit(1)).alias("hosts")).first()
    if (size["hashes"] or 0) + size["hosts"] <= BROADCAST:
        lists = F.broadcast(lists)
    kept = [c for c in pages.columns if c not in (source, text)]
    joined = pages.withColumn(name, host(url)).join(lists, name, "left").select(*map(F.col, kept), source, hashes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset[int]] = {}
        for batch in batches:
            out = []
            for s, h in zip(batch.column(len(kept)), batch.column(len(kept) + 1), strict=True):
                h = tuple(h.as_py() or ())
                if h and h not in known:
                    known.clear()
                    known[h] = frozenset(h)
                out.append(parsed(s.as_py()).text(known[h] if h else frozenset()).encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(out, pa.binary()).cast(pa.string())], names=[*kept, text])

    schema = ", ".join([*(f"`{c.replace('`', '``')}` {joined.schema[c].dataType.simpleString()}" for c in kept), f"`{text}` string"])
    return joined.mapInArrow(read, schema)
