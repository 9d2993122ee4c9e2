"""HTML extraction with removal of site templates.

Pass one hashes every element's subtree (start tag, text and child hashes, each with a mark of what it is) of every page, and
counts per host on how many different pages each hash stands at its place: the tags around it, its own tag and attributes. Pass two
removes subtrees that recur on MIN_PAGES different pages of their host, if they fill SHARE of the pages that have the place at all, or
are menus (MENU_LINKS links with two thirds of the text): a value that some pages have in common isn't a template, however many
pages the host has. Only regions can be templates (REGIONS_OF): never inline elements, headings, cells, list items or tables, nor
what holds a table or stands inside of a paragraph, heading, item, cell or quotation. Of what is left, tags, roles and classes that name menus, headers, footers, side bars,
notices, adverts, forms, scripts, styles or comments are dropped, and the text of the remaining blocks is joined. The column
n_templates counts the subtrees removed, those inside of others included, n_template_chars their characters (white space aside).

An article is content even where many pages share it: subtrees in `article` or `main`, or around one, are never templates.
Where a page has an `article` or `main` with text, outside of furniture, text outside of it is left out. A class or id that only
describes an element around one (has-sidebar, search-page) drops nothing; one that names a region of its own does (comments,
related-posts). Names that content has too (alert, share, search) drop an element only if it has less than SOFT_CHARS
characters outside of links.

Recurring hashes meet pages by (host, subtree) and go back to the page they stand on, so no page gets more than its own and no
host is one group. Parsing takes time in proportion to the page, whatever it holds: open elements are found by their tag's own
stack, and quotes are looked through for at most TAG characters.

Nulls and odd rows: null or empty html gives an empty text; a null url, or one without a host, counts under the empty host.
Null ids, ties and repeated rows give rows of their own (equal pages are one page in the counts). Extra columns are left out.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import cut, forget, table

MIN_PAGES = 5
SHARE = 0.9
MENU_LINKS = 3
SOFT_CHARS = 400
TAG = 1 << 13

# Names of HTML elements by what they mean here, and words in class, id or role that name furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("script style noscript template svg math iframe object embed canvas audio video head title nav footer aside form button select option textarea dialog menu".split())
MAIN = frozenset(["article", "main"])
WORDS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promotion related sidebar skip social sponsor sponsored subscribe toolbar widget complementary contentinfo".split())
SOFT = frozenset("alert alerts search share sharing".split())
#: Words that name a region even as a part of a longer name, unless one of the words after stands there too.
REGIONS = frozenset("ad ads advert advertisement advertising adverts comment comments disqus promo promotion related sponsor sponsored".split())
DESCRIBES = frozenset("closed enabled disabled free has is layout no open page single template with without".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Starting one of these ends an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article aside body div fieldset figure footer form header html main nav ol section table td th ul blockquote details dialog".split())

#: What can be a template, and what holds content whose parts can't.
REGIONS_OF = frozenset("div section p ul ol center".split())
HOLDERS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption pre blockquote figure figcaption".split())

_OPEN = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in RAW}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Node:
    __slots__ = ("tag", "hash", "drop", "mild", "soft", "main", "start", "has_main", "live", "chars", "around", "place", "inside", "table", "links", "link_chars")

    def __init__(self, tag: str, attributes: str, parent: Node | None, start: int):
        self.tag, self.start, self.has_main, self.live = tag, start, False, False  # live: holds an article or main that isn't dropped
        self.chars = 0  # of text outside of links
        self.links, self.link_chars, self.table = 0, 0, tag == "table"
        self.around = f"{parent.around}>{tag}" if parent is not None and len(parent.around) < TAG else tag  # tags; begun anew where they are very deep
        self.place = xxhash.xxh64_intdigest(f"{self.around} {attributes}") if tag in REGIONS_OF else 0
        self.inside = parent is not None and (parent.inside or parent.tag in HOLDERS)
        self.main = tag in MAIN or parent is not None and parent.main
        self.hash = xxhash.xxh64(f"<{tag} {attributes}>")
        furniture, self.mild, self.soft = self._furniture(tag, attributes)
        self.drop = parent is not None and parent.drop or furniture

    def _furniture(self, tag: str, attributes: str) -> tuple[bool, bool, bool]:
        """Whether it is furniture, whether it is unless it turns out to hold an article or main, and whether it is if it has little text."""
        if tag in FURNITURE:
            return True, False, False
        if tag == "header":
            return not self.main, False, False
        if tag in MAIN or tag in ("html", "body") or "=" not in attributes:
            return False, False, False
        names = [set(filter(None, _SPLIT.split(x))) for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]
        soft = any(len(x) == 1 and x & SOFT for x in names)
        bad = WORDS - {"header"} if self.main else WORDS
        names = [x for x in names if x & bad]
        return any(len(x) == 1 or x & REGIONS and not x & DESCRIBES for x in names), bool(names), soft


class Page:
    """One page: hashes of its subtrees that may be templates, and its text without given templates."""

    def __init__(self, html: str):
        self.html = html
        self.subtrees: list[tuple[int, int, int]] = []  # hash, and first and last piece of text
        self.regions: list[tuple[int, int, bool, int, int]] = []  # of what may be a template: hash, place, whether it is a menu, pieces
        self.texts: list[tuple[str, bool, bool]] = []  # text, kept, main; an empty text ends a block
        self.dropped: list[tuple[int, int]] = []  # first and last piece of text of furniture that is known when it closes
        self._read()

    def _push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def _close(self) -> None:
        """Closes the innermost open element."""
        node = self.stack.pop()
        self.open[node.tag].pop()
        if node.tag in SCOPES:
            self.scopes.pop()
        parent = self.stack[-1] if self.stack else None
        digest = node.hash.intdigest()
        if parent is not None:
            parent.hash.update(b"\2" + digest.to_bytes(8, "little"))
            parent.has_main |= node.has_main or node.tag in MAIN
            parent.live |= node.live
            parent.chars += 0 if node.tag == "a" else node.chars
            parent.table |= node.table
            parent.links += node.links + (node.tag == "a")
            parent.link_chars += node.link_chars + (node.chars if node.tag == "a" else 0)
        if not node.live and (node.mild or node.soft and node.chars < SOFT_CHARS):
            self.dropped.append((node.start, len(self.texts)))
        if not node.main and not node.has_main and node.tag not in ("html", "body"):
            self.subtrees.append((_signed(digest), node.start, len(self.texts)))
            if node.tag in REGIONS_OF and not node.inside and not node.table:
                menu = node.links >= MENU_LINKS and node.link_chars >= 2 * node.chars
                self.regions.append((_signed(xxhash.xxh64_intdigest(digest.to_bytes(8, "little") + node.place.to_bytes(8, "little"))), _signed(node.place), menu, node.start, len(self.texts)))
        if node.tag not in INLINE:
            self.texts.append(("", True, True))

    def _markup(self, at: int, last: int) -> tuple[int, int, str, str, str] | None:
        """Start and end of the next piece of markup, slash, tag and attributes; the tag of comments and declarations is empty.

        last is the page's last >, without which no tag ends."""
        html = self.html
        while m := _OPEN.search(html, at):
            if m[1]:
                end = html.find("-->", m.end())
                return m.start(), end + 3 if end >= 0 else len(html), "", "", ""
            if m.end() > last:
                return None
            if m[3] and (quoted := _QUOTED.match(html, m.end(), min(len(html), m.end() + TAG))):
                return m.start(), quoted.end(), m[2], m[3], quoted[1]
            end = html.find(">", m.end())
            return m.start(), end + 1, m[2] or "", m[3] or "", html[m.end() : end]
        return None

    def _read(self) -> None:
        html, at, texts, last = self.html, 0, self.texts, self.html.rfind(">")
        self.stack: list[Node] = []
        self.open: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        while True:
            found = self._markup(at, last)
            text = html[at : found[0] if found else len(html)]
            top = self.stack[-1] if self.stack else None
            if text:
                if top is not None:
                    bare = text.strip()
                    top.hash.update("\1" + bare)
                    top.chars += len(bare)
                texts.append((text, top is None or not top.drop, top is not None and top.main))
            if not found:
                break
            _, at, end, tag, attributes = found
            if not tag:
                continue
            tag = tag.lower()
            if end:
                if self.open.get(tag):
                    depth = self.open[tag][-1]
                    while len(self.stack) > depth:
                        self._close()
                continue
            if tag in BLOCKS:
                self._imply({"p"})
            if tag in CLOSES:
                self._imply(CLOSES[tag])
            parent = self.stack[-1] if self.stack else None
            if tag not in INLINE:
                texts.append(("", True, True))
            if tag in VOID:
                if parent is not None:
                    parent.hash.update("\3" + tag)
                continue
            node = Node(tag, attributes.strip(), parent, len(texts))
            node.live = tag in MAIN and not node.drop
            self._push(node)
            if tag in RAW:
                stop = _END[tag].search(html, at)
                to = stop.start() if stop else len(html)
                node.hash.update("\1" + html[at:to])
                if not node.drop:
                    texts.append((html[at:to], True, node.main))
                at = to
        while self.stack:
            self._close()

    def _imply(self, tags: set[str]) -> None:
        """Closes the innermost open element of these tags, unless a scope stands between."""
        while True:
            depth = max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)
            if depth < 0 or self.scopes and self.scopes[-1] > depth:
                return
            while len(self.stack) > depth:
                self._close()
            if tags <= {"p"}:
                return

    def text(self, templates: set[int]) -> str:
        """The main text without these regions; afterwards n_templates and n_template_chars tell what they took."""
        marks = np.zeros(len(self.texts) + 1, np.int64)
        for digest, _, _, a, b in self.regions:
            if digest in templates:
                marks[a] += 1
                marks[b] -= 1
        left = np.concatenate(([0], np.cumsum(np.cumsum(marks)[:-1] == 0)))  # pieces that stay before each place
        inside = [left[a] == left[b] for _, a, b in self.subtrees if b > a]
        self.n_templates = int(sum(inside)) if left[-1] < len(self.texts) else 0
        self.n_template_chars = sum(len("".join(self.texts[i][0].split())) for i in np.flatnonzero(np.cumsum(marks)[:-1]))
        for a, b in self.dropped:
            marks[a] += 1
            marks[b] -= 1
        gone = (np.cumsum(marks)[:-1] > 0).tolist()
        return self._joined(gone, True) or self._joined(gone, False)

    def _joined(self, gone: list[bool], only_main: bool) -> str:
        blocks, block = [], []
        for (text, kept, main), away in zip(self.texts, gone, strict=True):
            if not text:
                blocks.append("".join(block))
                block = []
            elif kept and not away and (main or not only_main):
                block.append(unescape(text))
        blocks.append("".join(block))
        return " ".join(" ".join(blocks).split())


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _keyed(pages: DataFrame) -> DataFrame:
    """The pages with __host and __page, a hash of the html."""
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("__host"), F.xxhash64("html").alias("__page"))


def region_hashes(pages: DataFrame) -> DataFrame:
    """Rows (__host, __page, __place, __region, __menu, __first) of the different regions of each page that may be templates; __first is 1
    for one region of each place of the page."""

    def run(batches):
        for b in batches:
            rows, row = [], []
            for i, html in enumerate(b.column("html")):
                found, places = {}, set()
                for digest, place, menu, *_ in Page(html.as_py() or "").regions:
                    if digest not in found:
                        found[digest] = (place, digest, menu, int(place not in places))
                        places.add(place)
                rows += found.values()
                row += [i] * len(found)
            at = pa.array(row, pa.int32())
            place, region, menu, first = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("__host").take(at), b.column("__page").take(at), pa.array(place, pa.int64()), pa.array(region, pa.int64()), pa.array(menu, pa.bool_()), pa.array(first, pa.int32())], names=["__host", "__page", "__place", "__region", "__menu", "__first"])

    return _keyed(pages).select("__host", "__page", "html").mapInArrow(run, "__host string, __page long, __place long, __region long, __menu boolean, __first int")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """__h (host), __p (page) and __templates, the hashes of its regions that recur on the host."""
    seen = cut(region_hashes(pages).distinct(), "regions")
    places = seen.groupBy(F.col("__host").alias("__ho"), F.col("__place").alias("__pl")).agg(F.sum("__first").alias("__all"))
    often = seen.groupBy("__host", "__place", "__region").agg(F.count(F.lit(1)).alias("__n"), F.max("__menu").alias("__m")).where(F.col("__n") >= min_pages)
    often = often.join(places, (F.col("__host") == F.col("__ho")) & (F.col("__place") == F.col("__pl"))).where(F.col("__m") | (F.col("__n") >= F.lit(share) * F.col("__all")))
    often = often.select(F.col("__host").alias("__o"), F.col("__region").alias("__s"))
    own = seen.join(often, (F.col("__host") == F.col("__o")) & (F.col("__region") == F.col("__s")))
    out = cut(own.groupBy(F.col("__host").alias("__h"), F.col("__page").alias("__p")).agg(F.collect_list("__region").alias("__templates")), "templates")
    forget(seen)
    return out


def extract(pages: DataFrame, **options) -> DataFrame:
    """page_id, url, text, n_chars, n_templates and n_template_chars of every page."""
    found = templates(pages, **options)
    # Lists of all pages grow with the pages, so they are never broadcast.
    joined = _keyed(pages).join(found.hint("shuffle_hash"), (F.col("__page") == F.col("__p")) & (F.col("__host") == F.col("__h")), "left")

    def run(batches):
        for b in batches:
            texts, n, chars = [], [], []
            for html, gone in zip(b.column("html"), b.column("__templates"), strict=True):
                page = Page(html.as_py() or "")
                texts.append(page.text(set(gone.as_py() or ())))
                n.append(page.n_templates)
                chars.append(page.n_template_chars)
            counts = [pa.array(x, pa.int64()) for x in ([len(x) for x in texts], n, chars)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_templates", "n_template_chars"])

    return joined.select("page_id", "url", "html", "__templates").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long, n_template_chars long")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
