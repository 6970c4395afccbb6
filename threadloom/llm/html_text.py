"""Main text of web pages, with site templates removed.

Every block element is hashed with all that it holds; Spark counts on how many different pages of a host each hash occurs, and
subtrees that recur on many of them are deleted, within articles too. Copies of a story must not count as pages of their own, or they would make
templates of each other's paragraphs: pages whose articles have the same longest block are one.

The story is the <article> or <main> with the most text that isn't in links, if it has STORY of the page's, and else the whole page. From it go: what
HTML says isn't article (menus, forms, asides, ...), templates but for headings, lists of links and short articles where no article is the story, and containers that a class
or id token hints at, unless they hold most of the story. A hint alone never takes a paragraph, a heading or inline text.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged


#: A subtree is a template if at least RECUR different pages of the host have it, and of all of them SHARE or MANY.
RECUR, SHARE, MANY = 3, 0.1, 20
#: The least share of a page's text that makes an article its story; what a hinted container may have of the story;
#: the links and their share of the text that make a list of links.
STORY, HINTED, LINKS, LINKED = 0.25, 0.5, 3, 0.6

# Fixed values of HTML: elements without content, with raw text, that make blocks, and that
# end an open paragraph or an element of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Elements that are never article, wherever they stand; header only outside an article. Controls within a line are left out of it.
NOT_ARTICLE = frozenset("nav footer aside form fieldset dialog menu head search".split())
CONTROLS = frozenset("button select object audio video canvas svg".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose class or id may hint; others are text.
CONTAINERS = frozenset("div section article ul ol dl table figure details center address header hgroup".split())
#: Parts of class and id tokens that hint at what isn't article, and parts that say nothing besides; a token hints if it has one of the first
#: and nothing else than both.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay overlays "
    "newsletter newsletters subscribe sidebar sidebars sidenav nav navbar navigation menu menus breadcrumb breadcrumbs toolbar pagination pager masthead topbar footer footers header related recommended share sharing social "
    "comment comments commentlist disqus replies respond login signup search widget widgets".split()
)
PLAIN = frozenset("slot box wrap wrapper container bar block section area left right top bottom list lists item items inner outer user users site page main unit zone button buttons icon icons link links panel form primary secondary content posts articles stories sticky global reader thread text label".split())
PARTS = regex.compile(r"[-_]+|(?<=[a-z])(?=[A-Z0-9])")
TOKEN = regex.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", regex.S)
ATTRIBUTE = regex.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
SPACE = regex.compile(r"\s+")


def excluded(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether HTML itself or the role says that an element isn't article."""
    return tag in NOT_ARTICLE or (tag == "header" and not in_article) or any(v.lower() in ROLES for name, v in _values(attributes) if name == "role")


def hinted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a container's class or id hints that it isn't article. Headers of an article are its own."""
    if tag not in CONTAINERS:
        return False
    for name, value in _values(attributes):
        for token in value.split() if name != "role" else ():
            parts = {p.lower() for p in PARTS.split(token) if p and not p.isdigit()}
            if parts & MARKS and parts <= MARKS | PLAIN and not (in_article and "header" in parts):
                return True
    return False


def _values(attributes: str) -> Iterator[tuple[str, str]]:
    for m in ATTRIBUTE.finditer(attributes):
        yield m[1].lower(), m[2] or m[3] or m[4] or ""


class _Element:
    """first and end are its blocks; article: it is or is in an <article> or <main>."""

    __slots__ = ("article", "end", "first", "hash", "hint", "out", "tag", "value")

    def __init__(self, tag: str, out: bool, hint: bool, article: bool, first: int):
        self.tag, self.out, self.hint, self.article, self.first, self.end, self.value = tag, out, hint, article, first, first, 0
        self.hash = xxhash.xxh3_64(tag.encode())


class Page:
    """Blocks of a page in order, with how many of their characters and how many links are in links, and its block elements in the order in which they end."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, int, int]] = []
        self.elements: list[_Element] = []
        self.stack: list[_Element] = []
        self.pending: list[tuple[str, bool]] = []
        self.in_link, self.links = False, 0
        self.read(source)

    def read(self, source: str) -> None:
        at, lower = 0, None
        for m in iter(lambda: TOKEN.search(source, at), None):
            self.text(source[at : m.start()])
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self.end(tag)
                continue
            if tag in RAW:
                if not m[3].endswith("/"):
                    lower = lower or source.lower()
                    if len(lower) != len(source):  # lower-casing changed lengths: only ASCII counts for tags
                        lower = source.translate({c: c + 32 for c in range(65, 91)})
                    close = lower.find("</" + tag, at)
                    at = close if close >= 0 else len(source)
                continue
            self.start(tag, m[3])
        self.text(source[at:])
        self.flush()
        while self.stack:
            self.pop()

    def text(self, raw: str) -> None:
        if raw and not (self.stack and self.stack[-1].tag in CONTROLS):
            self.pending.append((raw, self.in_link))

    def flush(self) -> None:
        if not self.pending:
            return
        raw = "".join(t for t, _ in self.pending)
        text = SPACE.sub(" ", html.unescape(raw)).strip()
        if text:
            linked = sum(len(t) for t, link in self.pending if link)
            self.blocks.append((text, min(len(text), linked), self.links))
            if self.stack:
                self.stack[-1].hash.update(text.encode("utf-8", "replace"))
        self.pending.clear()
        self.links = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.in_link, self.links = True, self.links + 1
        if tag in ("br", "td", "th"):
            self.pending.append((" ", False))
        if tag in VOID or (tag not in BLOCKS and tag not in ENDS and tag not in NOT_ARTICLE and tag not in CONTROLS):
            return  # inline: its text belongs to the block around
        if tag not in CONTROLS:
            if tag not in ("td", "th"):
                self.flush()
            if tag in BLOCKS and self.stack and self.stack[-1].tag == "p":
                self.pop()
            if tag in ENDS:
                while self.stack and self.stack[-1].tag in ENDS[tag] | {"p"} and self.stack[-1].tag not in SCOPES[tag]:
                    self.pop()
        above = self.stack[-1] if self.stack else None
        inside = bool(above and above.article)
        self.stack.append(_Element(tag, bool(above and above.out) or excluded(tag, attributes, inside), hinted(tag, attributes, inside), inside or tag in ("article", "main"), len(self.blocks)))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if not any(e.tag == tag for e in self.stack):
            if tag == "p":
                self.flush()
            return
        if tag in ("td", "th"):
            self.pending.append((" ", False))
        elif tag not in CONTROLS:
            self.flush()
        while self.stack:
            if self.pop() == tag:
                break

    def pop(self) -> str:
        if self.stack[-1].tag not in ("td", "th") and self.stack[-1].tag not in CONTROLS:
            self.flush()
        e = self.stack.pop()
        e.end, e.value = len(self.blocks), e.hash.intdigest() - (1 << 63)
        if self.stack and e.tag not in CONTROLS:
            self.stack[-1].hash.update(e.value.to_bytes(8, "little", signed=True))
        if e.end > e.first:
            self.elements.append(e)
        return e.tag

    def subtrees(self) -> set[int]:
        """The hashes of its elements; what HTML says isn't article is gone anyway."""
        return {e.value for e in self.elements if not e.out and e.tag not in ("html", "body")}

    def _mass(self, gone: bytearray) -> list[int]:
        """Running sums of the characters of blocks that aren't in links nor gone."""
        return [0, *accumulate(0 if g else len(t) - linked for (t, linked, _), g in zip(self.blocks, gone))]

    def story(self) -> tuple[_Element | None, bytearray]:
        """The article that is the page's story, if one is, and the blocks that are gone for what HTML says or a class hints at."""
        gone = bytearray(len(self.blocks))
        self._clear(gone, (e for e in self.elements if e.out))
        mass = self._mass(gone)
        articles = [e for e in self.elements if e.tag in ("article", "main") and not (e.hint and e.tag == "article" and any(o.tag == "article" and o.first <= e.first and e.end <= o.end and o is not e for o in self.elements))]
        best = max(articles, key=lambda e: (mass[e.end] - mass[e.first], -e.first), default=None)
        of = lambda e: mass[e.end] - mass[e.first]
        most = of(best) if best else 0
        # a container that is hinted at is spared if it holds the best article, or most of a page without one
        held = lambda e: e.first <= best.first and e.end >= best.end if most else of(e) > HINTED * mass[-1]
        self._clear(gone, (e for e in self.elements if e.hint and not held(e)))
        mass = self._mass(gone)
        return (best if most and of(best) >= STORY * mass[-1] else None), gone

    @staticmethod
    def _clear(gone: bytearray, elements) -> None:
        for e in elements:
            gone[e.first : e.end] = b"\1" * (e.end - e.first)

    def story_key(self) -> int | None:
        """What copies of a story have in common: its longest block."""
        story, gone = self.story()
        texts = [t for t, g in zip(self.blocks[story.first : story.end], gone[story.first : story.end]) if not g] if story else []
        return xxhash.xxh3_64_intdigest(max(texts, key=lambda b: (len(b[0]), b[0]))[0].encode("utf-8", "replace")) - (1 << 63) if texts else None

    def main_text(self, templates: set[int]) -> str:
        """The story's blocks without templates."""
        story, gone = self.story()
        first, end = (story.first, story.end) if story else (0, len(self.blocks))
        whole = lambda e: e.first <= first and e.end >= end and (story is not None or e.tag in ("html", "body"))
        self._clear(gone, (e for e in self.elements if e.value in templates and e.tag not in HEADINGS and not whole(e)))
        if story is None:
            self._clear(gone, (e for e in self.elements if not whole(e) and self._is_links(e)))
            teasers, mass = bytearray(len(self.blocks)), self._mass(gone)
            self._clear(teasers, (e for e in self.elements if e.tag == "article"))
            if sum(n - m for m, n, t in zip(mass, mass[1:], teasers) if t) < STORY * mass[-1]:
                self._clear(gone, (e for e in self.elements if e.tag == "article"))
        return "\n\n".join(t for (t, _, _), g in zip(self.blocks[first:end], gone[first:end]) if not g)

    def _is_links(self, e: _Element) -> bool:
        part = self.blocks[e.first : e.end]
        return sum(n for _, _, n in part) >= LINKS and sum(linked for _, linked, _ in part) >= LINKED * sum(len(t) for t, _, _ in part)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, keys, stories, subtrees = [], [], [], []
        for key, url, source in zip(*(batch.column(c).to_pylist() for c in ("_key", "_url", "_html"))):
            page = Page(source)
            found, story = page.subtrees(), page.story_key()
            subtrees += found
            keys += [key] * len(found)
            stories += [key if story is None else story] * len(found)
            hosts += [xxhash.xxh3_64_intdigest(host_of(url)) - (1 << 63)] * len(found)
        yield pa.record_batch([pa.array(hosts, pa.int64()), pa.array(subtrees, pa.int64()), pa.array(keys, pa.int64()), pa.array(stories, pa.int64())], ["host", "subtree", "_key", "story"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [Page(h.as_py()).main_text(set(t.as_py() or ())) for h, t in zip(part.column("_html"), part.column("_gone"))]
            yield pa.record_batch([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["_id", "_url", "text", "n_chars"])


def page_key(url: Column, source: Column) -> Column:
    """Equal pages have equal keys, so that copies count as one."""
    return F.xxhash64(url, source)


def site_templates(pages: DataFrame) -> DataFrame:
    """_key of a page and _gone, its subtrees that are templates of its host. pages: _key, _url, _html."""
    found = staged(pages.mapInArrow(_hashes, "host long, subtree long, _key long, story long"), "subtrees")
    size = found.select("host", "story").distinct().groupBy("host").agg(F.count("*").alias("_pages"))
    recurring = found.select("host", "subtree", "story").distinct().groupBy("host", "subtree").agg(F.count("*").alias("_on")).where(F.col("_on") >= RECUR)
    templates = recurring.join(size, "host").where((F.col("_on") >= SHARE * F.col("_pages")) | (F.col("_on") >= MANY)).select("host", "subtree")
    return found.join(templates, ["host", "subtree"]).groupBy("_key").agg(F.collect_set("subtree").alias("_gone"))


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each input row: id_col, url_col, text, n_chars (code points).

    Null, empty and unfinished html is read as far as it goes; without article text the text
    is empty. White space within a block becomes one space and blocks are joined by an empty
    line. Repeated rows are kept; a null url belongs to the host ''; null ids are kept. Other
    columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.coalesce(F.col(html_col), F.lit("")).alias("_html")).withColumn("_key", page_key(F.col("_url"), F.col("_html")))
    gone = site_templates(rows.select("_key", "_url", "_html"))
    kind = pages.schema[id_col].dataType.simpleString()
    joined = rows.join(gone.hint("shuffle_hash"), "_key", "left")
    return joined.select("_id", "_url", "_html", "_gone").mapInArrow(_texts, f"_id {kind}, _url string, text string, n_chars long").select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
