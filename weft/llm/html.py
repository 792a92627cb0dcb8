"""Main text of web pages by tree scoring.

A page is read once into nodes and blocks of text. Each block gives its container one point, one for every comma and up
to three for length, less its share of link text; a container hands half of its points on to the container around it.
The container with most points, discounted by its own link density, is the main one, or else the article, main or
promising container around it, of which it may be just one section; siblings with enough points, headings and
paragraphs beside it are kept with it. Lists of links inside it go.

Elements that cannot be article text (by tag, role, hidden attributes, or names of class and id that say only so) take
no part. Names that may say so (`related-work`, an article's `header`) leave it to the score: such a part hands on a
quarter of its points, and stays inside the main container if it has hardly any links and either a fair share of the
points or the headline.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship, slices

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body center details div html main section td blockquote".split())
_GONE = frozenset(
    "aside button canvas datalist dialog embed footer form head header iframe input label map menu nav noembed noscript "
    "object script select style svg template textarea title xmp".split()
)
_GONE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Words of class or id that mark what is not the article. Fixed values.
_GONE_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disclaimer discussion disqus footer form gdpr header login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup privacy promo promoted promotion "
    "related replies reply respond share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription teaser toolbar widget widgets".split()
)
#: Words that stand beside those without changing what they say. Fixed values.
_PLAIN_WORDS = frozenset(
    "area article bar block body bottom box button buttons center col column container content entry fixed group inner "
    "item items left link links list main message module outer page panel post posts right row section slot story text "
    "title top unit wrap wrapper zone".split()
)
#: Of the words that mark what is not the article, those that can name a part of one. Fixed values.
_OPEN_WORDS = frozenset("disclaimer discussion header privacy related respond skip".split())
_GOOD_WORDS = frozenset("article body content entry main page post story text".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}}
_CLOSES |= {"td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_TABLE = {"table"}
_P_SCOPE = frozenset("td th table caption button object html body article section div".split())
_CELLS = frozenset("td th table caption".split())
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "parent", "block", "gone", "doubt", "good", "inside", "headline", "points", "chars", "link_chars", "links", "order")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, doubt: bool, good: bool, order: int):
        self.tag, self.parent, self.gone, self.doubt, self.good, self.order = tag, parent, gone, doubt, good, order
        self.inside = tag in ("article", "main") or parent is not None and parent.inside
        self.headline = tag == "h1"
        self.block = self if parent is None or tag in _BLOCK else parent.block
        self.points = 0.0
        self.chars = self.link_chars = self.links = 0


def _judge(tag: str, raw: str, inside: bool) -> tuple[bool, bool, bool]:
    """(boilerplate, perhaps boilerplate, promising) by tag, attributes and whether it stands in an article."""
    doubt = tag == "header" and inside
    if tag in _GONE and not doubt:
        return True, False, False
    if not raw or raw.isspace():
        return False, doubt, False
    gone, good = False, False
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        value = unescape(value.strip("\"'"))
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _WORDS.split(one) if w}
                good |= bool(words & _GOOD_WORDS)
                if marks := words & _GONE_WORDS:
                    rest = {w for w in words - marks - _PLAIN_WORDS if not any(c.isdigit() for c in w)}
                    perhaps = bool(rest) or inside and marks <= _OPEN_WORDS
                    gone, doubt = gone or not perhaps, doubt or perhaps
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False, False
        elif name == "role" and value.strip().lower() in _GONE_ROLES:
            return True, False, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False, False
    if tag in ("html", "body", "article", "main"):
        return False, False, good
    return gone, doubt, good


class _Page:
    def __init__(self, html: str):
        self.root = _Node("html", None, False, False, False, 0)
        self.nodes, self.stack = [self.root], [self.root]
        self.open: Counter = Counter()
        self.blocks: list[tuple[str, _Node]] = []
        self.buffer: list[str] = []
        self.linked, self.in_link = 0, 0
        self._read(html)

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].gone:
            text = unescape(text) if "&" in text else text
            self.buffer.append(text)
            if self.in_link:
                self.linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        """End the block that is being gathered; it belongs to the innermost open block element."""
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        linked, self.buffer, self.linked = self.linked, [], 0
        if not text:
            return
        owner = self.stack[-1].block
        self.blocks.append((text, owner))
        size = len(text)
        linked = min(linked, size)
        owner.chars += size
        owner.link_chars += linked
        owner.links += linked > 0
        owner.points += (1 + text.count(",") + min(size / 100, 3)) * (1 - linked / size)

    def _pop(self) -> None:
        node = self.stack.pop()
        self.open[node.tag] -= 1
        if node.tag == "a":
            self.in_link -= 1

    def _close_to(self, tags, scope) -> None:
        """Close the innermost of these tags and all inside it, unless an element of scope is nearer."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if tag in scope:
                return

    def _start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in _BLOCK:
            self._flush()
            self._close_to(("p",), _P_SCOPE)
            if tag in _CLOSES:
                self._close_to(_CLOSES[tag], _SCOPE.get(tag, _TABLE))
        if tag == "br":
            self._text(" ")
        if tag in _VOID:
            return
        if tag == "a":
            self._close_to(("a",), _CELLS)
            self.in_link += 1
        up = self.stack[-1]
        gone, doubt, good = _judge(tag, raw, up.inside)
        node = _Node(tag, up, up.gone or gone, doubt, good, len(self.nodes))
        self.nodes.append(node)
        self.stack.append(node)
        self.open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if self.open[tag]:
            self._close_to((tag,), () if tag in _CELLS else _CELLS)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if not m:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            close, tag, raw = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            if not tag:
                if m.group().startswith("<![CDATA["):
                    self._text(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower()
            if close:
                self._end(tag)
                continue
            if tag in _RAW:  # its text is no markup
                end = _RAW[tag].search(html, at)
                after = html.find(">", end.end()) if end else -1
                at = after + 1 if after >= 0 else n
                continue
            self._start(tag, raw)
        self._flush()

    @staticmethod
    def _whole(best: _Node) -> _Node:
        """The article that best is a part of: the nearest article or main around it, else the nearest promising
        container, unless that is mostly links."""
        if best.tag in ("article", "main"):
            return best
        around, n = [], best.parent
        while n is not None:
            if n.tag in _CONTAINER and n.link_chars < 0.5 * n.chars:
                around.append(n)
            n = n.parent
        named = [n for n in around if n.tag in ("article", "main")]
        return next(iter(named or [n for n in around if n.good and not n.doubt]), best)

    def text(self) -> str:
        if not self.blocks:
            return ""
        for n in reversed(self.nodes):  # children come after their parents
            if n.parent is not None:
                n.parent.chars += n.chars
                n.parent.link_chars += n.link_chars
                n.parent.links += n.links
                n.parent.headline |= n.headline and n.chars > 0
                n.parent.points += n.points * (0.5 if n.tag in _CONTAINER else 1.0) * (0.25 if n.doubt else 1.0)

        def worth(n: _Node) -> float:
            bonus = 0.25 if n.doubt else 1.25 if n.good or n.tag in ("article", "main") else 1.0
            return n.points * bonus * (1 - n.link_chars / n.chars) if n.chars else 0.0

        scored = [n for n in self.nodes if n.tag in _CONTAINER and n.chars]
        best = max(scored, key=lambda n: (worth(n), n.chars, -n.order), default=self.root)
        least = max(10.0, 0.2 * worth(best))
        best = self._whole(best)
        keep = {id(best)}
        for n in self.nodes:
            if n.parent is best.parent and n is not best and best.parent is not None and n.chars:
                density = n.link_chars / n.chars
                beside = n.tag in ("p", "pre", "h1", "h2", "h3", "blockquote", "ul", "ol", "table") and density < 0.25
                if beside or n.tag in _CONTAINER and worth(n) >= least and density < 0.5:
                    keep.add(id(n))
        state: dict[int, bool] = {}
        for n in self.nodes:  # parents come first
            inside = id(n) in keep or n.parent is not None and state[id(n.parent)]
            if inside and n is not best and n.tag in ("ul", "ol", "dl", "table", "div", "section") and n.links >= 3:
                inside = n.link_chars <= 0.5 * n.chars
            if inside and n is not best and n.doubt:
                inside = n.link_chars <= 0.1 * n.chars and (n.headline or n.points >= 0.05 * best.points)
            state[id(n)] = inside
        loose = [t for t, owner in self.blocks if state[id(owner)]]
        return "\n".join(loose)


def main_text(html: str | None) -> str:
    """The page's main text: blocks in page order, one a line, white space inside a block as one space."""
    return _Page(html or "").text()


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without its html, with text and n_chars (code points).

    Every row gives a row: null and empty html, and pages without text, give the empty text. Repeated rows and null ids
    stay. A page is read whole, in time in proportion to its length. Columns of pages called text or n_chars are
    replaced; an empty table gives no rows.
    """
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*keep, F.col(html_col).alias("html"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            for part, values in slices(batch, "html"):
                texts = [main_text(v.decode("utf-8", "replace")) for v in values]
                columns = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.record_batch(columns, [*keep, "text", "n_chars"])

    return kept.mapInArrow(run, ", ".join(filter(None, [types, "text string, n_chars long"])))


def op5_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op5_tree_scoring": op5_tree_scoring}
SQL: dict[str, str] = {}
