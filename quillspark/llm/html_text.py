"""Main text of web pages by composite text density.

Every node of the page's tree gets its link-adjusted characters per tag; the sum over its children tells how much dense
text it holds directly. The node of the largest sum is the core of the article; the smallest density on its path to the
body is the threshold that the other parts of the page, elements or bare text anywhere in it, must reach to belong to it.
Where the core lies in an article or main that holds PLACE_SHARE of the page's text without links, the parts are those of
the outermost such element, and other articles as dense. Parts that never are an article (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) are left out before, by tag, role and class. Words of classes
also stand on wrappers of the article: a word whose elements hold most of the page's text without links names no such part
there (a form around the page, for one), and an element around an article or main of some size isn't one. On paragraphs and
other single texts a word counts only as the whole class. Hidden text and formulas stay.

A null page is an empty one, and has an empty text. Null ids, repeated rows and other columns are kept as they are.
Broken markup is read as browsers do: unclosed elements end with their parents, stray end tags are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold article text.
NEVER = frozenset("script style noscript template head title nav footer aside button select option textarea input iframe object embed svg canvas audio video dialog menu search datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in classes and ids of parts that aren't the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe share sharing social related recommended widget toolbar login signup skip".split()
)
#: Those that hold no article even if they are whole classes of most of the page.
ASIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus cookie cookies consent gdpr newsletter subscribe".split())
#: Share of the page's text without links from which a word of NAMES does not name such parts on the page.
NAME_SHARE = 0.5
#: Elements that name the article's place.
PLACES = frozenset(("article", "main"))
#: Share of the page's text without links from which elements around a named place aren't parts beside the article.
PLACE_SHARE = 0.3
#: Share of the page's density that articles of a page without another core must reach.
TOGETHER = 0.5
HEADINGS, LISTS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol dl".split())
#: Elements whose children make up a text: the core is the nearest of them.
HOLDERS = frozenset("article main div section td center table form".split())
#: Elements that are a block of text of their own: a word in their class names a part only as the whole class.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption caption td th span b i em strong a code".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: No open paragraph lies above these: they would have ended it, or bound its scope.
_HOLDS_NO_P = _CLOSES_P - {"p"} | {"td", "th", "button", "object"}
#: A start tag ends an open element of these kinds, unless one of the second is nearer.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
_WORD = re.compile(r"[a-z0-9]+")
#: Numbers of characters that are none.
_LONG_NUMBER = re.compile("&#(?:[xX][0-9a-fA-F]{20,}|[0-9]{20,});?")
_SHORT_COMMENT, _COMMENT_END = re.compile("<!---?>"), re.compile("--!?>")


class Node:
    __slots__ = ("tag", "up", "items", "skip", "names", "chars", "link_chars", "tags", "link_tags", "density", "total", "holds_block")

    def __init__(self, tag: str, up: Node | None, skip: bool = False):
        self.tag, self.up, self.skip = tag, up, skip
        self.items: list[Node | str] = []
        self.names: set[tuple[str, bool]] | None = None


def _names(tag: str, attrs: list[tuple[str, str | None]]) -> set[tuple[str, bool]] | None:
    """The words of NAMES in classes and ids, and whether each is a whole class or id. A form is one by its tag."""
    out = {("form", False)} if tag == "form" else set()
    for k, v in attrs:
        if v and k in ("class", "id"):
            for x in v.lower().split():
                out |= {(w, w == x) for w in _WORD.findall(x) if w in NAMES and (w == x or tag not in TEXTS)}
    if tag in PLACES:
        out = {(w, whole) for w, whole in out if whole and w in ASIDE}
    return out or None


def _skip_named(root: Node) -> None:
    """Leave out the elements that their classes and ids name as parts beside the article."""
    order, named, todo = [], False, [root]
    while todo:
        n = todo.pop()
        order.append(n)
        named = named or n.names is not None
        todo += [x for x in n.items if type(x) is Node and not x.skip]
    if not named:
        return
    for n in reversed(order):  # chars: without links
        n.chars, n.total = 0, 0.0
        for x in n.items:
            if type(x) is str:
                n.chars += len(x) if not x.isspace() else 0
            elif not x.skip:
                n.chars += x.chars
                n.total = max(n.total, x.total)
        if n.tag == "a":
            n.chars = 0
        if n.tag in PLACES:
            n.total = max(n.total, float(n.chars))
    held: dict[tuple[str, bool], int] = {}
    walk: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while walk:
        n, above = walk.pop()
        if n.names:
            for x in n.names - above:  # the outermost ones
                held[x] = held.get(x, 0) + n.chars
            above = above | n.names
        walk += [(x, above) for x in n.items if type(x) is Node and not x.skip]
    void = {(w, whole) for (w, whole), c in held.items() if c >= NAME_SHARE * root.chars > 0 and not (whole and w in ASIDE)}
    for n in order:
        if n.names and not n.names <= void and not n.total >= PLACE_SHARE * root.chars > 0:
            n.skip = True


class _Tree(HTMLParser):
    """The tree of a page. Marked sections and other declarations are comments up to the next `>`; a comment, a declaration
    or a tag that the page's end cuts off is no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.ending = False
        #: Open elements by tag: below each open place, and in all.
        self.scopes: list[dict[str, int]] = [{}]
        self.open: dict[str, int] = {}

    def close(self) -> None:
        self.ending = True
        super().close()

    def _or_end(self, end: int) -> int:
        return len(self.rawdata) if end < 0 and self.ending else end

    def parse_comment(self, i: int, report: bool = True) -> int:
        if m := _SHORT_COMMENT.match(self.rawdata, i):
            return m.end()
        m = _COMMENT_END.search(self.rawdata, i + 4)
        return self._or_end(m.end() if m else -1)

    def parse_html_declaration(self, i: int) -> int:
        return self._or_end(self.rawdata.find(">", i + 2) + 1 or -1)

    def parse_pi(self, i: int) -> int:
        return self._or_end(self.rawdata.find(">", i + 2) + 1 or -1)

    def parse_starttag(self, i: int) -> int:
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def _open_among(self, wanted: tuple[str, ...] | frozenset[str], stop: tuple[str, ...] | frozenset[str]) -> Node | None:
        if not any(self.open.get(t) for t in wanted):
            return None
        n = self.at
        while n.up is not None and n.tag not in stop:
            if n.tag in wanted:
                return n
            n = n.up
        return None

    def _down(self, node: Node) -> None:
        self.at = node
        self.open[node.tag] = self.open.get(node.tag, 0) + 1
        if node.tag in PLACES:
            self.scopes.append({})
        self.scopes[-1][node.tag] = self.scopes[-1].get(node.tag, 0) + 1

    def _up(self, node: Node) -> None:
        while self.at is not node:
            tag = self.at.tag
            self.open[tag] -= 1
            self.scopes[-1][tag] -= 1
            if tag in PLACES:
                self.scopes.pop()
            self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in _CLOSES_P and (p := self._open_among(("p",), _HOLDS_NO_P)):
            self._up(p.up)
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit() and self.at.tag[0] == "h" and self.at.tag[1:].isdigit():
            self._up(self.at.up)
        if tag in _ENDS and (n := self._open_among(*_ENDS[tag])):
            self._up(n.up)
        node = Node(tag, self.at, self.at.skip or tag in NEVER or bool(attrs) and self._unwanted(tag, attrs) or tag == "header" and not self._open_among(PLACES, ()))
        if (attrs or tag == "form") and not node.skip:
            node.names = _names(tag, attrs)
        self.at.items.append(node)
        if tag not in VOID:
            self._down(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on other elements than void ones

    def _unwanted(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        for k, v in attrs:
            if v and tag not in PLACES and k == "role" and v.strip().lower() in ROLES:
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        """Ends the nearest open element of the tag, with what is open in it; inline tags end nothing beyond their place."""
        if not (self.open if tag in BLOCK else self.scopes[-1]).get(tag):
            return
        n = self.at
        while n.tag != tag:
            n = n.up
        self._up(n.up)

    def handle_data(self, data: str) -> None:
        if not self.at.skip:
            self.at.items.append(data)


def _density(c: int, link_chars: int, tags: int, link_tags: int, own_links: float) -> float:
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(c * lc / max(1, c - link_chars) + own_links * c + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt))) / max(0.05, math.log(base))


def _measure(root: Node, own_links: float) -> list[Node]:
    """Densities of all nodes that may be text, children before parents; own_links is the page's share of link text."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [x for x in n.items if type(x) is Node and not x.skip]
    order.reverse()
    for n in order:
        link = n.tag == "a"
        n.chars = n.link_chars = n.tags = n.link_tags = 0
        n.total, n.holds_block = 0.0, False
        for x in n.items:
            if type(x) is str:
                n.chars += len(x) if not x.isspace() else 0
            elif not x.skip:
                n.holds_block = n.holds_block or x.holds_block or x.tag in BLOCK
                n.chars += x.chars
                n.link_chars += x.link_chars
                n.tags += x.tags + 1
                n.link_tags += x.link_tags + (x.tag == "a")
                n.total += x.density
        if link:
            n.link_chars = n.chars
        n.density = _density(n.chars, n.link_chars, n.tags, n.link_tags, own_links)
    return order


def _page_links(root: Node) -> float:
    """Link characters by all characters."""
    chars = links = 0
    todo = [(root, False)]
    while todo:
        n, link = todo.pop()
        for x in n.items:
            if type(x) is str:
                chars += len(x)
                links += len(x) if link else 0
            else:
                todo.append((x, link or x.tag == "a"))
    return links / max(1, chars)


def _counted(items: list[Node | str]) -> list[int]:
    """Characters, link characters, tags and link tags of text and inline elements side by side."""
    return [sum(x) for x in zip(*((0 if x.isspace() else len(x), 0, 0, 0) if type(x) is str else (x.chars, x.link_chars, x.tags + 1, x.link_tags + (x.tag == "a")) for x in items), strict=True)]


def _dense(top: Node, core: Node, threshold: float, own_links: float) -> list[Node | str | None]:
    """The core and all parts below top that reach the threshold, in page order, None between them; with them the thinner
    texts between them, headings right before them and lists right after them, unless they are mostly links."""
    path, n = set(), core
    while n is not top:
        n = n.up
        path.add(n)
    found: list[tuple[str, list[Node | str]]] = []  # the kind of each text: kept, or what it is in
    todo: list[tuple[Node | list[Node | str], str]] = [(top, "text")]
    while todo:
        n, kind = todo.pop()
        if type(n) is list:  # text and inline elements side by side
            c = _counted(n)
            if c[0] and _density(*c, own_links) >= threshold:
                found.append(("kept", n))
            elif any(type(x) is Node and x.holds_block for x in n):
                todo += [(x if type(x) is Node else [x], kind) for x in reversed(n)]
            elif c[0]:
                found.append(("links" if 2 * c[1] >= c[0] else kind, n))
        elif n is core or n not in path and n.density >= threshold:
            found.append(("kept", [n]))
        else:
            kind = "heading" if n.tag in HEADINGS else "list" if n.tag in LISTS else kind
            runs: list[Node | list[Node | str]] = []
            for x in n.items:
                if type(x) is Node and (x.skip or x is core or x in path or x.tag in BLOCK):
                    runs += [] if x.skip else [x]
                elif runs and type(runs[-1]) is list:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            todo += [(x, kind) for x in reversed(runs)]
    kept = [i for i, (kind, _) in enumerate(found) if kind == "kept"]
    if not kept:
        return []
    first, last = kept[0], kept[-1]
    while first and found[first - 1][0] == "heading":
        first -= 1
    while last + 1 < len(found) and found[last + 1][0] == "list":
        last += 1
    out: list[Node | str | None] = []
    for kind, n in found[first : last + 1]:
        out += [] if kind == "links" else [None, *n, None]
    return out


def article(root: Node) -> list[Node | str | None]:
    """What makes up the article, in page order."""
    own_links = _page_links(root)
    order = _measure(root, own_links)
    core = max(reversed(order), key=lambda n: n.total if n.total else n.density * 1e-9)
    threshold, n, place = core.density, core, None
    while n is not None:
        threshold = min(threshold, n.density)
        place = n if n.tag in PLACES else place
        n = n.up
    threshold = max(threshold, 1e-9)
    while core.up is not None and core.tag not in HOLDERS:
        core = core.up
    places = _outermost(root)
    if place is None:  # the core may be what is around the articles, and as dense as they are together
        threshold = threshold * TOGETHER if core.up is None else threshold
        place = max((n for n in places if _within(n, core)), key=lambda n: n.chars - n.link_chars, default=None)
    if place is None or place.chars - place.link_chars < PLACE_SHARE * (root.chars - root.link_chars):
        return _dense(root, core, threshold, own_links) if core.up is not None else _unlinked(core)
    own = core if _within(core, place) else place
    out: list[Node | str | None] = []
    for n in places:
        out += _dense(n, own, threshold, own_links) if n is place else [None, n, None] if n.density >= threshold else []
    return out


def _within(n: Node | None, top: Node) -> bool:
    while n is not None and n is not top:
        n = n.up
    return n is not None


def _unlinked(root: Node) -> list[Node | str | None]:
    """All of a page that is one text, without the lists that are links alone."""
    only_links = lambda x: type(x) is Node and x.tag in ("ul", "ol", "dl", "table", "div", "center") and not x.skip and x.link_tags > 1 and x.link_chars == x.chars
    return [x for x in root.items if not only_links(x)]


def _outermost(root: Node) -> list[Node]:
    """The named places that lie in no other one, in page order."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in PLACES:
            out.append(n)
        else:
            todo += [x for x in reversed(n.items) if type(x) is Node and not x.skip]
    return out


def blocks(nodes: list[Node | str | None]) -> list[str]:
    """Texts of the blocks, white space as one space, empty ones left out."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now and (t := " ".join("".join(now).split())):
            out.append(t)
        now.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif type(x) is str:
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.skip:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.items)
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(_LONG_NUMBER.sub("\ufffd", html))
    tree.close()
    _skip_named(tree.root)
    return "\n".join(blocks(article(tree.root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
