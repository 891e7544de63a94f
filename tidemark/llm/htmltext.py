"""Main text of HTML pages by composite text density.

A page is parsed into a tree with HTML's rules for void, optional and raw elements. Only what
never shows as text goes before anything is measured: scripts, styles, templates, embedded
objects, form controls, hidden elements. Every other node gets its composite density:
characters by tags, adjusted by how many of them are links. A node's density sum is the sum
of its children's. The node with the largest sum is the core; the smallest density on the
path from it up to the body is the threshold. Every branch off the body that reaches the
threshold gives its own node of the largest sum, widened past parents that add mostly unlinked
text, such as the title; those subtrees are the article. A branch without inner elements has no
sum to show, so it must reach the core's own density; headings right before a selected subtree belong to it.

Names break ties, after that. An element (menu, page header or footer, aside, form), role, class
or id marks a node as chrome. A class or id does so as a whole: all its words are of chrome (``NAMES``) or of layout
(``LAYOUT``), so ``cookie-notice`` and ``site-footer`` do, and ``cookies-and-tea`` doesn't. Chrome words among others only count where the node is mostly
links or, for classes outside an ``article``, below the threshold. An id that a heading in its node repeats says what the node is about:
inside an ``article`` it counts like a word that prose uses as well. A marked core gives way to the unmarked node with the
largest sum, if that has an eighth of it at least. A marked node among what was selected goes,
unless it holds over half of the body's unlinked text and the core is in it or hardly anything
else is left; comments by readers go whatever they hold. On headings and paragraphs only whole classes count, and words that prose
uses as well (``LOOSE``) count only where the node is mostly links or, on other elements,
also where it is below the threshold.

Text: character references are decoded, white space inside a block becomes one blank,
blocks are trimmed and joined in page order by an empty line. Nothing else is dropped.

Cases. Null or empty html, or html without text, gives an empty text. Unclosed and stray
tags are repaired as browsers do. Very long pages and deep nesting are handled without
recursion. Null ids stay, equal rows give equal texts, an empty table gives no rows, extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, batch, only, slices, spread, strings

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("head title base link meta style script noscript template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr".split())
#: start tag -> (open elements it closes, elements that stop the search)
OPTIONAL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span sub sup mark q cite abbr label ins del kbd samp var dfn bdi bdo time data".split())
#: Never text of the page.
UNSEEN = frozenset("button select input textarea script style noscript template iframe object embed svg canvas audio video map head title".split())
#: Elements that mark chrome.
CHROME = frozenset("nav aside footer form label fieldset dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words of class and id names that mark chrome.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside side rail widget widgets "
    "footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments disqus reply replies respond share sharing social follow related recommended recommendations newsletter subscribe "
    "subscription signup login search copyright skip hidden tags toc".split()
)
#: Words beside them in names that say nothing but where or how something stands.
LAYOUT = frozenset(
    "site page main top bottom left right upper lower list item items box bar block area container wrapper wrap inner outer section row column col group panel thread "
    "link links post posts entry article articles content story text body title button buttons icon icons form field primary secondary global mobile desktop sticky fixed "
    "slot unit zone placement inline large small medium leaderboard skyscraper logo wp js ui jetpack wpdiscuz google facebook twitter taboola outbrain more most read popular latest".split()
)
#: Chrome words that prose and its layout use as well.
LOOSE = frozenset("share sharing social follow tags side rail head header foot search skip related recommended notice notices alert menu banner toc reply respond promotion".split())
#: Of these also containers may hold article text.
LOOSE_BOX = frozenset("share sharing follow tags side rail head foot search skip".split())
#: Words of class and id names that mark the article; with one of them a header holds its title.
CONTENT = frozenset("article post entry story content text body main".split())
#: Chrome words don't count on these: they hold the article, whatever their class says.
KEPT = frozenset("html body article main".split())
#: On these only whole classes count: their ids are made of what they say.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of these names a node can be larger than the article.
READERS = frozenset("comment comments disqus reply replies respond".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "up", "down", "unseen", "marked", "loose", "slight", "own_id", "holds", "readers", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, up: Node | None, attributes: str = ""):
        self.tag, self.up = tag, up
        self.unseen = self.marked = self.loose = self.holds = self.readers = False
        self.slight, self.own_id = "", frozenset()
        self._name(attributes)
        self.down: list[Node | str] = []

    def _name(self, attributes: str) -> None:
        """``marked``: chrome, ``loose``: by words of prose only, ``slight``: names ("class" or "id") with a chrome word among others,
        ``own_id``: words of the id that marks it by itself, ``holds``: named as the article, ``readers``: named as comments."""
        tag = self.tag
        self.unseen = tag in UNSEEN
        self.marked = by_element = tag in CHROME
        if self.unseen or not attributes.strip():
            return
        words: set[str] = set()
        names: dict[str, set[str]] = {"class": set(), "id": set()}
        some: set[str] = set()
        for name, a, b, c in _ATTR.findall(attributes):
            name, value = name.lower(), entities.unescape(a or b or c)
            if name == "class" or (name == "id" and tag not in PROSE):
                for token in value.split():
                    parts = {token.lower()} if tag in PROSE else {w.lower() for w in _WORD.findall(token)}
                    words |= parts
                    chrome = parts & NAMES
                    if all(w in NAMES or w in LAYOUT or w.isdigit() for w in parts):
                        names[name] |= chrome
                    elif chrome:
                        some.add(name)
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
                self.unseen = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.unseen = True
            elif tag not in KEPT and name == "role" and value.strip().lower() in ROLES:
                self.marked = by_element = True
        holds = bool(words & CONTENT)
        found = names["class"] | names["id"]
        if holds:
            found -= {"header", "head"}
        self.holds = holds and not found
        self.readers = bool(found & READERS) and not holds
        if tag in KEPT:
            return
        if found:
            self.marked = True
            self.loose = not by_element and not found - (LOOSE if tag in PROSE else LOOSE_BOX)
            if not by_element and not found & names["class"]:
                self.own_id = frozenset(found)
        elif some and not by_element:
            self.slight = "class" if "class" in some else "id"


def parse(page: str) -> Node:
    """The tree of a page, its root an ``html`` node."""
    root = Node("html", None)
    body = None
    here = root
    open_tags = {"html": 1}
    at, n = 0, len(page)

    def close_to(node: Node) -> Node:
        nonlocal here
        while here is not node:
            open_tags[here.tag] -= 1
            here = here.up
        return here

    def nearest(tags, stops) -> Node | None:
        x = here
        while x is not None and x is not root:
            if x.tag in tags:
                return x
            if x.tag in stops:
                return None
            x = x.up
        return None

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            here.down.append(page[at:])
            break
        if m.start() > at:
            here.down.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        closing, tag, attributes = m[1] or m[4], name.lower(), m[3] or m[6] or ""
        if closing:
            if tag in ("html", "body") or not open_tags.get(tag):
                if tag == "br":
                    here.down.append(" ")
                continue
            # an inline end tag doesn't reach over a block, a block's end tag closes what is open inside
            x = nearest({tag}, BLOCK - {tag} if tag in FORMATTING else {"table"} if tag not in ("table", "div", "article", "section", "main") else ())
            if x is not None:
                up = x.up
                close_to(up)
            continue
        if tag == "html":
            continue
        if tag == "body":
            if body is None:
                close_to(root)
                body = Node("body", root)
                root.down.append(body)
                here = body
                open_tags["body"] = 1
            continue
        if here.tag == "head" and tag not in HEAD:
            close_to(root)
        if tag in CLOSES_P and open_tags.get("p"):
            x = nearest({"p"}, {"table", "td", "th", "caption", "button", "object"})
            if x is not None:
                close_to(x.up)
        if tag in OPTIONAL:
            own, stops = OPTIONAL[tag]
            while (x := nearest(own, stops)) is not None:
                close_to(x.up)
        if tag in HEADINGS and here.tag in HEADINGS:
            close_to(here.up)
        node = Node(tag, here, attributes)
        if tag in ("article", "main"):
            # a wrapper named after what else it holds is no chrome
            x = here
            while x is not None:
                x.marked, x.slight = False, ""
                x = x.up
        here.down.append(node)
        if tag in VOID or (attributes.endswith("/") and tag in ("path", "rect", "circle")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or n if end else n
            continue
        here = node
        open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _size(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def _page_header(node: Node) -> bool:
    """A ``header`` outside the article is the page's; inside it holds the title."""
    if node.tag != "header":
        return False
    x = node.up
    while x is not None:
        if x.holds or x.tag in ("article", "main", "section"):
            return False
        x = x.up
    return True


def measure(body: Node) -> list[Node]:
    """Sets the densities of all nodes below ``body``, without those that are never text; returns them, parents first."""
    nodes, stack = [], [body]
    while stack:
        x = stack.pop()
        x.down = [d for d in x.down if isinstance(d, str) or not d.unseen]
        nodes.append(x)
        stack.extend(d for d in reversed(x.down) if not isinstance(d, str))
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for d in x.down:
            if isinstance(d, str):
                x.chars += _size(d)
            else:
                x.chars += d.chars
                x.tags += d.tags + 1
                x.link_chars += d.link_chars
                x.link_tags += d.link_tags + (d.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars
    ratio = body.link_chars / max(1, body.chars)
    for x in reversed(nodes):
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, ratio)
        x.total = sum(d.density for d in x.down if not isinstance(d, str))
    return nodes


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters a tag, times a logarithm that falls as links take over the node or its tags."""
    if chars == 0:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    plain = max(1, chars - link_chars)
    base = math.log(chars / plain * link_chars + body_ratio * chars + math.e)
    inside = (chars / links) * (tags / link_tags)
    return chars / tags * (math.log(max(inside, 1.0)) / base if base > 0 else 0.0)


def _widened(core: Node, branch: Node) -> Node:
    """From the core up to the branch, past parents that add mostly plain text, such as the title."""
    while core is not branch:
        up = core.up
        if 3 * (up.link_chars - core.link_chars) > up.chars - core.chars:
            break
        core = up
    return core


def selected(nodes: list[Node]) -> tuple[list[Node], Node, float]:
    """(subtrees that density takes for the article, in page order; the core; the threshold)."""
    body = nodes[0]
    core = max(nodes, key=lambda x: x.total)
    if core.total <= 0:
        return [body], body, body.density
    for x in nodes:
        x.marked = x.marked or (bool(x.slight) and 2 * x.link_chars > x.chars)
    # a menu or a thread of comments may have the largest sum; what it may not be, it isn't
    chrome = set()
    for x in nodes:
        if x.marked or (x.up is not None and id(x.up) in chrome):
            chrome.add(id(x))
    if id(core) in chrome:
        other = max((x for x in nodes if id(x) not in chrome), key=lambda x: x.total, default=core)
        core = other if 8 * other.total >= core.total else core
    if core is body:
        # nothing off the path to judge by; only menus are told by their density
        for d in body.down:
            if not isinstance(d, str) and 2 * d.link_chars > d.chars and d.density < body.density:
                d.marked = True
        return [body], body, body.density
    threshold, path = core.density, {id(core)}
    x = core
    while x is not body:
        x = x.up
        threshold = min(threshold, x.density)
        path.add(id(x))
    # best[x]: the node of the largest sum in x's subtree
    best: dict[int, Node] = {}
    for x in reversed(nodes):
        top = x
        for d in x.down:
            if not isinstance(d, str) and best[id(d)].total > top.total:
                top = best[id(d)]
        best[id(x)] = top
    found: list[Node] = []
    stack = [body]
    while stack:
        x = stack.pop()
        if x is not body and x.chars and x.density >= (threshold if x.total > 0 else core.density):
            found.append(_widened(core if id(x) in path else best[id(x)] if best[id(x)].total > 0 else x, x))
            continue
        stack.extend(d for d in reversed(x.down) if not isinstance(d, str))
    return _with_headings(found or [core], body), core, threshold


def _with_headings(roots: list[Node], body: Node) -> list[Node]:
    """The subtrees, each after the headings right before it or before what it stands in."""
    out: list[Node] = []
    taken = {id(x) for x in roots}
    for root in roots:
        ahead: list[Node] = []
        x = root
        while x is not body:
            around = [d for d in x.up.down if not isinstance(d, str)]
            k = next(k for k, d in enumerate(around) if d is x)
            while k and around[k - 1].tag in HEADINGS and around[k - 1].chars and id(around[k - 1]) not in taken:
                k -= 1
                ahead.append(around[k])
                taken.add(id(around[k]))
            x = x.up
        out += [*reversed(ahead), root]
    return out


def _titled(node: Node) -> bool:
    """A heading in the node has all words of its id."""
    for d in node.down:
        if not isinstance(d, str) and d.tag in ("header", "hgroup"):
            if _titled_by(node, d.down):
                return True
    return _titled_by(node, node.down)


def _titled_by(node: Node, down: list) -> bool:
    return any(not isinstance(d, str) and d.tag in HEADINGS and node.own_id <= {w.lower() for w in re.findall(r"\w+", " ".join(blocks(d)))} for d in down)


def _drop_marked(roots: list[Node], nodes: list[Node], core: Node, threshold: float) -> list[Node]:
    """Takes marked nodes out of the selected subtrees, and out of the selection what lies below one."""
    body = nodes[0]
    inside = {id(x) for x in nodes if x.tag in ("article", "main") and x.chars}
    named_article = bool(inside)
    for x in nodes:
        within = x.up is not None and id(x.up) in inside
        if within:
            inside.add(id(x))
        x.marked = x.marked or _page_header(x)
        if x.slight == "class" and x.tag not in PROSE and not within and x.density < threshold:
            x.marked = True
        if x.marked and within and x.own_id and not x.readers and _titled(x):
            x.loose = True
        if x.loose and 2 * x.link_chars <= x.chars and (x.tag in PROSE or x.density >= threshold):
            x.marked = x.readers = False
    for x in reversed(nodes):
        x.plain = 0 if x.tag == "a" else sum(_size(d) if isinstance(d, str) else 0 if d.marked and d.readers else d.plain for d in x.down)
    # a marked node of most of the text stays if the core is in it, or else hardly anything is left
    below, path = set(), set()
    unmarked = 0
    for x in nodes:
        if x.marked or (x.up is not None and id(x.up) in below):
            below.add(id(x))
        elif x.tag != "a":
            unmarked += sum(_size(d) for d in x.down if isinstance(d, str))
    x = core
    while x is not None:
        path.add(id(x))
        x = x.up
    for x in nodes:
        spared = 2 * x.plain > body.plain and not x.readers and (id(x) in inside if named_article else id(x) in path or 8 * unmarked < body.plain)
        x.marked = x.marked and not spared
    gone = set()
    for x in nodes:
        x.down = [d for d in x.down if isinstance(d, str) or not d.marked]
        if x.marked or (x.up is not None and id(x.up) in gone):
            gone.add(id(x))
    return [x for x in roots if id(x) not in gone]


def article_roots(page: str) -> list[Node]:
    """The subtrees that are the article, in page order."""
    root = parse(page)
    body = next((d for d in root.down if not isinstance(d, str) and d.tag == "body"), root)
    nodes = measure(body)
    if body.chars == 0:
        return []
    body.up = None
    roots, core, threshold = selected(nodes)
    return _drop_marked(roots, nodes, core, threshold)


def blocks(node: Node) -> list[str]:
    """Text of each block below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = _BLANKS.sub(" ", entities.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br" or x.tag == "wbr" or x.tag == "img":
            run.append("" if x.tag == "wbr" else " ")
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.down))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(b for root in article_roots(page) for b in blocks(root))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in slices(batches, 500):
            texts = [main_text(h) for h in strings(b.column(2))]
            yield batch(schema, page_id=b.column(0), url=b.column(1), text=texts, n_chars=list(map(len, texts)))

    return arrow_map(spread(only(pages, "page_id", "url", "html")), run, "page_id long, url string, text string, n_chars long")
