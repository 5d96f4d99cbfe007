"""Main text of web pages by composite text density.

A lenient parser builds the element tree.  For every element its composite density is the
characters per tag, adjusted by how much of the text and how many of the tags are links; its
density sum adds up the composite densities of its children.  The threshold is the least
density on the path from the body to the element with the greatest density sum.  Going down
from the body through elements that reach the threshold, the subtree with the greatest density
sum below each of them is text of the article; so is the heading that stands last before such
a subtree.  An <article> around the densest element is taken whole, for it says where the
article ends; a <main> around it takes the body's place.  The blocks of text are joined;
boilerplate elements (by tag, role or class) are removed beforehand, except those that hold
most of the page's text outside links with no <article> or <main> beside them: these wrap the
article (a form around the whole page, a class that names the layout).

Null and empty pages give an empty text.  Malformed markup never fails: unclosed elements end
with their parents, stray end tags are ignored, text outside any element belongs to the body,
and a self-closed script or the like with no end tag after it is empty.
Null ids and urls are kept.  Of elements with equal density sums the upper one is taken, then the first.  Very long
pages are parsed as a whole, in time that follows their length: nesting is bounded.
Pages are independent, so repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.arrow import derive

#: A comment, a declaration, or a tag: quotes count only after an equals sign, and an unclosed one is a character like any other.
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?>=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*|[^>])*+(?:>|\Z)""", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"\s+")
_LINK_WORD = re.compile(r"[^\s]+")

# Element names with fixed meanings in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
DROPPED = frozenset(
    "head script style noscript iframe template svg math object embed applet canvas audio video map nav header footer aside form fieldset button select option optgroup datalist textarea input label dialog menu".split()
)
#: Dropped elements that may wrap an article, as those may that are marked by role or class.
WRAPPERS = frozenset("head header aside form fieldset dialog menu".split())
#: Why an element is dropped: it is boilerplate unless it holds most of the page's text, it is readers' comments, or it shows no text.
MARGINAL, READERS, HIDDEN = 1, 2, 3
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements nested deeper than this become siblings, as in browsers, so that no walk to an ancestor is long.
DEEPEST = 512
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK - frozenset("body html li dd dt td th tr tbody thead tfoot".split())
#: An opening tag closes an open element of these names, up to the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert".split())
#: Words of class and id values that mark boilerplate.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer|header|masthead|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comment|comments|commentlist|reply|replies|disqus|pagination|pager|toolbar|widget\w*|skip|search|paywall)(?:$|[\s_-])",
    re.I,
)

#: Words of readers' comments, which may be articles of their own.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|reply|replies)(?:$|[\s_-])", re.I)
#: Names of a layout say what stands beside an element, not what it is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|no|without)[_-]\S+", re.I)


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "drop", "own", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: int = 0):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], drop
        self.depth = 0 if parent is None else parent.depth + 1
        self.own = self.plain = 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _dropped(tag: str, token: str) -> int:
    if tag in DROPPED and tag not in WRAPPERS:
        return HIDDEN
    drop = MARGINAL if tag in WRAPPERS else 0
    if len(token) <= len(tag) + 3 or tag in ("html", "body", "main"):
        return drop
    for name, value in _ATTRIBUTE.findall(token, len(tag) + 1):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return HIDDEN
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
        # Of the words that mark boilerplate, only those of comments turn an article into it.
        if name in ("class", "id") and (COMMENT if tag == "article" else MARKED).search(LAYOUT.sub("", value)):
            drop = READERS if COMMENT.search(LAYOUT.sub("", value)) else max(drop, MARGINAL)
        if name == "role" and value.lower() in ROLES:
            drop = max(drop, MARGINAL)
    return drop


def parse(page: str) -> Node:
    """The tree under a synthetic body; text nodes are plain strings among the children."""
    root = node = Node("body", None)
    at = 0
    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at, token = m.end(), m[0]
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                node.children.append(token[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            above = node
            while above is not None and above.tag != tag:
                # An inline end tag does not close blocks.
                above = None if tag not in BLOCK and above.tag in BLOCK else above.parent
            if above is not None and above.parent is not None:
                node = above.parent
            elif tag == "br":
                node.children.append("\n")
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            above = node
            while above is not None and above.tag != "p":
                above = None if above.tag in BLOCK else above.parent
            if above is not None:
                node = above.parent
        elif tag in CLOSES:
            closes, scope = CLOSES[tag]
            above, found = node, None
            while above is not None and above.tag not in scope:
                if above.tag in closes:
                    found = above
                above = above.parent
            if found is not None:
                node = found.parent
        if tag in ("main", "article", "section", "body") and node.tag == "head":
            node = node.parent
        child = Node(tag, node, _dropped(tag, token))
        node.children.append(child)
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif token.endswith("/>"):
                endless.add(tag)
            else:
                at = len(page)
        elif tag not in VOID and not token.endswith("/>") and child.depth < DEEPEST:
            node = child
    if at < len(page):
        node.children.append(page[at:])
    return root


def _titled(node: Node) -> bool:
    stack = [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, Node) and c.drop < READERS:
                if not c.drop and c.tag in ("h1", "article", "main"):
                    return True
                stack.append(c)
    return False


def _unwrap(root: Node) -> None:
    """Keeps the marginal elements that hold most of the page's text outside links, unless an <article> or <main> stands beside them.

    Comments are often longer than what they are on: one that holds no title or article is kept only if there is no other text.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.drop != HIDDEN]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.own += sum(map(len, _LINK_WORD.findall(c)))
            else:
                node.plain += c.plain
        node.plain = 0 if node.tag == "a" else node.plain + node.own
    # Two elements that hold most of the text lie inside each other, so there is one at a time.
    top = root
    while top is not None:
        wrapper, articles, rest, stack = None, [], 0, [top]
        while stack:
            node = stack.pop()
            rest += 0 if node.tag == "a" else node.own
            for c in node.children:
                if isinstance(c, str) or c.drop == HIDDEN:
                    continue
                if c.drop:
                    wrapper = c if 2 * c.plain > root.plain else wrapper
                    continue
                if c.tag in ("article", "main"):
                    articles.append(c)
                stack.append(c)
        above = wrapper and wrapper.parent
        while above is not None:
            if above in articles:
                articles.remove(above)
            above = above.parent
        if wrapper is not None and not articles and (wrapper.drop == MARGINAL or not rest or _titled(wrapper)):
            wrapper.drop = 0
            top = wrapper
        else:
            top = None


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of the elements that stay, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.drop]
    for node in reversed(order):
        inside = node.tag == "a"
        node.chars = node.own
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
        if inside:
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole_chars, whole_links = max(root.chars, 1), root.link_chars
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            plain = max(c - node.link_chars, 1)
            base = math.log(c / plain * node.link_chars + whole_links / whole_chars * c + math.e)
            node.density = max(c / t * math.log(c / lc * t / lt + 1) / base, 0.0)
        for x in node.children:
            if isinstance(x, Node) and not x.drop:
                node.total += x.density
    return order


def _articles(root: Node) -> list[Node]:
    """The subtrees that make up the article, in document order, none inside another."""
    order = _measure(root)
    peak = {}
    for node in reversed(order):
        # The greatest density sum below each element; of equals, the element above, then the first.
        below = max((peak[c] for c in node.children if isinstance(c, Node) and not c.drop), key=lambda n: n.total, default=node)
        peak[node] = below if below.total > node.total else node
    densest = top = peak[root]
    threshold = densest.density
    while top.parent is not None and top.tag not in ("article", "main"):
        top = top.parent
        threshold = min(threshold, top.density)
    if top.tag == "article":
        return [top]
    taken, stack = set(), [top]
    while stack:
        node = stack.pop()
        if node.density >= threshold:
            taken.add(peak[node])
            stack += [c for c in node.children if isinstance(c, Node) and not c.drop]
    out, heads, stack = [], [], [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            # Whatever stands between, a title heads the article; a lesser heading only what follows at once.
            if heads and node.strip():
                heads = [h for h in heads if h.tag == "h1"][-1:]
        elif node in taken:
            out += heads + [node]
            heads = []
        elif node.tag in HEADINGS and node.chars:
            heads.append(node)
        elif not node.drop:
            stack += reversed(node.children)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [x for node in reversed(nodes) for x in (None, node)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(html.unescape(x))
        elif not x.drop:
            if x.tag == "br":
                run.append(" ")
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
                stack += reversed(x.children)
            else:
                stack += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _unwrap(root)
    return "\n\n".join(_blocks(_articles(root)))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(texts: list[str | None]) -> list[list]:
        text = [main_text(t) for t in texts]
        return [text, list(map(len, text))]

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return derive(picked, "html", run, "text string, n_chars long")
