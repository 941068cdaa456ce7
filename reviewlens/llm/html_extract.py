"""Main text of web pages by tree scoring.

The page is parsed into a tree that forgives missing end tags. Paragraphs pass
points to the elements around them: one, one for every comma and one for every
100 characters (at most 3); the parent gets them whole, the grandparent half, the
next a sixth and each further one two thirds of that, so one pass upwards does it. What a container has gathered is discounted by its link
density, the share of its text inside links. The best container is the article, or
the whole article or main element it lies in; siblings stay if they score well
beside it or are text with few links (``kept_parts``). Navigation, headers and footers of the page, asides, forms, scripts,
styles, hidden parts, adverts, notices, sidebars and reader comments are left
out by element or by their class, id and role.

Text comes out as blocks in page order, joined by an empty line: character
references decoded, white space inside a block one space, trimmed, empty blocks
left out. Null or empty html, or html without text, gives an empty string.
Repeated rows give repeated results, an empty table an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OUTPUT = "page_id long, url string, text string, n_chars long"

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
    summary table tbody td tfoot th thead tr ul""".split())
SKIPPED = frozenset("""script style noscript template iframe object embed svg canvas audio video head title nav
    aside form button select textarea input label menu dialog footer""".split())
CONTAINERS = frozenset("article body blockquote center div main section td".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_PARTS = HEADINGS | frozenset("p pre blockquote ul ol dl table figure".split())
CLOSES_P = BLOCKS - {"html", "body"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body html td th blockquote aside nav form footer header".split())

# Words in class, id or role that name parts beside the article
# ("has-sidebar" and the like describe a layout and do not count).
_WORD = r"(?<!\bno)(?<!\bhas)(?<!\bwith)(?<!\bwithout)(?:^|[\s_-])(?:%s)(?=$|[\s_-])"
BESIDE = re.compile(_WORD % (
    r"ad|ads|advert\w*|adbox|adslot|banner|sponsor\w*|promo\w*|comment\w*|disqus|replies|respond|sidebar|side|widget|related|"
    r"recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|cookie\w*|consent|gdpr|notice|popup|modal|overlay|"
    r"breadcrumb\w*|menu|navbar|nav|navigation|pagination|pager|toolbar|footer|skip|complementary|contentinfo|search|alert"), re.I)
# These head the page unless they stand inside an article, where they hold its headline.
HEADS_PAGE = re.compile(_WORD % "header|masthead|topbar|banner", re.I)
# An article element may itself be a reader's comment or a teaser.
ASIDE_ARTICLE = re.compile(_WORD % r"comment\w*|reply|replies|teaser|promo\w*|related|sponsor\w*", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "own", "score", "chars", "link_chars", "beside", "in_article",
                 "commas", "solid", "words", "starts", "ends")

    def __init__(self, tag: str, parent: "Node | None", beside: bool = False):
        self.tag, self.parent, self.beside = tag, parent, beside
        self.children: list[Node | str] = []
        self.score, self.chars, self.link_chars = 0.0, 0, 0
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        # the text below: commas, characters but white space, words, and whether it starts and ends inside a word
        self.commas, self.solid, self.words, self.starts, self.ends = 0, 0, 0, None, False

    def follow(self, commas: int, solid: int, words: int, starts: bool | None, ends: bool) -> None:
        """Adds what stands behind the text so far (``starts`` is None for no text at all)."""
        if starts is None:
            return
        self.words += words - (self.ends and starts)
        self.commas += commas
        self.solid += solid
        if self.starts is None:
            self.starts = starts
        self.ends = ends

    def text_length(self) -> int:
        """Characters of the text below, white space as single spaces."""
        return self.solid + max(self.words - 1, 0)


def in_article(node: Node | None) -> bool:
    return node is not None and node.in_article


class Builder(HTMLParser):
    """Tree of a page. An end tag closes the nearest open element of its name;
    block elements close an open paragraph, as in browsers."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.open: Counter[str] = Counter()  # open elements of each name

    def leave(self, node: Node) -> None:
        """Closes an open element and all that are open inside it."""
        inner = self.at
        while inner is not node.parent:
            self.open[inner.tag] -= 1
            inner = inner.parent
        self.at = node.parent

    def close_up_to(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        if not any(self.open[name] for name in names):
            return
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in names:
                self.leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.close_up_to({"p"}, SCOPES)
        if tag in CLOSED_BY:
            self.close_up_to(CLOSED_BY[tag], frozenset({"ul", "ol", "dl", "table", "select"}))
        if tag in ("body", "main", "article") and self.at.tag in ("head", "title", "meta"):
            self.close_up_to({"head"}, frozenset())
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true")
                     or (k == "style" and re.search(r"display\s*:\s*none", v or "", re.I)) for k, v in attrs)
        node = Node(tag, self.at, hidden or bool(named and self.named_beside(tag, named)))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def named_beside(self, tag: str, named: str) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag == "article":
            return bool(ASIDE_ARTICLE.search(named))
        return bool(BESIDE.search(named) or (HEADS_PAGE.search(named) and not in_article(self.at)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self.leave(node)

    def handle_data(self, data):
        self.at.children.append(data)


def skipped(node: Node) -> bool:
    """Left out with all below it. A header inside an article holds its headline and stays."""
    if node.beside or node.tag in SKIPPED:
        return True
    return node.tag == "header" and not in_article(node.parent)


def measure(root: Node) -> list[Node]:
    """Sets the lengths of text and links of all kept nodes; returns them, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and not skipped(x))
    for node in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len(x.strip())
                words = x.split()
                node.follow(x.count(","), sum(map(len, words)), len(words), not x[:1].isspace() if x else None,
                            not x[-1:].isspace())
            elif not skipped(x):
                node.chars += x.chars
                node.link_chars += x.link_chars
                node.follow(x.commas, x.solid, x.words, x.starts, x.ends)
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def points(node: Node) -> float:
    """Points of a paragraph's text, or of the text that a container holds itself."""
    if node.tag in PARAGRAPHS and node.tag not in CONTAINERS:
        commas, length = node.commas, node.text_length()
    else:
        text = " ".join(x.strip() for x in node.children if isinstance(x, str)).strip()
        commas, length = text.count(","), len(text)
    return 0.0 if not length else 1.0 + commas + min(length // 100, 3)


def best_container(order: list[Node]) -> Node | None:
    """Scores containers and returns the best one."""
    around: dict[int, Node | None] = {}  # the nearest container around each node
    gains: dict[int, list[float]] = {}   # of a container: points from one level below, two, and further
    for node in order:
        up = node.parent
        around[id(node)] = None if up is None else up if up.tag in CONTAINERS else around.get(id(up))
        if node.tag in CONTAINERS:
            gains[id(node)] = [0.0, 0.0, 0.0]
    for node in reversed(order):
        direct = node.tag in PARAGRAPHS or (node.tag in CONTAINERS and any(isinstance(x, str) and x.strip()
                                                                             for x in node.children))
        box = node if node.tag in CONTAINERS else around[id(node)]
        if direct and box is not None:
            gains[id(box)][0] += points(node)
        if node.tag in CONTAINERS:
            near, second, far = gains[id(node)]
            node.score += near + 0.5 * second + far
            if around[id(node)] is not None:
                above = gains[id(around[id(node)])]
                above[1] += near
                above[2] += second / 6.0 + far * 2.0 / 3.0
    top = None
    for node in order:
        if node.tag in CONTAINERS and node.chars:
            prior = {"article": 25.0, "main": 15.0, "section": 3.0}.get(node.tag, 0.0)
            node.score = (node.score + prior) * (1.0 - node.link_chars / node.chars)
            if top is None or node.score > top.score:
                top = node
    return top


def whole_element(top: Node) -> Node:
    """The outermost article around the best container, else the main element around it, else itself."""
    article = main = None
    node = top
    while node is not None:
        if node.tag == "article":
            article = node
        elif node.tag == "main":
            main = node
        node = node.parent
    return article or main or top


def runs_of(node: Node) -> Iterator[Node]:
    """The element's kept block children; the text and inline elements between two of them as one node without a name."""
    run = Node("root", node)
    for x in [*node.children, None]:
        if isinstance(x, str) or (x is not None and x.tag not in BLOCKS):
            if isinstance(x, str) or not skipped(x):
                run.children.append(x)
                run.chars += len(x.strip()) if isinstance(x, str) else x.chars
                run.link_chars += 0 if isinstance(x, str) else x.link_chars
            continue
        if run.chars:
            yield run
        run = Node("root", node)
        if x is not None and not skipped(x):
            yield x


def holds_paragraphs(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in TEXT_PARTS:
            return True
        stack.extend(c for c in x.children if isinstance(c, Node) and not skipped(c))
    return False


def kept_parts(top: Node) -> list[Node]:
    """The whole element of the best container with the siblings that belong to the article, in page order.

    Headings, lists, tables, figures, preformatted text and paragraphs with few links stay. Containers stay
    if they score well. Beside a plain container, so do those with few links unless an article
    stands there; right in the body they must hold paragraphs, as unnamed notices stand there too."""
    whole = whole_element(top)
    if whole.parent is None or whole.tag == "body":
        return [whole]
    parent = whole.parent
    least = max(10.0, 0.2 * top.score)
    in_body = parent.tag in ("body", "html", "root")
    alone = whole.tag not in ("article", "main") and not any(isinstance(x, Node) and x.tag == "article"
                                                             for x in parent.children)
    out = []
    for x in runs_of(parent):
        if x is whole:
            out.append(x)
        elif x.chars:
            density = x.link_chars / x.chars
            if x.tag in CONTAINERS:
                keep = x.score >= least and density < 0.5
                keep = keep or (alone and density < 0.25 and (not in_body or holds_paragraphs(x)))
            else:
                keep = density < 0.25 and (x.tag != "root" or not in_body or x.chars > 80)
            if keep:
                out.append(x)
    return out


def blocks_of(node: Node) -> list[str]:
    """Texts between block boundaries below a node."""
    out, line, stack = [], [], [node]

    def end() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            line.append(x)
        elif skipped(x):
            continue
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in BLOCKS:
            end()
            stack.append(None)
            stack.extend(reversed(x.children))
        else:
            stack.extend(reversed(x.children))
    end()
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    order = measure(builder.root)
    top = best_container(order)
    if top is None:
        top = builder.root
    return "\n\n".join(b for part in kept_parts(top) for b in blocks_of(part))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return (pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
            .mapInArrow(run, OUTPUT))
