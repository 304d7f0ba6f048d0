"""Main text of HTML pages by composite text density.

For every block of the DOM the composite density weighs characters per tag by the share of link
characters and link tags (Sun, Song and Liao, 2011); inline elements belong to their block. A
node's density sum adds its children's densities. The subtree with the largest sum is the core. The
smallest density on the path from there to the body is the threshold: every other subtree reached
through nodes at or above it contributes its own largest-sum part. A core inside an article or main
element is widened to it. Headings right before a chosen subtree belong to it; so do the last headline before
an article without one, with the blocks between, and columns beside it of the same element and class.

What is never shown as text (scripts, styles, the head, drawings, embedded media with their fallbacks, form
controls, what the page hides) and the nav and footer elements are cut by the parser; formulas are text. Names
seldom decide alone: elements whose tag, role, class
or id speaks of a menu, header, sidebar, notice, advert, form or reader comments have their densities
multiplied by NAME_WEIGHT and do not count for what holds them, so they lose to any unnamed text, and
are left out of a chosen subtree around them if they stay below the threshold. A named element that
holds blocks with more than WRAPPER_SHARE of the page's text, such as a layout wrapper or a page within one
form, is taken as unnamed (not so reader comments). A
page all of whose text is in named elements still yields the densest.

Defined results: null or empty html gives an empty text; unclosed, nested wrongly and truncated
markup is repaired as browsers do for the common cases; rows keep their ids, repeated or null;
an empty table gives an empty table; only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html".split())
CLOSED_BY_SIBLING = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
SCOPE = frozenset("html body article section main table td th caption button object".split())

#: Elements cut by the parser: no text of the page, form controls, and the two that are never an article.
CUT_TAGS = frozenset(
    "script style noscript template head title svg annotation annotation-xml canvas iframe object embed audio video map noembed noframes xmp "
    "button select option textarea input label datalist nav footer".split()
)
#: Elements, roles, and words in class and id that speak of something other than an article.
NAMED_TAGS = frozenset("aside form fieldset dialog menu search".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer topbar toolbar banner ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager widget widgets copyright skip".split()
)
#: A header is one of the page unless it holds a heading or is inside an article.
HEADER_NAMES = frozenset("header masthead".split())
COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Elements that hold an article; their names are not held against them.
CONTAINERS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 hgroup".split())
TITLES = frozenset("h1 hgroup".split())
NAME_WEIGHT = 0.01
WRAPPER_SHARE = 0.75
#: A side block of a chosen core has at least this share of the median density of the core's own blocks.
LEAF_SHARE = 0.5
#: Elements nested deeper become siblings, as in browsers; bounds the work per element.
MAX_DEPTH = 512

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|</([A-Za-z][^\s/>]*)[^>]*>?|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)([^>]*)>?|<[!?/][^>]*>?", re.S)
#: One attribute as a whole, name and value, so that names are not found inside other names or values.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
CLASS = re.compile(r"(?:^|\s)class\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("chars", "children", "density", "group", "inner", "link_chars", "link_tags", "mark", "parent", "sum", "tag", "tags", "top", "weight")

    def __init__(self, tag: str, parent: Node | None, mark: str | None = None, group: str = ""):
        self.tag, self.parent, self.mark, self.children, self.group = tag, parent, mark, [], group


def _marked(tag: str, attributes: str) -> str | None:
    """What an element's tag, role, class or id speaks of: "name", "header", "comments", or nothing; "hidden" is cut."""
    found = "name" if tag in NAMED_TAGS else "header" if tag == "header" else None
    if not attributes or tag in CONTAINERS:
        return found
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        if name == "role":
            found = "name" if value.strip().lower() in NAMED_ROLES else found
        elif name == "class" or name == "id":
            for word in value.split():
                parts = [p.lower() for p in NAME_WORDS.findall(word)]
                if not parts or parts[0] in ("no", "with", "has"):
                    continue
                ends = {parts[0], parts[-1]}
                if ends & COMMENT_NAMES:
                    found = "comments"
                elif ends & NAMES:
                    found = found or "name"
                elif ends & HEADER_NAMES:
                    found = found or "header"
    return found


def parse(source: str) -> Node:
    """The DOM without what is cut; children are nodes and strings."""
    root = Node("html", None)
    body = Node("body", root)
    root.children.append(body)
    stack = [root, body]  # open elements
    at, low = 0, None

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    def pop_to(tags: frozenset, stop: frozenset) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    skipping = []  # names of open elements inside one that is cut
    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at and not skipping:
            text(source[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if skipping:
                if tag in skipping:
                    while skipping.pop() != tag:
                        pass
                elif tag in ("body", "html", "main", "article") and any(n.tag == tag for n in stack[2:]):
                    skipping.clear()  # a cut element that was never closed ends with what holds it
                    pop_to(frozenset([tag]), frozenset())
            elif tag == "p":
                pop_to(frozenset(["p"]), SCOPE)
            elif tag not in ("body", "html"):
                pop_to(frozenset([tag]), frozenset(["table", "td", "th"]) if tag not in BLOCK else frozenset())
            continue
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        closed = attributes.endswith("/")
        if tag in RAW:
            low = source.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            # lower-casing may move offsets in rare scripts; then search the source itself
            if len(low) != len(source):
                found = re.compile(f"</{tag}", re.I).search(source, at)
                end = found.start() if found else -1
            if end < 0:
                at = len(source)
                break
            close = source.find(">", end)
            at = len(source) if close < 0 else close + 1
            continue
        if tag in ("html", "head", "body"):
            if tag == "body":
                skipping.clear()
            elif tag == "head":
                skipping[:] = ["head"]
            continue
        if skipping:
            if tag not in VOID and not closed and (tag in skipping or tag == skipping[0]):
                skipping.append(tag)
            continue
        if tag in CLOSES_P:
            pop_to(frozenset(["p"]), SCOPE)
        if tag in CLOSED_BY_SIBLING:
            pop_to(*CLOSED_BY_SIBLING[tag])
        if tag in VOID:
            stack[-1].children.append(Node(tag, stack[-1]))
        elif tag in CUT_TAGS or (mark := _marked(tag, attributes)) == "hidden":
            if not (closed and tag in ("svg", "math")):
                skipping.append(tag)
        else:
            if len(stack) > MAX_DEPTH:
                stack.pop()
            group = CLASS.search(attributes) if attributes and tag in BLOCK else None
            node = Node(tag, stack[-1], mark, group[1] or group[2] or group[3] or "" if group else "")
            stack[-1].children.append(node)
            stack.append(node)
    if at < len(source) and not skipping:
        text(source[at:])
    return body


def _links(n: Node) -> int:
    return n.chars if n.tag == "a" else n.link_chars


def _count(order: list[Node], named: bool) -> None:
    """Characters, tags, and those of links, bottom up; with named, marked elements count for themselves alone."""
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(c.split()))
            elif not (named and c.mark):
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += _links(c)
                n.link_tags += c.link_tags + (c.tag == "a")


def _trust(order: list[Node], body: Node) -> None:
    """Take the marks off headers of articles and off what holds most of the page's text."""
    _count(order, False)
    single = {n for n in order if n.mark and not any(isinstance(c, Node) and c.tag in BLOCK for c in n.children)}
    most = WRAPPER_SHARE * (body.chars - body.link_chars - sum(n.chars - _links(n) for n in single))
    heading, inside = {n for n in order if n.tag in HEADINGS}, set()
    for n in reversed(order):
        if n.parent is not None and n in heading:
            heading.add(n.parent)
    for n in order:
        if n.tag in ("article", "main") or n.parent in inside:
            inside.add(n)
        if (n.mark == "header" and (n in heading or n in inside)) or (n.mark in ("name", "header") and n not in single and n.chars - _links(n) > most):
            n.mark = None


def measure(body: Node) -> None:
    """Counts, composite densities and density sums of every node, without recursion."""
    order, todo = [], [body]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    _trust(order, body)
    _count(order, True)
    for n in order:
        n.weight = (1.0 if n.parent is None or n is body else n.parent.weight) * (NAME_WEIGHT if n.mark else 1.0)
    ratio = body.link_chars / max(1, body.chars)
    for n in reversed(order):
        if not n.chars:
            n.density = 0.0
        else:
            # zero counts of links and tags are taken as 1
            c, t, lc, lt = n.chars, max(1, n.tags), max(1, _links(n)), max(1, n.link_tags)
            base = math.log(c / max(1, c - _links(n)) * lc + ratio * c + math.e)
            n.density = n.weight * max(0.0, c / t * math.log(c / lc * t / lt) / math.log(base))
        # the blocks right below, also those inside inline elements
        n.inner = []
        for c in n.children:
            if isinstance(c, Node):
                n.inner += [c] if c.tag in BLOCK else c.inner
        n.sum = sum(c.density for c in n.inner) if n.inner else n.density
        n.top = n
        for c in n.inner:
            if c.top.sum > n.top.sum:
                n.top = c.top


def _headline(body: Node, chosen: set[Node]) -> list[Node]:
    """The last headline before the chosen subtrees and the blocks between, if those have none themselves.

    A named element, a page header or a block of mostly links in between parts them.
    """
    todo = [c for n in chosen for c in n.children if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        if n.tag in TITLES:
            return []
        todo += [c for c in n.children if isinstance(c, Node)]
    run, todo = [], [body]
    while todo:
        n = todo.pop()
        if n in chosen:
            return [] if n.tag in TITLES else run
        if n.mark or n.tag == "header" or (n is not body and not n.inner and 2 * _links(n) > n.chars):
            run = []
        elif n.tag in HEADINGS:
            run = [*run, n] if run and n.tag not in TITLES else [n]
        elif n.tag in BLOCK and not n.inner and n is not body:
            run = [*run, n] if run and n.chars else run
        else:
            todo += [c for c in reversed(n.inner)]
    return []


def content_nodes(body: Node) -> tuple[list[Node], set[Node]]:
    """The subtrees that hold the article, in no order, none within another, and the named elements in them that do not."""
    measure(body)
    core = body.top
    path, n = [], core
    while n is not None and n is not body:
        path.append(n)
        n = n.parent
    threshold = min((n.density for n in path if n.tag in BLOCK), default=body.density)
    leaves, todo = [], [core]
    while todo:
        n = todo.pop()
        todo += n.inner
        if not n.inner and n.density:
            leaves.append(n.density)
    leaf = LEAF_SHARE * sorted(leaves)[len(leaves) // 2] if leaves else 0.0
    chosen, todo = [core], [] if core is body else [body]
    while todo:
        n = todo.pop()
        for c in n.inner:
            if c in path:
                todo.append(c)
            elif c.density and c.density >= threshold - 1e-9:
                chosen.append(c.top)
                todo.append(c)
            elif not c.inner and n is not body and c.density and c.density >= leaf:
                chosen.append(c)  # a paragraph beside the core, inside what holds both
    # columns: unnamed blocks of the same element and class beside one that holds the core, few of whose characters are links
    for n in path:
        holder = n.parent
        while holder is not None and holder.tag not in BLOCK:
            holder = holder.parent
        if n.group and holder is not None:
            chosen += [c for c in holder.inner if c is not n and c.tag == n.tag and c.group == n.group and not c.mark and 3 * c.link_chars <= c.chars and c.chars]
    widened = set()
    for n in chosen:
        holder = n
        while n is not None:
            if n.tag in ("article", "main"):
                holder = n
            n = n.parent
        widened.add(holder)
    # headings right before a chosen subtree belong to it
    for n in list(widened):
        if n.parent is not None and n.tag not in ("article", "main", "body"):
            at = n.parent.children.index(n)
            for c in reversed(n.parent.children[:at]):
                if isinstance(c, Node) and c.tag in HEADINGS:
                    widened.add(c)
                elif not isinstance(c, str) or c.strip():
                    break
    widened |= set(_headline(body, widened))
    out = []
    for n in widened:
        p = n.parent
        while p is not None and p not in widened:
            p = p.parent
        if p is None:
            out.append(n)
    left, todo = set(), [c for n in out for c in n.children]
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            if n.mark and n.density < threshold and n not in path:
                left.add(n)
            else:
                todo += n.children
    return out, left


def blocks(body: Node, chosen: list[Node], left: set[Node]) -> list[str]:
    """Texts of the blocks under the chosen nodes, in page order, without what is left out."""
    out, held, keep = [], [], set(chosen)

    def flush():
        if held:
            if line := " ".join("".join(held).split()):
                out.append(line)
            held.clear()

    todo = [(body, body in keep, False)]
    while todo:
        n, inside, leaving = todo.pop()
        if isinstance(n, str):
            if inside:
                held.append(n)
            continue
        block = n.tag in BLOCK or n in keep
        if block:
            flush()
        if leaving or n in left:
            continue
        if n.tag == "br" and inside:
            held.append(" ")
        if block:
            todo.append((n, inside, True))
        todo += [(c, inside or c in keep, False) for c in reversed(n.children)]
    flush()
    return out


def extract(source: str | None) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    if not source:
        return ""
    body = parse(source)
    return "\n\n".join(blocks(body, *content_nodes(body)))


SCHEMA = "page_id long, url string, text string, n_chars long"


def _run(batches):
    for b in batches:
        texts = [extract(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html")).mapInArrow(_run, SCHEMA)
