"""Main text of web pages by tree scoring."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded_batches, numbered

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']+|"[^"]*"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</[^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Never text of the page.
NOT_TEXT = set("script style noscript template iframe object svg canvas select button textarea title head form nav footer aside menu dialog xmp noembed noframes audio video map".split())
#: Words of a class, an id or a role that mark what surrounds a main text.
AROUND = set(
    """nav navbar navigation menu masthead footer sidebar aside ad ads adv advert adverts advertisement advertising advertisements promo promotion sponsor sponsored banner
    cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations
    comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager toolbar widget widgets search complementary contentinfo skip tags byline outbrain taboola""".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: What keeps an unclosed paragraph from being closed by a block inside it.
SCOPE = set("article section div td th table body html main aside footer header nav form li dd blockquote figure button".split())
MAIN = {"article", "main"}
#: Elements nested deeper become siblings, as in browsers, so no walk up a tree is longer.
DEEPEST = 256


#: Why an element isn't main text: its name or its class says so, or its tag or that it's hidden.
SOFT, HARD = 1, 2


class Node:
    __slots__ = ("tag", "parent", "children", "around", "main", "depth")

    def __init__(self, tag: str, parent: Node | None, around: int = 0, main: bool = False):
        self.tag, self.parent, self.children, self.around, self.main = tag, parent, [], around, main
        self.depth = 0 if parent is None else parent.depth + 1


def _marks(names: str) -> bool:
    """Whether one of the class names, ids or roles marks a page's surroundings by its first or last word; with-sidebar and the like don't."""
    for name in names.split():
        words = [w.lower() for w in WORDS.findall(name)]
        if words and words[0] not in ("with", "has", "no", "is", "not") and not AROUND.isdisjoint((words[0], words[-1])):
            return True
    return False


def _node(tag: str, attributes: str, parent: Node) -> Node:
    around, main = HARD if tag in NOT_TEXT else 0, tag in MAIN
    if attributes and attributes != "/":
        got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = got.get("role", "").lower()
        main = main or role == "main" or got.get("itemprop", "") == "articleBody"
        if tag not in ("html", "body"):
            if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
                around = HARD
            elif not around and _marks(" ".join((got.get("class", ""), got.get("id", ""), role))):
                around = SOFT
    return Node(tag, parent, around, main and not around)


def tree(page: str) -> Node:
    """The page's elements as a tree. Forgives what is left open or closed twice: a block closes an open paragraph, items and
    cells close their siblings, an end tag closes the nearest element of its name unless a container lies between. What is nested
    more than DEEPEST deep stays in the tree, flat."""
    root = at = Node("html", None)
    flat: dict[str, int] = {}
    i, n = 0, len(page)
    for m in iter(lambda: TOKEN.search(page, i), None):
        if m.start() > i:
            at.children.append(page[i : m.start()])
        i = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if flat.get(tag):
                flat[tag] -= 1
                continue
            up = at
            while up is not root and up.tag != tag and not (up.tag in SCOPE and tag not in BLOCK) and not (up.tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "body", "html")):
                up = up.parent
            if up is not root and up.tag == tag:
                at = up.parent
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            up = at
            while up is not root and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up.tag == "p" and up is not root:
                at = up.parent
        if tag in CLOSES:
            same, stop = CLOSES[tag]
            up, last = at, None
            while up is not root and up.tag not in stop:
                if up.tag in same:
                    last = up
                up = up.parent
            if last is not None:
                at = last.parent
        node = _node(tag, attributes, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, i)
            node.children.append(page[i : end.start() if end else n])
            i = n if not end else page.find(">", end.start()) + 1 or n
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
            if node.depth < DEEPEST or (node.around and not at.around):  # what isn't main text keeps its element
                at = node
            else:
                flat[tag] = flat.get(tag, 0) + 1
    if i < n:
        at.children.append(page[i:])
    return root


def _clean(text: str) -> str:
    return SPACES.sub(" ", unescape(text) if "&" in text else text).strip()


def blocks(top: Node, leave_out: int = SOFT) -> list[tuple[Node, str, int]]:
    """(element, text, characters of it in links) of each run of text in page order; what isn't main text is left out.

    A header belongs to the page's frame unless it stands inside a main element. leave_out: SOFT or HARD.
    """
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    owner, linked = top, 0

    def flush():
        nonlocal run, linked
        if run:
            text = _clean("".join(run))
            if text:
                out.append((owner, text, linked))
        run, linked = [], 0

    todo: list = [(top, False, False, False)]
    while todo:
        x, inside, link, leave = todo.pop()
        if isinstance(x, str):
            run.append(x)
            if link:
                linked += len(_clean(x))
            continue
        block = x.tag in BLOCK
        if leave:
            flush()
            owner = x.parent or x
            continue
        if x is not top and (x.around >= leave_out or (x.tag == "header" and not inside)):
            if block:
                flush()
            continue
        if x.tag in ("br", "hr", "wbr", "img", "td", "th"):
            run.append(" " if x.tag != "wbr" else "")
        inside = inside or x.main
        link = link or x.tag == "a"
        if block:
            flush()
            owner = x
            todo.append((x, inside, link, True))
        todo += [(c, inside, link, False) for c in reversed(x.children)]
    flush()
    return out


def extract(page: str | None) -> str:
    """The main text; empty for a null or empty page and for pages without any.

    Each run of text gives its element's ancestors points: one, one for each comma, one for each hundred characters (three at
    most); all of them to the parent, half to the grandparent; less further up. A container's points are discounted by the
    share of its text that is in links. The best container is taken, grown to the main element around it if there is one,
    with those siblings that score a fifth of it or are long and nearly free of links.
    """
    if not page:
        return ""
    root = tree(page)
    found = blocks(root) or blocks(root, HARD)
    if not found:
        return ""
    points: dict[Node, float] = {}
    size: dict[Node, list[int]] = {}
    for node, text, linked in found:
        p = 1 + text.count(",") + min(len(text) // 100, 3)
        if linked > len(text) / 2:
            p = 0
        up = node.parent if node.tag in ("p", "pre", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "td", "blockquote") and node.parent else node
        level = 0
        while up is not None:
            points[up] = points.get(up, 0.0) + p / (1, 2, 6, 9)[min(level, 3)] / (1 if level < 4 else level)
            level, up = level + 1, up.parent
        up = node
        while up is not None and up not in size:  # what is above a known element is known
            size[up] = [0, 0]
            up = up.parent
        size[node][0] += len(text)
        size[node][1] += linked
    for x in sorted(size, key=lambda x: -x.depth):
        if x.parent is not None:
            size[x.parent][0] += size[x][0]
            size[x.parent][1] += size[x][1]
    value = {x: (points.get(x, 0.0) + (25 if x.main else 0)) * (1 - min(1.0, size[x][1] / max(1, size[x][0]))) for x in size}
    order = {x: k for k, x in enumerate(value)}
    best = max(value, key=lambda x: (value[x], -order[x]))
    up = best
    while up is not None:
        if up.main:
            best = up
        up = up.parent
    chosen = {best}
    if best.parent is not None:
        for x in best.parent.children:
            if isinstance(x, Node) and x is not best and x in size and not x.around:
                n, links = size[x]
                strong = value[x] >= max(5.0, value[best] / 5)
                if x.main and strong if best.main else strong or (x.tag in ("p", "h1") and links < 0.25 * n and (n >= 80 or x.tag == "h1")):
                    chosen.add(x)
    taken = dict.fromkeys(chosen, True)
    out = []
    for node, text, _ in found:
        way, up = [], node
        while up is not None and up not in taken:
            way.append(up)
            up = up.parent
        taken |= dict.fromkeys(way, up is not None and taken[up])
        if taken[node]:
            out.append(text)
    return " ".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per input row, from the whole html; null html gives an empty text. Ids may be null or repeated."""
    bounded_batches(pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            text = [extract(x.as_py()) for x in b.column(2)]
            yield batch(schema, b.column(0), b.column(1), text, [len(t) for t in text])

    rows = pages.select(numbered(id_col).alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
