import random
import time

import pytest

from tessera.llm import html

P = "This is a sentence, with commas, and enough length to look like a paragraph of an article."
FRAME = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site name</header>{}<aside>Other</aside><footer>&copy; x, y, z and a long line of legal text, with commas, here</footer>'
CASES = [
    (f"<article><h1>T &amp; U</h1><p>{P}</p></article>", f"T & U {P}"),
    (f"<article><header><h1>T</h1></header><p>{P}<br>next\n line</p></article>", f"T {P} next line"),
    (f"<article><p><b>{P}<br><p>{P}</b></p><p>x</p></article>", f"{P} {P} x"),
    (f"<div class='page with-sidebar'><div id='content'><h1>T</h1><p>{P}</p><p>{P}</p><p>tiny</p></div><div class='sidebar'><p>{P} {P} {P}</p></div></div>", f"T {P} {P} tiny"),
    (f"<main><p>{P}</p><form><p>{P}</p></form><div class='comments'><article><p>{P}</p></article></div><script>if (a < b) '<p>'</script><style>p{{}}</style></main>", P),
    (f"<div><p>{P}</p><p>{P}</p><div class='cookie-notice'>{P}</div><div class='ad'>{P}</div><!-- <p>gone</p> --></div>", f"{P} {P}"),
    (f"<div><ul><li><a>{P}</a><li><a>{P}</a></ul></div><div><p>{P}<p>{P}</div>", f"{P} {P}"),
    ("<article><p>short</p></article>", "short"),
    (f"<article><table><tr><td>a<td>b</table><p>{P}</p><ul><li>one<li>two</ul></article>", f"a b {P} one two"),
    (f"<article hidden><p>{P}</p></article><div><p>{P} seen</p></div>", f"{P} seen"),
    (f"<article><p>a &#233;&nbsp;&lt;b&gt; {P}</article>", f"a é <b> {P}"),
    (f"<ARTICLE CLASS=x data-q='>'><P>{P}</P></ARTICLE>", P),
]


@pytest.mark.parametrize("inner,want", CASES)
def test_extract(inner, want):
    for page in (f"<!DOCTYPE html><html><head><title>No</title></head><body>{FRAME.format(inner)}</body></html>", FRAME.format(inner)):
        assert html.extract(page) == want


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<nav>only</nav>", "<script>x", "</p></div>", "<!--"])
def test_nothing(page):
    assert html.extract(page) in ("", "<", "<p")


def test_plain_text():
    assert html.extract("just  text") == "just text"
    deep = "<div>" * 3000 + P + "</div>" * 3000
    assert html.extract(deep) == P


def test_frames(spark):
    rows = [(1, "u", f"<article><p>{P}</p></article>"), (2, None, None), (None, "v", ""), (1, "u", "<article>" + f"<p>{P}</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = html.main_text(df).collect()
    assert [tuple(r) for r in got] == [(i, u, html.extract(h), len(html.extract(h))) for i, u, h in rows]
    assert got[3].n_chars == 5000 * (len(P) + 1) - 1
    assert html.main_text(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    """Text at every level of unclosed elements, stray end tags at the bottom: twice the page, about twice the time."""

    def took(n):
        began = time.process_time()
        text = html.extract("".join(f"<div>line {i}, and more words here " for i in range(n)) + "</h6>" * n)
        assert len(text) > 20 * (n - 300)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 5 * took(8_000)


def test_closed_deep_elements_stay_apart():
    page = "<div>" * 600 + "deep" + "</div>" * 600 + f"<article><p>{P}</p></article>"
    assert html.extract(page) == P
    assert html.extract("<div>" * 600 + f"<p>{P}</p><nav>no</nav><p>{P}</p>" + "</div>" * 600) == f"{P} {P}"


def slow_extract(page):
    """The scoring in plain loops: every text walks to the root for its points, its size, and whether it's chosen."""
    root = html.tree(page)
    found = html.blocks(root) or html.blocks(root, html.HARD)
    if not found:
        return ""

    def up(x):
        while x is not None:
            yield x
            x = x.parent

    inner = ("p", "pre", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "td", "blockquote")
    points, size, linked = {}, {}, {}
    for node, text, links in found:
        p = 0 if links > len(text) / 2 else 1 + text.count(",") + min(len(text) // 100, 3)
        for level, x in enumerate(up(node.parent if node.tag in inner and node.parent else node)):
            points[x] = points.get(x, 0.0) + p / (1, 2, 6, 9)[min(level, 3)] / (1 if level < 4 else level)
        for x in up(node):
            size[x], linked[x] = size.get(x, 0) + len(text), linked.get(x, 0) + links
    value = {x: (points.get(x, 0.0) + (25 if x.main else 0)) * (1 - min(1.0, linked[x] / max(1, size[x]))) for x in size}
    best = max(value, key=lambda x: value[x])  # the first of equals
    for x in up(best):
        best = x if x.main else best
    chosen = {best}
    for x in best.parent.children if best.parent else ():
        if isinstance(x, html.Node) and x is not best and x in size and not x.around:
            strong = value[x] >= max(5.0, value[best] / 5)
            if x.main and strong if best.main else strong or (x.tag in ("p", "h1") and linked[x] < 0.25 * size[x] and (size[x] >= 80 or x.tag == "h1")):
                chosen.add(x)
    return " ".join(text for node, text, _ in found if any(x in chosen for x in up(node)))


@pytest.mark.parametrize("seed", range(60))
def test_scoring_equals_plain_loops(seed):
    rng = random.Random(seed)

    def some(depth):
        out = ""
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.35 or depth > 5:
                out += f"<p>{' '.join(rng.choices(['word', 'comma,', 'longer', '<a>link text</a>', '<b>bold</b>'], k=rng.randint(1, 40)))}</p>"
            elif kind < 0.45:
                out += "".join(f"<li><a>entry {k}</a></li>" for k in range(rng.randint(1, 5)))
            else:
                tag = rng.choice(["div", "div", "section", "article", "td", "ul", "div class=sidebar", "main", "blockquote", "h1"])
                out += f"<{tag}>{some(depth + 1)}" + (f"</{tag.split()[0]}>" if rng.random() < 0.9 else "")
        return out

    page = f"<html><body>{some(0)}</body></html>"
    assert html.extract(page) == slow_extract(page)
