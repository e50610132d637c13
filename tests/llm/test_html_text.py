"""Main texts: pages by hand, a plain recursion over a parsed tree, pages that do not end."""

from __future__ import annotations

import random
import time
from html.parser import HTMLParser

import pytest

from marketloom.llm import html_text as ht

PAGES = "page_id long, url string, html string, text string, n_chars string"
LONG = "This is a paragraph, long enough to count, with some commas, and a few more words in it."
CASES = {
    # menus, headers, footers, sidebars, notices, adverts, forms, comments by element
    "elements": (
        f"<!doctype html><title>no</title><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><main><article><h1>Title</h1><p>{LONG}<script>x('<p>')</script><p>Two<br>lines</article></main>"
        f"<aside><p>{LONG}</aside><form><p>{LONG}</form><footer>&copy; x</footer>",
        f"Title\n{LONG}\nTwo lines",
    ),
    # the same by class, id and role
    "classes": (
        f'<div class="top-menu">a</div><div id="cookieNotice"><p>{LONG}</p></div><div role="navigation">n</div><div class="post"><h2>Title</h2><p>{LONG}</p><div class="ad-slot">buy</div><p>End.</p></div>'
        f'<div id="comments"><div class="comment"><p>{LONG} {LONG} {LONG}</p></div></div><div class="sidebar-widget"><p>{LONG}</p></div>',
        f"Title\n{LONG}\nEnd.",
    ),
    "no classes": (f"<div><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><h1>Head</h1><div><p>{LONG}</p><p>Short.</p></div><div>bottom line</div>", f"Head\n{LONG}\nShort."),
    "links in the text stay": (f"<div><p>{LONG} <a href=1>a link</a></p><ul><li><a href=1>first link</a><li><a href=2>second</a><li><a href=3>third</a></ul></div>", f"{LONG} a link"),
    "comments inside the article": (f'<article><p>{LONG}</p><section class="reader-comments"><article><p>{LONG} {LONG}</p></article></section></article>', LONG),
    "not there": (f'<body class="has-sidebar no-comments"><div class="content with-sidebar"><p>{LONG}</p></div>', LONG),
    "header of an article": (f'<article><header><h1>Title</h1><p>By me</p></header><p>{LONG}</p></article>', f"Title\n{LONG}"),
    "references": ("<p>a &amp;&lt;b&gt; &eacute;&#233;&#xe9; &nbsp; c &unknown; &am\n\td</p>", "a &<b> ééé c &unknown; &am d"),
    "short article": ("<article><h1>Only a title</h1></article>", "Only a title"),
    "tables": (f"<article><table><tr><td>a<td>b<tr><td>c</table><p>{LONG}</article>", f"a\nb\nc\n{LONG}"),
    "unclosed": (f"<article><p><b>One.<br><p>Two</b> three<i>.<p>{LONG}", f"One.\nTwo three.\n{LONG}"),
    "hidden": (f'<div><p>{LONG}</p><p hidden>no</p><p style="display: none">no</p><div aria-hidden="true">no</div></div>', LONG),
    "two halves": (f"<div><p>{LONG}</p></div><div><p>{LONG} More.</p></div>", f"{LONG}\n{LONG} More."),
    "quotes in tags": ("<p title='a > b' data-x=\"<p>\">text, that is</p>", "text, that is"),
    "only clutter": ("<nav><a href=1>a</a></nav><div class=ad>Buy now.</div><footer>x</footer>", ""),
    "null": (None, ""), "empty": ("", ""), "blank": (" \n ", ""), "no markup": ("just, plain words", "just, plain words"),
}


@pytest.mark.parametrize("name", list(CASES))
def test_by_hand(name):
    page, want = CASES[name]
    assert ht.main_text(page) == want


class Element(HTMLParser):
    """A tree of well-formed pages: [name, class, children], texts as strings."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = ["#page", "", []]
        self.stack = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, name, attrs):
        node = [name, dict(attrs).get("class") or "", []]
        self.stack[-1][2].append(node)
        if name != "br":
            self.stack.append(node)

    def handle_endtag(self, name):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def plain(page):
    """The same rules by recursion: paragraphs, points, link density, best container, siblings."""
    gone = ("nav", "footer", "aside", "form", "script", "style")
    parents, order = {}, []

    def keep(node, up):
        parents[id(node)] = up
        order.append(node)
        node[2] = [x for x in node[2] if isinstance(x, str) or not (x[0] in gone or x[1] in ("ad", "comments", "menu"))]
        for x in node[2]:
            if not isinstance(x, str):
                keep(x, node)

    root = Element(page).root
    keep(root, None)

    def text(node):
        return "".join(x if isinstance(x, str) else " " if x[0] == "br" else text(x) for x in node[2])

    def linked(node):
        return sum(len(text(x)) if x[0] == "a" else linked(x) for x in node[2] if not isinstance(x, str))

    score = {id(n): 0.0 for n in order}
    for n in order:
        if n[0] == "p" and (t := " ".join(text(n).split())):
            value = (1 + t.count(",") + min(len(t) // 100, 3) if len(t) >= 25 else len(t) / 100) * (1 - min(linked(n), len(t)) / len(t))
            up = parents[id(n)]
            for share in (1, 2, 6, 9, 12, 15):
                if up is None:
                    break
                score[id(up)] += value / share
                up = parents[id(up)]

    def size(n):
        return sum(len(" ".join(text(p).split())) for p in paragraphs(n))

    def paragraphs(n):
        return [n] if n[0] in ("p", "h2") else [p for x in n[2] if not isinstance(x, str) for p in paragraphs(x)]

    final = {id(n): score[id(n)] * (1 - sum(min(linked(p), len(" ".join(text(p).split()))) for p in paragraphs(n)) / size(n)) if size(n) else 0.0 for n in order}
    best = max(order, key=lambda n: (final[id(n)], -order.index(n)))
    if not final[id(best)]:
        return ""
    chosen = [best]
    up = parents[id(best)]
    if up is not None and best[0] not in ("html", "body"):
        chosen = []
        for x in up[2]:
            if isinstance(x, str):
                continue
            t = " ".join(text(x).split())
            dense = sum(linked(p) for p in paragraphs(x)) / max(1, size(x))
            if x is best or x[0] == "h2" and t and dense < 0.25 or x[0] == "p" and t and dense < 0.25 and (len(t) >= 80 or not dense and t.endswith(".")) or x[0] == "div" and final[id(x)] >= max(0.2 * final[id(best)], 1.0):
                chosen.append(x)
    return "\n".join(t for c in chosen for p in paragraphs(c) if (t := " ".join(text(p).split())))


def random_page(r):
    words = lambda: " ".join(r.choice(["alpha", "beta,", "gamma", "delta.", "&amp;", "épsilon"]) for _ in range(r.choice([1, 3, 12, 40])))

    def block(depth):
        kind = r.random()
        if kind < 0.55 or depth > 4:
            inner = words() + (f" <a href='x'>{words()}</a>" if r.random() < 0.2 else "") + (" <b>bold</b>" if r.random() < 0.2 else "") + r.choice(["", ".", "<br>x"])
            return f"<{t}>{inner}</{t}>" if (t := r.choice(["p", "p", "p", "h2"])) else ""
        if kind < 0.7:
            t = r.choice(["nav", "footer", "aside", "form"])
            return f"<{t}>{block(depth + 1)}</{t}>"
        c = r.choice(["", "", "", ' class="ad"', ' class="comments"', ' class="story"'])
        return f"<div{c}>{''.join(block(depth + 1) for _ in range(r.randrange(1, 5)))}</div>"

    return f"<html><body>{''.join(block(0) for _ in range(r.randrange(1, 6)))}</body></html>"


def test_equals_a_plain_recursion(monkeypatch):
    monkeypatch.setattr(ht, "LONG", 10**9)  # the second reading, without classes, is tested by hand
    monkeypatch.setattr(ht, "_menus", lambda *a: [])
    r = random.Random(2)
    pages = [random_page(r) for _ in range(1500)]
    wrong = [p for p in pages if ht.main_text(p) != plain(p)]
    assert not wrong, (len(wrong), wrong[0], ht.main_text(wrong[0]), plain(wrong[0]))
    assert sum(bool(plain(p)) for p in pages) > 1000


def test_long_text_in_clutter_alone_is_read_again():
    page = f'<div class="widget"><p>{LONG} {LONG} {LONG}</p></div>'
    assert ht.main_text(page) == f"{LONG} {LONG} {LONG}" and ht.main_text(page.replace(f"{LONG} {LONG} {LONG}", "Short.")) == ""


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "<p>x</p>" * 30_000, "<div>" * 50_000 + "text, more", '<a "' * 30_000, "<b><p>" + "<i>" * 30_000 + "</b>" * 30_000, "<p>a, b" * 50_000, "<!--" * 50_000, "<" * 500_000, "<script>" * 30_000, "&" * 500_000, "<p>" + "word, " * 500_000])
def test_time_is_in_proportion_to_the_page(page):
    begun = time.time()
    ht.main_text(page)
    assert time.time() - begun < 20


def test_table_with_odd_rows(spark):
    rows = [(1, "u", CASES["elements"][0], "clash", "x"), (1, "u", CASES["elements"][0], "clash", "x"), (None, None, None, None, None), (3, "v", "", "", "")]
    df = spark.createDataFrame(rows, PAGES)
    out = sorted((str(r.page_id), r.text, r.n_chars) for r in ht.extract_text(df).collect())
    assert out == sorted([("1", CASES["elements"][1], "x")] * 2 + [("None", "", None), ("3", "", "")])
    assert ht.extract_text(df.limit(0)).count() == 0
