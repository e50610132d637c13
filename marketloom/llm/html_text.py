"""The main text of web pages by scores of their element tree.

A page is read once into a tree. Subtrees that are never article text (scripts, menus, footers,
sidebars, notices, adverts, forms, reader comments, by element, role or the words of class and
id) are left out. Each paragraph passes points for its length and commas to its ancestors, a
container's sum is discounted by the share of its text that stands in links, and the best
container is kept with those siblings that score like it. What it holds comes out block by block.

Pages are independent: tasks read them in Arrow batches, nothing is shuffled. Every step is linear
in the page's length, but for a logarithm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import textbatch as tb
from marketloom.llm.scratch import table

#: Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe noscript".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements whose content is never article text.
NEVER = frozenset("head nav footer aside form button select option optgroup input fieldset datalist dialog menu svg canvas audio video object applet map template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
WHOLE = frozenset("html body main article".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {
    "p": frozenset(
        "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
    ),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "a": frozenset(["a"]),
    **{h: HEADINGS for h in HEADINGS},
}
#: Elements that an implied or unmatched end does not reach out of.
FENCES = frozenset("table td th ul ol dl article main section body html".split())

#: Words of class or id, and roles, of what is not the article.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted outbrain taboola "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager pagenav toolbar topbar masthead skip "
    "header footer foot colophon copyright legal disclaimer sidebar sidebars rail aside widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup popover modal overlay lightbox interstitial paywall "
    "comment comments commentlist commentform replies reply respond disqus discussion feedback "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchbox form tags".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar tablist".split())
BEGINNINGS = ("cookie", "advert", "sidebar", "sponsor", "newsletter", "breadcrumb")
#: Of those, what has articles of its own.
OWN_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended widget".split())
#: A word before a word of CLUTTER that says that it is not there, as in "no-sidebar".
NOT_THERE = frozenset("has with without no non not hide free".split())

_TAG = re.compile(r"<(?:(?P<close>/)?(?P<name>[A-Za-z][^\s/>]*)|(?P<comment>!--)|[!?/])")
_EDGE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NO_BLOCK = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_KEEP, _TITLES, _SKIP = 0, 1, 2
#: The parts of a paragraph's points that its ancestors get, from the nearest on.
SHARES = (1, 2, 6, 9, 12, 15)
#: Code points of a text that is an article whatever its classes say.
LONG = 250


def _clutter(names: str) -> set[str]:
    """The words of these classes and ids that say that the element is not article text."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for k, w in enumerate(words):
            if (w in CLUTTER or w.startswith(BEGINNINGS)) and not (k and words[k - 1] in NOT_THERE):
                found.add(w)
    return found


def _verdict(name: str, attrs: str, in_article: bool, by_class: bool) -> int:
    """Whether an element's subtree is kept, skipped, or kept only in its headings."""
    if name in NEVER:
        return _SKIP
    if name == "header":
        return _TITLES if in_article else _SKIP
    if not attrs or attrs.isspace():
        return _KEEP
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _NO_BLOCK.search(found.get("style", "")):
        return _SKIP
    if name in ("html", "body", "main") or not by_class:
        return _KEEP
    if found.get("role", "").lower() in ROLES:
        return _SKIP
    words = set() if name in INLINE and name != "span" else _clutter(f"{found.get('class', '')} {found.get('id', '')}")
    if not words:
        return _KEEP
    if in_article and words == {"header"}:
        return _TITLES
    # classes of an article say much about the page around it
    return _KEEP if name == "article" and not in_article and not words & OWN_ARTICLES else _SKIP


class Tree:
    """Elements of a page in order of their start tags, with the text they hold.

    ``pieces`` has the text in page order as (element, in a link, text); a None as text ends the
    block before it. ``first`` and ``last`` say which pieces lie within an element, ``box`` is the
    nearest element, itself included, that is not inline.
    """

    def __init__(self, page: str, by_class: bool = True) -> None:
        self.name, self.parent, self.box, self.first, self.last = ["#page"], [-1], [0], [0], [0]
        self.pieces: list[tuple[int, bool, str | None]] = []
        self._stack = [0]
        self._mode = [_KEEP]  # what holds within each open element
        # for each open element the place of the nearest one, itself included, of two kinds
        self._solid, self._fence = [0], [0]
        self._where: dict[str, list[int]] = {}
        self._read(page, by_class)

    def _open(self, name: str) -> bool:
        return bool(self._where.get(name))

    def _enter(self, name: str, mode: int) -> None:
        k, place, inline = len(self.name), len(self._stack), name in INLINE
        self.name.append(name)
        self.parent.append(self._stack[-1])
        self.box.append(self.box[self._stack[-1]] if inline else k)
        self.last.append(0)
        if not inline:
            self.pieces.append((self._stack[-1], False, None))
        self.first.append(len(self.pieces))
        self._solid.append(self._solid[-1] if inline else place)
        self._fence.append(place if name in FENCES else self._fence[-1])
        self._where.setdefault(name, []).append(place)
        self._stack.append(k)
        self._mode.append(mode)

    def _leave(self, place: int) -> None:
        """Close the open elements from this place on."""
        while len(self._stack) > place:
            k = self._stack.pop()
            for held in (self._mode, self._solid, self._fence, self._where[self.name[k]]):
                held.pop()
            self.last[k] = len(self.pieces)
            if self.name[k] not in INLINE:
                self.pieces.append((self.parent[k], False, None))

    def _text(self, value: str) -> None:
        mode = self._mode[-1]
        if value and (mode == _KEEP or mode == _TITLES and any(self._open(h) for h in HEADINGS)):
            self.pieces.append((self._stack[-1], self._open("a"), value))

    def _read(self, page: str, by_class: bool) -> None:
        at, size = 0, len(page)
        while at < size:
            m = _TAG.search(page, at)
            if not m:
                self._text(page[at:])
                break
            self._text(page[at : m.start()])
            if m["comment"]:
                end = page.find("-->", m.start() + 2)  # "<!-->" is a whole comment
                at = size if end < 0 else end + 3
                continue
            end = self._tag_end(page, m.end()) if m["name"] else page.find(">", m.end())
            if end < 0:
                break  # a tag that does not end is no text
            attrs, at = page[m.end() : end], end + 1
            name = (m["name"] or "").lower()
            if not name:
                continue
            if m["close"]:
                self._end(name)
            elif name in RAW:
                shut = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", shut.end()) if shut else -1
                at = size if end < 0 else end + 1
            elif name == "br":
                self._text(" ")
            elif name == "hr":
                self.pieces.append((self._stack[-1], False, None))
            elif name not in VOID and not (name == "svg" and attrs.endswith("/")):
                self._start(name, attrs, by_class)
        self._leave(1)
        self.last[0] = len(self.pieces)

    def _tag_end(self, page: str, at: int) -> int:
        """Where the > of a tag is, outside quotes; a quote that never closes is none."""
        while edge := _EDGE.search(page, at):
            if edge[0] == ">":
                return edge.start()
            end = page.find(edge[0], edge.end())
            if end < 0:
                return page.find(">", edge.end())
            at = end + 1
        return -1

    def _start(self, name: str, attrs: str, by_class: bool) -> None:
        for ended, by in ENDS.items():
            if name in by and self._open(ended) and self._where[ended][-1] > self._fence[-1] - (ended in FENCES):
                self._leave(self._where[ended][-1])
        mode = self._mode[-1]
        if mode != _SKIP:
            own = _verdict(name, attrs, self._open("article") or self._open("main"), by_class)
            mode = _SKIP if own == _SKIP else max(mode, own)
        self._enter(name, mode)

    def _end(self, name: str) -> None:
        if not self._open(name):
            return
        place = self._where[name][-1]
        if name in INLINE and place < self._solid[-1]:
            return  # an inline element does not end through others
        self._leave(place)

    def blocks(self) -> list[tuple[int, int, int, str, int]]:
        """Blocks of text: their first and last piece, element, text and characters in links."""
        out: list[tuple[int, int, int, str, int]] = []
        start, parts, linked, owner = 0, [], 0, 0
        for k, (element, link, value) in enumerate([*self.pieces, (0, False, None)]):
            if value is not None:
                if not parts:
                    start, owner = k, element
                parts.append(value)
                linked += 0 if not link else len(html.unescape(value)) if "&" in value else len(value)
            elif parts:
                joined = "".join(parts)
                whole = " ".join((html.unescape(joined) if "&" in joined else joined).split())
                if whole:
                    out.append((start, k, self.box[owner], whole, min(linked, len(whole))))
                parts, linked = [], 0
        return out


def points(text: str) -> float:
    """What a paragraph gives to its ancestors: for being one, for commas and for length."""
    if len(text) < 25:
        return len(text) / 100
    return 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)


def _above(tree: Tree, k: int) -> int:
    """The container around one, -1 around the page."""
    return tree.box[tree.parent[k]] if k > 0 else -1


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by line ends; empty if there is none."""
    if not page:
        return ""
    text = _main(Tree(page))
    if not text:  # a long text whose classes all say clutter is an article even so
        text = _main(Tree(page, by_class=False))
        text = text if len(text) >= LONG else ""
    return text


def _main(tree: Tree) -> str:
    blocks = tree.blocks()
    if not blocks:
        return ""
    count = len(tree.name)
    score, total, linked = [0.0] * count, [0] * count, [0] * count
    for _, _, owner, text, in_links in blocks:
        total[owner] += len(text)
        linked[owner] += in_links
        if tree.name[owner] in HEADINGS:
            continue
        # a paragraph's own element is no container; loose text counts for the one it stands in
        box, value = (_above(tree, owner) if tree.name[owner] in PARAGRAPHS else owner), points(text) * (1 - in_links / len(text))
        for share in SHARES:
            if box < 0:
                break
            score[box] += value / share
            box = _above(tree, box)
    for k in range(count - 1, 0, -1):  # parents come before their children
        total[tree.parent[k]] += total[k]
        linked[tree.parent[k]] += linked[k]
    final = [s * (1 - lk / t) if t else 0.0 for s, t, lk in zip(score, total, linked, strict=True)]
    best = max(range(count), key=lambda k: (final[k], -k))
    if not final[best]:  # headings or links alone
        inside = [k for k in range(count) if tree.name[k] in ("article", "main") and total[k]]
        if not inside:
            return ""
        best = inside[0]
    # what is marked as an article is one, with all its parts
    k = best
    while k > 0 and tree.name[k] != "article":
        k = tree.parent[k]
    best = k if k > 0 else best
    ended = {owner: text.rstrip("\"')”’»")[-1:] in tuple(".!?…。") for _, _, owner, text, _ in blocks}
    chosen = {best} | _siblings(tree, best, final, total, linked, ended)
    ranges = sorted((tree.first[k], tree.last[k]) for k in chosen)
    menus = sorted((tree.first[k], tree.last[k]) for k in _menus(tree, total, linked))
    out, r, m, skip_to = [], 0, 0, 0
    for start, _, _, text, _ in blocks:
        while r < len(ranges) and ranges[r][1] <= start:
            r += 1
        if r == len(ranges):
            break
        while m < len(menus) and menus[m][0] <= start:
            skip_to, m = max(skip_to, menus[m][1]), m + 1
        if ranges[r][0] <= start and start >= skip_to:
            out.append(text)
    return "\n".join(out)


def _siblings(tree: Tree, best: int, final: list[float], total: list[int], linked: list[int], ended: dict[int, bool]) -> set[int]:
    """Siblings of the best container that belong to the article: containers of at least a fifth
    of its score, headings, and paragraphs that are long or end as sentences do, with few links."""
    if best == 0 or tree.name[best] in WHOLE - {"article"}:
        return set()
    out, least = set(), max(0.2 * final[best], 1.0)
    for k in range(tree.parent[best] + 1, len(tree.name)):
        if tree.parent[k] != tree.parent[best] or k == best or not total[k]:
            continue
        name, dense = tree.name[k], linked[k] / total[k]
        if name in HEADINGS or name in ("p", "blockquote", "pre"):
            if tree.name[best] != "article" and dense < 0.25 and (name in HEADINGS or total[k] >= 80 or not dense and ended.get(k)):
                out.add(k)
        elif name not in INLINE and final[k] >= least and (name == "article") == (tree.name[best] == "article"):
            out.add(k)
    return out


def _menus(tree: Tree, total: list[int], linked: list[int]) -> list[int]:
    """Lists, tables and boxes of links: at least two thirds of the text, in three links or more."""
    anchors = [0] * len(tree.name)
    for k in range(len(tree.name) - 1, 0, -1):
        anchors[k] += tree.name[k] == "a"
        anchors[tree.parent[k]] += anchors[k]
    return [k for k in range(1, len(tree.name)) if tree.name[k] in ("ul", "ol", "dl", "div", "section", "table") and anchors[k] >= 3 and 3 * linked[k] >= 2 * total[k] > 0]


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The columns of ``pages`` but for the html, and the main text as ``out_col``.

    * A null or empty page, or one without text, has an empty text.
    * Repeated rows come out as often as they stand; a column of ``pages`` that is called like
      ``out_col`` gives way. An empty table gives an empty table.
    * Tags, quotes and comments that do not close, stray end tags and any depth of nesting are
      read as browsers do, or dropped to the page's end.
    * A page of headings or links alone has a text only if it marks an article.
    """
    others = [c for c in pages.columns if c not in (html_col, out_col)]
    source = tb.free("__html", others)
    rows = pages.select(*[F.col(c) for c in others], F.col(html_col).alias(source))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, source):
                texts = pa.array([main_text(p) for p in part.column(source).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*others, out_col])

    schema = rows.select(*others, F.lit("").alias(out_col)).schema
    return rows.mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_text`` over all pages."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


#: The pages of the given tables mark one article each, of headings and paragraphs; SQL cuts that
#: out. Scores and clutter inside an article are beyond it and are tested on small pages.
SQL = r"""
WITH art AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS a FROM pages),
cut AS (SELECT page_id, url, string_split_regex(a, '</?(?:p|h[1-6])>') AS parts FROM art),
plain AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS parts
  FROM cut)
SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10)))::BIGINT AS n_chars FROM plain
"""
