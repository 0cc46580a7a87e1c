"""Main text of HTML pages by tag-path ratios.

Every text node belongs to the path of tags from the root to it.  Per path the
text length, punctuation, link text and number of nodes are added up.  A path's
ratio is text per node, its punctuation ratio punctuation per node, on a
logarithmic scale.  Ratios
are smoothed twice: along the page, over the sequence of nodes with a Gaussian,
and upwards, with the ratio of the container (the nearest sectioning ancestor),
so that a heading shares in the weight of the article around it.  Text and
punctuation ratios are fused by their product, damped by the share of link
text; this is smoothed upwards too, so that a linked heading or a list of sources
shares in the text around it.  Paths above a threshold set from the fused scores' spread are content,
and the container that holds most content decides which of them belong to the
article.  An element whose tag, role, class or id names boilerplate (menus,
adverts, comments, ...) is a hit; the hits of one path are judged together.
A hit with less than half of the page's text outside links has weight zero (a
discussion with less than 0.9 of it); above that its weight rises to one, for the
word then names a wrapper or a layout.  A hit does not reach into an article or
main element inside it, unless one outside all hits holds more text.  Elements that
are never wrappers (nav, footer, aside, button, ...) always have weight zero.  Where
all text is below hits, the heaviest that can be a wrapper has weight one.

Decisions are about paths, never about single nodes: a short paragraph stays
with its long siblings.

Defined cases: null or empty html gives the empty text; so does a page without
content; character references are decoded once; markup that never closes is
read to the end of the page; plain text without tags is its own content;
repeated rows give equal results; extra columns are ignored; an empty table
gives no rows; pages of any length are read whole.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, map_rows, table

# Fixed values of the HTML standard: elements without content, raw text elements, and elements that are not phrasing content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title xmp noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary
    table tbody td tfoot th thead tr ul""".split())
# A start tag closes these open elements (end tags that the standard lets authors leave out).
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option tbody td tfoot th thead tr summary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
# How far such a start tag looks: never out of these elements.
SCOPE = frozenset("article aside body div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())
CONTAINERS = frozenset("article main section div body td html".split())
# Words that name boilerplate in tags, roles, classes and ids.
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog head input label fieldset search".split())
BOILER_ROLES = frozenset("""navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status
    tablist tooltip""".split())
BOILER_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promos promotion
    banner cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog nav navbar navigation menu menus
    breadcrumb breadcrumbs sidebar sidebars side aside rail widget widgets footer foot bottom header masthead topbar toolbar comment comments
    commentlist reply replies respond discussion disqus share sharing social related recommended recommendations
    subscribe subscription newsletter signup login register search searchbox form pagination pager paging tags tagcloud toc
    copyright legal disclaimer skip print hidden""".split())
NEVER_WRAPPERS = frozenset("nav footer aside button select menu dialog head input label".split())
DISCUSSION = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
NEGATIONS = frozenset("no non not without with has".split())  # "no-sidebar" names the page's layout, not a sidebar
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
# An attribute as the standard reads it: a value without quotes ends at white space or ">" and may hold quotes.
_ATTR_NAME = r"(?:=[^\s/>=]*+|[^\s/>=]++)"
_ATTR_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)"""
_ATTR = re.compile(rf"({_ATTR_NAME})(?:\s*+=\s*+({_ATTR_VALUE})?+)?+")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                  rf"((?:[\s/]++|{_ATTR_NAME}(?:\s*+=\s*+(?:{_ATTR_VALUE})?+)?+)*+)(?:>|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[a-z]+(?:-[a-z]+)*")


def _hit(tag: str, attributes: str, inside_article: bool) -> float | None:
    """Share of the page's text from which an element that names boilerplate is taken for a wrapper; None if it names none."""
    if tag in BOILER_TAGS or (tag == "header" and not inside_article):
        return 1.0 if tag in NEVER_WRAPPERS else 0.5
    if not attributes or tag in ("html", "body", "article", "main"):
        return None
    hidden = False
    for name, value in _attributes(attributes).items():
        value = value.lower()
        hidden = hidden or name == "hidden"
        if name == "role" and value.strip() in BOILER_ROLES or name == "aria-hidden" and value.strip() == "true":
            return 0.5
        if name in ("class", "id"):
            for word in re.split(r"[\s_]+", value):
                parts = word.strip("-0123456789").split("-")
                if parts[0] not in NEGATIONS and any(p in BOILER_WORDS and (p != "header" or not inside_article) for p in parts):
                    return 0.9 if DISCUSSION.intersection(parts) else 0.5
    return 0.5 if hidden else None


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-cased name; of attributes that repeat a name, the first."""
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip(value[0]) if value[:1] in ("'", '"') else value))
    return found


class Paths:
    """The page's paths as a tree of numbered steps, a parent always before its children; 0 is the root.

    A path costs one step, however deep it lies: pages of thousands of unclosed elements stay linear.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.container, self.outermost = [0], [""], [0], [0]
        self._known: dict[tuple[int, str, str], int] = {}

    def child(self, parent: int, tag: str, label: str) -> int:
        path = self._known.setdefault((parent, tag, label), len(self.tag))
        if path == len(self.tag):
            self.parent.append(parent)
            self.tag.append(tag)
            self.container.append(path if tag in CONTAINERS else self.container[parent])  # the nearest sectioning ancestor
            self.outermost.append(self.outermost[parent] or (path if tag in ("article", "main") else 0))
        return path

    def below(self, home: int) -> list[bool]:
        """For each path, whether it is ``home`` or lies below it."""
        inside = [False] * len(self.tag)
        for path, parent in enumerate(self.parent):
            inside[path] = path == home or path > home and inside[parent]
        return inside


class Node:
    """A block of text: consecutive text of one block element."""

    __slots__ = ("path", "container", "parts", "linked", "hits", "around", "article")

    def __init__(self, path: int, container: int, hits: tuple, around: tuple, article: int) -> None:
        self.path, self.container, self.parts, self.linked = path, container, [], 0
        self.hits, self.around, self.article = hits, around, article


def blocks(page: str) -> tuple[list[Node], Paths]:
    """Text blocks in page order, each with the path of its block elements and hits, and the tree of paths.

    ``hits`` are (path, wrapper share) of the hits above the block, ``article`` is the path of the outermost
    article or main element and ``around`` the hits that this element lies in; these are not among ``hits``.
    """
    # (tag, path of block elements and hits so far, hits, hits around the article, article)
    stack: list[tuple[str, int, tuple, tuple, int]] = [("", 0, (), (), 0)]
    paths = Paths()
    found: list[Node] = []
    node: Node | None = None
    at, links, in_article = 0, 0, 0

    def text(raw: str) -> None:
        nonlocal node
        if not raw:
            return
        if node is None:
            if not raw.strip(" \t\n\r\f"):
                return
            path = stack[-1][1]
            node = Node(path, paths.container[path], *stack[-1][2:])
            found.append(node)
        node.parts.append(raw)
        if links:
            node.linked += len(raw)

    def pop_to(k: int) -> None:
        nonlocal node, links, in_article
        for (tag, _, hits, *_), above in zip(stack[k:], stack[k - 1:]):
            links -= tag == "a"
            in_article -= tag in ("article", "main")
            if tag in BLOCKS or hits != above[2]:
                node = None
        del stack[k:]

    while True:
        tag_at = _TAG.search(page, at)
        text(html.unescape(page[at:tag_at.start() if tag_at else len(page)]))
        if tag_at is None:
            break
        at = tag_at.end()
        if tag_at[2] is None:
            continue
        closing, tag = tag_at[1], tag_at[2].lower()
        if closing:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k and (tag in SCOPE or not any(s[0] in SCOPE for s in stack[k + 1:])):
                pop_to(k)
            continue
        if tag in RAW:
            if not tag_at[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]|\Z", re.I).search(page, at)
                end = page.find(">", end.start()) if end.start() < len(page) else len(page)
                at = len(page) if end < 0 else end + 1
            continue
        if tag in VOID:
            if tag == "br":
                text(" ") if node is not None else None
            elif tag == "hr":
                node = None
            continue
        for closed in (CLOSES.get(tag, ()), {"p"} if tag in CLOSES_P else ()):
            for k in range(len(stack) - 1, 0, -1) if closed else ():
                if stack[k][0] in closed:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE and stack[k][0] not in closed:
                    break
        _, path, hits, around, article = stack[-1]
        links += tag == "a"
        named = tag in ("article", "main")
        in_article += named
        wrapper = _hit(tag, tag_at[3], in_article > 0)
        if tag in BLOCKS or wrapper is not None:
            node = None
            path = paths.child(path, tag, _label(tag_at[3]))
        if wrapper is not None:
            hits += ((path, wrapper),)
        if named and in_article == 1:
            hits, around, article = (), hits, path
        stack.append((tag, path, hits, around, article))
    return found, paths


def _label(attributes: str) -> str:
    """Class and id words of an element, part of its step in the path."""
    if not attributes or "=" not in attributes:
        return ""
    found = _attributes(attributes)
    return ".".join(sorted({w for name in ("class", "id") for w in _NAME.findall(found.get(name, "").lower())}))


def clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


SMOOTHING = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
SPREAD = 0.8  # threshold in standard deviations of the fused scores
FLOOR = 0.15  # and never above this share of the best score: all of an even article stays


def weights(found: list[tuple[Node, str]]) -> list[float]:
    """The weight that its hits leave each block: 1 without any."""
    own = [max(0, len(t) - n.linked) for n, t in found]  # text outside links
    articles: dict[int, int] = {}
    free = 0
    for (node, _), n in zip(found, own):
        if node.article and not node.hits:
            articles[node.article] = articles.get(node.article, 0) + n
            if not node.around:
                free = max(free, articles[node.article])
    hits = []
    for node, _ in found:
        here = node.hits
        if node.around and (articles.get(node.article, 0) < free or any(w == 1.0 for _, w in node.around)):
            here = node.around + here
        hits.append(here)
    mass: dict[tuple[int, float], int] = {}
    for keys, n in zip(hits, own):
        for key in keys:
            mass[key] = mass.get(key, 0) + n
    total = max(1, sum(own))
    weight = {(path, w): max(0.0, (m / total - w) / (1.0 - w)) ** 3 if w < 1.0 else 0.0 for (path, w), m in mass.items()}
    out = [math.prod(weight[k] for k in keys) for keys in hits]
    for key in sorted((k for k, m in mass.items() if k[1] < 1.0 and m), key=lambda k: (-mass[k], k)):
        if any(w and n for w, n in zip(out, own)):
            break
        weight[key] = 1.0
        out = [math.prod(weight[k] for k in keys) for keys in hits]
    return out


def extract(page: str | None) -> str:
    nodes, tree = blocks(page or "")
    found = [(n, t) for n in nodes if (t := clean(n.parts))]
    weight = weights(found)
    found, weight = [f for f, w in zip(found, weight) if w > 0], [w for w in weight if w > 0]
    if not found:
        return ""
    paths: dict[int, list[float]] = {}
    containers: dict[int, list[float]] = {}
    articles: dict[int, list[float]] = {}
    for node, text in found:
        row = (1.0, len(text), len(PUNCTUATION.findall(text)), min(len(text), node.linked))
        for key, sums in ((node.path, paths), (node.container, containers), (node.article, articles)):
            own = sums.setdefault(key, [0.0] * 4)
            for k in range(4):
                own[k] += row[k]
    own = np.array([_ratio(paths[n.path]) for n, _ in found])
    around = np.array([_ratio(containers[n.container]) for n, _ in found])
    along = np.convolve(np.pad(own, 2, mode="edge"), SMOOTHING / SMOOTHING.sum(), mode="valid")
    score: dict[int, list[float]] = {}
    for (node, _), a, b, c, w in zip(found, own, along, around, weight):
        score.setdefault(node.path, []).append((a * max(b, c) * c) ** (1 / 3) * _unlinked(node, tree, paths, containers, articles) * w)
    fused = {path: float(np.mean(s)) for path, s in score.items()}
    values = np.array([fused[n.path] for n, _ in found])
    limit = min(SPREAD * float(values.std()), FLOOR * float(values.max()))
    content = {path for path, s in fused.items() if s > limit or s == max(fused.values()) > 0}
    if not content:
        return ""
    mass: dict[int, float] = {}
    for node, text in found:
        if node.path in content:
            mass[node.container] = mass.get(node.container, 0.0) + len(text)
    inside = tree.below(_home(mass, tree))
    return "\n".join(text for node, text in found if node.path in content and inside[node.path])


def _ratio(sums: list[float]) -> float:
    """Text per node times punctuation per node, both on a logarithmic scale: long paragraphs must not dwarf a heading."""
    nodes, chars, marks, _ = sums
    return math.log1p(chars / nodes) * (1.0 + math.log1p(marks / nodes))


def _unlinked(node: Node, tree: Paths, paths: dict, containers: dict, articles: dict) -> float:
    """What link text leaves of a path's score: the share of link text is the path's or, if less, that of the text around it.

    Around it are the article or main element, else the container; menus are often bare lists in body or a table
    cell, so there only headings share in it.
    """
    linked = paths[node.path][3] / paths[node.path][1]
    if node.article:
        return 1 - min(linked, articles[node.article][3] / articles[node.article][1])
    if tree.tag[node.container] in ("article", "main", "section", "div") or tree.tag[node.path] in HEADINGS:
        linked = min(linked, containers[node.container][3] / containers[node.container][1])
    return (1 - linked) ** 2


def _home(mass: dict[int, float], tree: Paths) -> int:
    """The deepest path that holds nearly all content; where article and main elements hold most of it, the deepest that holds all of these."""
    total = sum(mass.values())
    named = {tree.outermost[path] for path in mass} - {0}
    if named and sum(m for path, m in mass.items() if tree.outermost[path]) >= 0.5 * total:
        while len(named) > 1:  # a parent has the smaller number
            last = max(named)
            named = (named - {last}) | {tree.parent[last]}
        return named.pop()
    below = [mass.get(path, 0.0) for path in range(len(tree.tag))]
    for path in range(len(below) - 1, 0, -1):
        below[tree.parent[path]] += below[path]
    best = max(mass, key=mass.get)
    while best and below[best] < 0.8 * total:
        best = tree.parent[best]
    return best


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(incoming: Iterator[pa.RecordBatch]):
        def rows():
            for batch in incoming:
                for page_id, url, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    text = extract(page)
                    yield page_id, url, text, len(text)

        yield from batches(rows(), schema, weigh=lambda r: len(r[2]))

    return map_rows(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
