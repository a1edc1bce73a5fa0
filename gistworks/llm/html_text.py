"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

A page becomes a tree of nodes. What names itself boilerplate (menus, headers
and footers of the page, side bars, notices, adverts, forms, scripts, styles,
reader comments) is taken out; but on a page without an article or main element, a form,
header or element with a boilerplate name stays if it holds most of the text
outside links, since it wraps the page. For every node of the rest, the characters per
tag are weighed by how many of both are links; the sum over a node's children is
high where dense blocks meet. The node with the highest sum is the core of the
article, the lowest density on its path to the body the threshold: every node
that reaches it gives its own highest-sum subtree, and so do their neighbours
between them. The text comes out block by block.

The tree lives for one page at a time, in a few lists; Spark deals out the pages.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gistworks.llm import words as W

# Fixed values of HTML: elements without content, with raw text, that break lines, and that close an open one of a kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title xmp iframe noembed noframes noscript svg math object".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TEXTS = frozenset("p li dd dt tr td th pre blockquote table ul ol dl figure".split())

#: Elements that are not part of an article wherever they stand, and those that are not outside of one.
DROPPED = frozenset("head nav footer aside form button select input label dialog menu search canvas audio video picture map".split()) | RAW
OUTSIDE = frozenset(["header"])
#: Of both, those that stay where they wrap the page.
WRAPPERS = frozenset(["form", "header"])
INSIDE = frozenset(["article", "main"])

#: Words of class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc sitemap skip "
    "sidebar side aside widget widgets rail related recommended recommendations recirculation "
    "footer masthead topbar toolbar complementary contentinfo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall signup login "
    "share sharing social follow "
    "comment comments commentlist respond reply replies disqus discussion".split()
)
#: Marks that hold only outside of articles.
OUTSIDE_MARKS = frozenset(["header", "hero", "top"])

#: Marks of what readers or notices add; beside these, an article is short more often than missing.
ADDED = frozenset("comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr popup modal overlay paywall".split())

#: Names of an element that holds the article, and beginnings of a name that only tells what stands beside it.
CONTENT = frozenset("content main article post entry story".split())
WITH = frozenset("with without has no".split())

#: Last words of a compound name that only say that it holds something.
HOLDERS = frozenset(
    "list lists item items button buttons icon icons link links bar box boxes area container wrapper wrap inner outer holder section block unit slot "
    "panel tools module form count counts post posts story stories header title label body content feed row col column group zone region bottom top left right".split()
)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+'|["'])[^>"']*+)*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class _Page:
    """Nodes in page order, as lists; a node's content is its texts and children by number."""

    def __init__(self):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.content: list[list] = []

    def add(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.content.append([])
        if parent >= 0:
            self.content[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1


def _boilerplate(tag: str, attributes: str, inside: bool) -> float:
    """0 for what is none; else the share of the page's text above which it wraps the page, 1 if whatever it holds goes."""
    if (tag in DROPPED or (tag in OUTSIDE and not inside)) and tag not in WRAPPERS:
        return 1
    share = 0.5 if tag == "form" or (tag in OUTSIDE and not inside) else 0
    if tag in ("body", "html", "article", "main") or not attributes.strip():
        return share
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return 1
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 1
        elif name != "aria-hidden":
            names = value.split()
            if CONTENT.isdisjoint(n.lower() for n in names):
                for one in names:
                    marks = [m.lower() for m in _PARTS.split(one)]
                    if inside and len(marks) > 1 and not (marks[-1] in MARKS or marks[-1] in HOLDERS or not marks[-1]):
                        continue  # in an article the last word says what it is: a share-price is a price
                    if marks[0] not in WITH and not (MARKS.isdisjoint(marks) and (inside or OUTSIDE_MARKS.isdisjoint(marks))):
                        share = max(share, 0.5 if ADDED.isdisjoint(marks) else 0.9)
    return share


def _wrappers(source: str) -> frozenset[int]:
    """The places of start tags that look like boilerplate but hold most of the page's text outside links; none with an article."""
    chars, at = 0, 0
    muted = 0  # open links and elements that go whatever they hold
    stack: list[tuple[str, int, int, float]] = []
    opened: dict[str, int] = {}
    held: list[tuple[int, int, float]] = []
    lowered = None

    def close() -> str:
        nonlocal muted
        tag, place, before, share = stack.pop()
        opened[tag] -= 1
        muted -= share == 1
        if 0 < share < 1:
            held.append((place, chars - before, share))
        return tag

    while found := _TAG.search(source, at):
        if not muted:
            chars += len(source[at : found.start()].strip())
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened.get(tag):
                while close() != tag:
                    pass
            continue
        if tag in INSIDE:
            return frozenset()
        if tag in RAW and not found[3].endswith("/"):
            lowered = source.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at)
            at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
        elif not (found[3].endswith("/") or tag in VOID or tag in ("html", "body")):
            share = 1 if tag == "a" else _boilerplate(tag, found[3], False)
            stack.append((tag, found.start(), chars, share))
            opened[tag] = opened.get(tag, 0) + 1
            muted += share == 1
    if not muted:
        chars += len(source[at:].strip())
    while stack:
        close()
    return frozenset(place for place, own, share in held if own > share * chars)


def _tree(source: str) -> _Page:
    """The tree of a page without its boilerplate; unclosed and misnested tags are closed as browsers do."""
    page = _Page()
    stack = [page.add("body", -1)]
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name, and of open blocks
    blocks: list[int] = []
    dropped: list[str] = []  # open elements within a dropped one, which heads the list
    counts: dict[str, int] = {}  # of their names
    inside = 0
    at = 0
    lowered = None
    wrappers = None

    def cut(depth: int) -> None:
        """Close all elements from that place of the stack on."""
        nonlocal inside
        while len(stack) > depth:
            name = page.tags[stack.pop()]
            places[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            inside -= name in INSIDE

    def top(name: str) -> int:
        own = places.get(name)
        return own[-1] if own else 0

    def undrop() -> None:
        dropped.clear()
        counts.clear()

    while True:
        found = _TAG.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text and not dropped:
            page.content[stack[-1]].append(text)
        if not found:
            return page
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if dropped:
                if counts.get(tag):
                    while True:
                        name = dropped.pop()
                        counts[name] -= 1
                        if name == tag:
                            break
                elif tag in ("body", "html") or top(tag):
                    undrop()  # what holds the dropped element ends, and so does that
                if dropped or (tag in DROPPED and tag not in WRAPPERS):
                    continue
            depth = top(tag)
            if depth and (tag in BLOCKS or not blocks or depth > blocks[-1]):
                cut(depth)  # an inline end tag closes no block
            continue
        if tag in RAW and not found[3].endswith("/"):
            lowered = source.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at)
            at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
            continue
        closed = found[3].endswith("/") or tag in VOID
        if dropped:
            if not closed and tag not in ("body", "html"):
                if tag == "article" or tag == "main":
                    undrop()  # an unclosed menu does not swallow the article
                else:
                    dropped.append(tag)
                    counts[tag] = counts.get(tag, 0) + 1
                    continue
            else:
                continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCKS and top("p") and top("p") >= (blocks[-1] if blocks else 0):
            cut(top("p"))  # a block closes an open paragraph
        if tag in CLOSES:
            same, within = CLOSES[tag]
            border = max([top(name) for name in within])
            above = [own[k] for own in (places.get(name) or [] for name in same) if (k := bisect.bisect_right(own, border)) < len(own)]
            if above:
                cut(min(above))
        if share := _boilerplate(tag, found[3], inside > 0):
            if share < 1 and wrappers is None:
                wrappers = _wrappers(source)
            if share == 1 or found.start() not in wrappers:
                if not closed:
                    dropped.append(tag)
                    counts[tag] = 1
                continue
        node = page.add(tag, stack[-1])
        if not closed:
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append(node)
            inside += tag in INSIDE


def _densities(page: _Page) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum over its children.

    Blocks and links count as tags; an element that only dresses words belongs
    to the block around it and has no density of its own.
    """
    n = len(page.tags)
    block = [tag in BLOCKS or tag in ("td", "th") for tag in page.tags]
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        for part in page.content[node]:
            if isinstance(part, str):
                chars[node] += len(part.strip())
        if page.tags[node] == "a":
            link_chars[node], link_tags[node] = chars[node], tags[node]
        parent = page.parents[node]
        if parent >= 0:
            chars[parent] += chars[node]
            tags[parent] += tags[node] + (block[node] or page.tags[node] == "a")
            link_chars[parent] += link_chars[node]
            link_tags[parent] += link_tags[node] + (page.tags[node] == "a")
    whole = link_chars[0] / max(chars[0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for node in range(n - 1, -1, -1):
        c, t, lc, lt = chars[node], max(tags[node], 1), link_chars[node], max(link_tags[node], 1)
        if c and block[node]:
            base = math.log(c * lc / max(c - lc, 1) + whole * c + math.e)
            density[node] = max(c / t * math.log(c * t / (max(lc, 1) * lt) + 1) / max(math.log(base + 1), 1e-9), 0.0)
        if page.parents[node] >= 0:
            sums[page.parents[node]] += density[node] if block[node] else sums[node]
    return density, sums


def _core(page: _Page) -> set[int]:
    """The nodes whose subtrees are the article."""
    density, sums = _densities(page)
    n = len(page.tags)
    last = list(range(n))  # of each subtree
    best = list(range(n))  # the node of the highest sum in it
    for node in range(n - 1, 0, -1):
        parent = page.parents[node]
        last[parent] = max(last[parent], last[node])
        if (sums[best[node]], -best[node]) > (sums[best[parent]], -best[parent]):
            best[parent] = best[node]
    core = best[0]
    threshold, node = density[core], core
    while page.parents[node] >= 0:
        node = page.parents[node]
        threshold = min(threshold, density[node])
    if not sums[core]:
        return {0}
    marked, node = set(), 0
    while node < n:
        if density[node] >= threshold and (node or core == 0):
            top = best[node] if sums[best[node]] else node
            marked.add(top)
            node = last[node] + 1 if top == node else node + 1
        else:
            node += 1
    for top in list(marked):
        node = top
        while node > 0:
            if page.tags[node] == "article":
                marked.add(node)  # an element that says so is the article as a whole
            node = page.parents[node]
    for parent in {page.parents[m] for m in marked}:  # as does what stands between two of its parts, heads them or goes on in the same box
        if parent >= 0:
            children = [c for c in page.content[parent] if not isinstance(c, str)]
            own = [i for i, c in enumerate(children) if c in marked]
            begin, end = own[0], own[-1] + 1
            while begin and page.tags[children[begin - 1]] in (HEADINGS | TEXTS if parent else HEADINGS):
                begin -= 1
            while parent and end < len(children) and page.tags[children[end]] in TEXTS:
                end += 1
            marked.update(children[begin:end])
    return marked


def main_text(source: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    page = _tree(source or "")
    core = _core(page)
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
        if text:
            blocks.append(text)
        line.clear()

    todo: list[tuple] = [(0, 0 in core)]
    while todo:
        part, taken = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            if taken:
                line.append(part)
        else:
            tag = page.tags[part]
            taken = taken or part in core
            if tag in BLOCKS:
                close()
                todo.append((None, False))
            elif tag in ("br", "td", "th") and taken:
                line.append(" ")
            todo.extend((p, taken) for p in reversed(page.content[part]))
    close()
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    ``n_chars`` counts code points. A null or empty page, and one without text
    outside its boilerplate, gives an empty text; repeated rows come back as often.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "html"):
            texts = [main_text(source) for source in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = T.StructType([T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")]).add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
