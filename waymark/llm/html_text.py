"""Main text of web pages by tag-path ratios.

Every block of text hangs on a root-to-leaf path of block tags (with the class and id words that
tell furniture from content). For each path of a page the text length and the punctuation are added
up over its blocks; the length per block is smoothed along the page with its neighbours, fused with
the punctuation ratio and a prior for the path's tags, and the paths over a share of the page's best
path are content. The region around the content paths then keeps its short blocks as well.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element and attribute vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea button".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
CONTAINERS = frozenset("article main".split())
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent copyright disqus footer header masthead menu nav navbar navigation newsletter notice pagination pager popup promo "
    "promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
PARAGRAPHS = frozenset("p dt dd li option tr td th thead tbody tfoot".split())
#: Start tags that end an open paragraph, and which open elements a start tag of these ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
MARKS = frozenset(".,;:!?…。、，！？；：¿¡")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z][^\s/>]*(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def attributes(tok: str) -> tuple[set[str], bool]:
    """Words of a start tag's class, id and role, and whether it hides what it holds. Names count as a whole."""
    words, hidden = set(), False
    for m in _ATTR.finditer(tok, _NAME.match(tok).end()):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words.update(_WORDS.findall(value.lower()))
        elif name == "style":
            hidden |= bool(_NO_DISPLAY.search(value))
        hidden |= name == "hidden" or name == "aria-hidden" and value.lower() == "true"
    return words, hidden


class Open:
    """Open elements, with the places of each tag, so that finding the last one takes no walk."""

    def __init__(self) -> None:
        self.items: list[tuple[str, bool, bool]] = []  # tag, furniture, dropped
        self.at: dict[str, list[int]] = {}
        self.paths: list[int] = [0]  # the path of block tags at each depth
        self.outer: list[int] = []  # places of block elements

    def last(self, tags: Iterable[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


class Paths:
    """Paths of block tags as a tree: each is a number, with its parent, its label and whether a container is above."""

    def __init__(self) -> None:
        self.parent, self.label, self.depth, self.box = [-1], [""], [0], [False]
        self.known: dict[tuple[int, str], int] = {}

    def below(self, path: int, label: str) -> int:
        got = self.known.get((path, label))
        if got is None:
            got = self.known[path, label] = len(self.parent)
            self.parent.append(path)
            self.label.append(label)
            self.depth.append(self.depth[path] + 1)
            self.box.append(self.box[path] or label.split(".")[0] in CONTAINERS)
        return got


def blocks(page: str) -> tuple[Paths, list[tuple[int, int, str]]]:
    """Blocks of text in page order: the path, the furniture depth (0: none), the text. Linear in the page."""
    out: list[tuple[int, int, str]] = []
    paths, open_ = Paths(), Open()
    stack = open_.items
    text: list[str] = []
    bad = hidden = 0

    def flush() -> None:
        if text:
            got = " ".join("".join(text).split())
            if got and not hidden:
                out.append((open_.paths[-1], bad, got))
            text.clear()

    def pop(to: int) -> None:
        nonlocal bad, hidden
        while len(stack) > to:
            tag, f, h = stack[-1]
            if tag not in INLINE or h:
                flush()
            stack.pop()
            open_.at[tag].pop()
            open_.paths.pop()
            if open_.outer and open_.outer[-1] == len(stack):
                open_.outer.pop()
            bad -= f
            hidden -= h

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(entities.unescape(piece))
        if not m:
            break
        tok, at = m.group(), m.end()
        name = _NAME.match(tok)
        if not name:
            if tok.startswith("<![CDATA["):
                text.append(tok[9:].removesuffix("]]>"))
            continue
        tag = name.group(1).lower()
        if tok[1] == "/":
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                continue
            k = open_.last((tag,))
            if k >= 0 and not (tag in INLINE and open_.outer and open_.outer[-1] > k):
                pop(k)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                text.append(" ")
            continue
        if tag not in INLINE:
            if tag not in PARAGRAPHS or tag == "p":
                k = open_.last(("p",))
                if k >= 0:
                    pop(k)
            if tag in CLOSES:  # what stands open since the last element that holds such tags
                floor = open_.last(STOPS[tag])
                k = min((p[bisect.bisect_right(p, floor)] for t in CLOSES[tag] if (p := open_.at.get(t)) and p[-1] > floor), default=-1)
                if k >= 0:
                    pop(k)
            flush()
        words, h = attributes(tok) if len(tok) > len(tag) + 2 else (set(), False)
        f = (tag in FURNITURE or bool(words & FURNITURE_WORDS)) and tag not in ("html", "body") and tag not in CONTAINERS
        h = h or tag in DROPPED
        if h and tag in INLINE | DROPPED:
            text.append(" ")
        if h:
            flush()
        if tok.endswith("/>") and tag in ("svg", "math"):
            continue
        open_.at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            open_.outer.append(len(stack))
        open_.paths.append(open_.paths[-1] if tag in INLINE else paths.below(open_.paths[-1], tag + "".join(f".{w}" for w in sorted(words))))
        stack.append((tag, f, h))
        bad += f
        hidden += h
        if tag in RAW:
            end = _RAW_END[tag].search(page, at)
            at = end.start() if end else n
    pop(0)
    flush()
    return paths, out


def content(paths: Paths, found: list[tuple[int, int, str]], share: float = 0.25) -> list[str]:
    """Blocks on content paths, and the short blocks beside them, in page order."""
    open_ = [b for b in found if not b[1]]
    if any(paths.box[p] for p, _, _ in open_):
        # a page that says where its article is: the paths inside compete among themselves
        open_ = [b for b in open_ if paths.box[b[0]]]
    if not open_:
        return []
    size: dict[int, float] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    for p, _, t in open_:
        size[p] = size.get(p, 0) + len(t)
        marks[p] = marks.get(p, 0) + sum(map(t.count, MARKS))
        count[p] = count.get(p, 0) + 1
    ratio = [size[p] / count[p] for p, _, _ in open_]
    smooth: dict[int, float] = {}
    for i, (p, _, _) in enumerate(open_):
        near = ratio[max(0, i - 2) : i + 3]
        smooth[p] = smooth.get(p, 0) + sum(near) / len(near) / count[p]
    total_marks, total = sum(marks.values()) or 1, sum(size.values())
    score = {p: smooth[p] * (size[p] / total + marks[p] / total_marks) for p in size}
    best = max(score.values())
    chosen = [p for p in score if score[p] >= share * best]
    under = [0] * len(paths.parent)  # content paths at or below each path; a path's number is over its parent's
    for p in chosen:
        under[p] = 1
    for p in range(len(under) - 1, 0, -1):
        under[paths.parent[p]] += under[p]
    root = max((p for p in range(len(under)) if under[p] == len(chosen)), key=paths.depth.__getitem__)  # the deepest around them all
    if len(chosen) == 1 and root:
        root = paths.parent[root]
    box = root
    while box > 0 and paths.label[box].split(".")[0] not in CONTAINERS:
        box = paths.parent[box]
    root = box if box > 0 else root
    inside = [False] * len(paths.parent)
    inside[root] = True
    for p in range(root + 1, len(inside)):
        inside[p] = inside[p] or inside[paths.parent[p]]
    return [t for p, _, t in open_ if inside[p]]


def main_text(page: str | None) -> str:
    """The main text of one page: its content blocks joined by line feeds."""
    return "\n".join(content(*blocks(page or "")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A null or empty page, and one without content, gives an empty text. Ids and addresses pass
    through, nulls and repeated rows included; other columns are ignored whatever their names.
    Pages are worked on whole and one by one, whatever their length; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
