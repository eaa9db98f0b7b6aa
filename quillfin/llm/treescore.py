"""Main text of web pages by tree scoring.

A page becomes a tree. Boilerplate subtrees (by element, role or class) don't take part. Every block of
text earns points for its length and its commas, discounted by its share of link text, and passes them on
to its parent and half of them to its grandparent. The container with the most points, discounted by its
own share of links, is the article; siblings that score well or read like prose are kept with it.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements and words of class names that mark what is not the article.
DROPPED = frozenset(
    "head nav header footer aside form script style noscript template button select option textarea input iframe object "
    "embed svg math canvas audio video dialog menu datalist title".split()
)
RAW = frozenset("script style noscript template textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p pre td th li dd dt blockquote figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset("article main".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promoted promotion banner sidebar rail comment "
    "comments commentlist reply replies disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs menu "
    "nav navbar navigation pager pagination footer header masthead toolbar widget widgets skip".split()
)
# An open element that a start tag ends first, and the elements that stop the search for it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

# One attribute or what stands between two. A value without quotes may hold quotes; a quote that is never closed
# is a name like any other. Nothing is tried twice, so a tag costs its length.
_VALUE = r"\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+"
_ATTRIBUTES = rf"(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:{_VALUE})?+)?+|=)*+"
_MARKUP = re.compile(rf"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

# A block of text earns up to one point up to this length, three more up to three times 100 characters.
FULL_BLOCK = 25
# A list or box inside the article with this share of link text and so many links is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.7


@dataclass
class Page:
    """Elements in page order, each with the place where its subtree ends, and pieces of text."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    unlikely: list[bool] = field(default_factory=list)
    # Element, block number, text.
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def parsed(source: str) -> Page:
    """The tree of a page; open elements are ended as browsers do for the common cases."""
    page = Page()
    stack: list[int] = []
    # Depths at which an element of each name is open, so that no search walks the stack.
    open_at: dict[str, list[int]] = defaultdict(list)
    block = at = 0

    def open_(tag: str, unlikely: bool) -> None:
        page.tag.append(tag)
        page.parent.append(stack[-1] if stack else -1)
        page.end.append(-1)
        page.unlikely.append(unlikely)
        open_at[tag].append(len(stack))
        stack.append(len(page.tag) - 1)

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            open_at[page.tag[e]].pop()
            page.end[e] = len(page.tag)

    def deepest(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    def find(wanted: set[str], stop: set[str]) -> int:
        depth = deepest(wanted)
        return depth if depth >= deepest(stop) else 0

    open_("html", False)
    while at < len(source):
        found = _MARKUP.search(source, at)
        text = source[at : found.start() if found else len(source)]
        if text:
            page.pieces.append((stack[-1], block, entities.unescape(text)))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag or tag == "html":
            continue
        if found[1]:
            depth = find({tag}, {"table"} if tag not in ("table", "body") and tag not in WHOLE else set())
            if depth:
                close(depth)
            block += tag in BLOCKS
            continue
        if tag in BLOCKS:
            block += 1
            depth = find({"p"}, {"table", "button", "object", "td", "th"})
            if depth and tag not in ("option", "select"):
                close(depth)
        if tag in ENDS and (depth := find(*ENDS[tag])):
            close(depth)
        if tag in VOID:
            if tag in ("br", "hr"):
                page.pieces.append((stack[-1], block, " "))
            continue
        open_(tag, _unlikely(found[3]))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(source, at)
            at = stop.start() if stop else len(source)
    close(0)
    return page


def _unlikely(attributes: str) -> bool:
    if not attributes.strip():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and any(w.lower() in DROPPED_WORDS for w in _CLASS_WORD.findall(value)):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes))


def main_text(source: str | None) -> str:
    """The article of a page as one line: blocks of text in page order, joined by one space."""
    if not source:
        return ""
    page = parsed(source)
    n = len(page.tag)
    alive = _alive(page)
    own, commas, links = [0] * n, [0] * n, [0] * n
    holder, linked = _holders(page)
    for e, _, text in page.pieces:
        if alive[e]:
            size = len(_SPACE.sub(" ", text).strip())
            own[holder[e]] += size
            commas[holder[e]] += text.count(",") + text.count("、") + text.count("，")
            links[holder[e]] += size if linked[e] else 0
    points = [0.0] * n
    for e in range(n):
        if own[e] and page.tag[e] not in HEADINGS:
            earned = min(own[e] / FULL_BLOCK, 1) + commas[e] + min(own[e] / 100, 3)
            earned *= 1 - links[e] / own[e]
            # Loose text of a container counts for the container itself.
            first = page.parent[e] if page.tag[e] in PROSE and page.parent[e] >= 0 else e
            points[first] += earned
            if page.parent[first] >= 0:
                points[page.parent[first]] += earned / 2
    total, total_links = list(own), list(links)
    for e in range(n - 1, 0, -1):
        total[page.parent[e]] += total[e]
        total_links[page.parent[e]] += total_links[e]
    share = [total_links[e] / total[e] if total[e] else 0.0 for e in range(n)]
    score = [points[e] * (1 - share[e]) for e in range(n)]
    if not any(total):
        return ""
    best = max(range(n), key=lambda e: (score[e], total[e]))
    above = best
    while above >= 0 and page.tag[above] != "article":
        above = page.parent[above]
    best = above if above >= 0 else best
    kept = [best]
    for e in range(n) if page.parent[best] >= 0 else ():
        if e != best and page.parent[e] == page.parent[best] and total[e] and alive[e] and _goes_along(page, e, score, total, share, score[best]):
            kept.append(e)
    return _text(page, alive, kept, share, total)


def _goes_along(page: Page, e: int, score: list[float], total: list[int], share: list[float], best: float) -> bool:
    """Whether a sibling of the article belongs to it."""
    if page.tag[e] in HEADINGS:
        return not share[e]
    if page.tag[e] in PROSE and share[e] < 0.25 and (total[e] > 80 or not share[e]):
        return True
    return score[e] >= max(2.0, 0.2 * best)


def _alive(page: Page) -> list[bool]:
    """Elements outside of all dropped subtrees. A box is not dropped for its class if an article is in it."""
    n = len(page.tag)
    holds = [False] * n
    for e in range(n - 1, 0, -1):
        holds[page.parent[e]] |= holds[e] or page.tag[e] in WHOLE and not page.unlikely[e]
    alive = [True] * n
    for e in range(1, n):
        dropped = page.tag[e] in DROPPED or page.unlikely[e] and not holds[e] and page.tag[e] not in ("body", "main")
        alive[e] = alive[page.parent[e]] and not dropped
    return alive


def _holders(page: Page) -> tuple[list[int], list[bool]]:
    """For each element the block that its text belongs to, and whether it is inside a link."""
    holder, linked = [0] * len(page.tag), [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        up = page.parent[e]
        holder[e] = e if page.tag[e] in BLOCKS else holder[up]
        linked[e] = linked[up] or page.tag[e] == "a"
    return holder, linked


def _text(page: Page, alive: list[bool], kept: list[int], share: list[float], total: list[int]) -> str:
    n = len(page.tag)
    anchors = [0] * n
    for e in range(n - 1, 0, -1):
        anchors[page.parent[e]] += anchors[e] + (page.tag[e] == "a")
    inside = [False] * n
    roots = set(kept)
    for e in range(n):
        up = page.parent[e]
        menu = page.tag[e] in ("ul", "ol", "div", "section", "table", "dl") and e not in roots and anchors[e] >= MENU_LINKS and share[e] >= MENU_SHARE
        inside[e] = alive[e] and (e in roots or up >= 0 and inside[up]) and not menu
    blocks: dict[int, list[str]] = {}
    for e, block, text in page.pieces:
        if inside[e]:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return " ".join(line for line in lines if line)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` plus ``text`` (empty if there is none, and for null) and ``n_chars``.

    Each page is handled whole and for itself; columns with the names of the new ones are replaced.
    """
    new = {"text": "string", "n_chars": "long"}
    rest = pages.select(*[c for c in pages.columns if c not in new])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema] + [f"{n} {t}" for n, t in new.items()])
    at = rest.columns.index(html_col)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, *new])

    return rest.mapInArrow(extracted, schema)
