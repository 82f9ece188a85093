"""Main text of web pages by tag-path ratios.

A page is cut into blocks: text between block tags, inline tags and references resolved. The
blocks' root-to-leaf paths of block tags with their class and id are the unit of judgement: per
path the text length and the punctuation are aggregated over its blocks (text per block, marks
per block), both ratios are smoothed over neighbouring paths in page order, fused by their
product, and paths above the threshold (the fused ratios' mean plus a share of their deviation)
are content. Paths whose tags, roles, classes or ids name a menu, header, footer, sidebar,
notice, advert, form or comments are no content whatever their ratios. The smallest element
that holds nearly all the content found is the article; every block of it counts, short ones
too, but for those named parts inside it.

Rows: a null or empty html, or one without text, gives an empty text; repeated pages are each
extracted; broken html is read as far as it goes: tags are closed by their parents, unclosed
comments and scripts run to the end.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.arrays import slices

# The kinds of HTML elements.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe svg math object select button canvas audio video".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form dialog menu head fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer foot bottombar sidebar side aside rail "
    "widget widgets related recommended recommendations trending popular share sharing social follow newsletter subscribe subscription signup "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast disclaimer copyright legal "
    "comment comments commentlist disqus respond reply replies discussion form login search tags toc pagination pager skip".split()
)
CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())
P_ENDS_AT = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
CONTAINERS = frozenset("article body html main section div td th li blockquote table ul ol".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Za-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，]")
SPACES = re.compile(r"\s+")
THRESHOLD = 0.25
HELD = 0.85


class Element:
    __slots__ = ("tag", "path", "boilerplate", "parent", "depth")

    def __init__(self, tag: str, names: str, boilerplate: bool, parent: "Element | None") -> None:
        self.tag, self.parent = tag, parent
        self.path = (parent.path if parent else "") + "/" + tag + names
        self.boilerplate = boilerplate or bool(parent and parent.boilerplate)
        self.depth = parent.depth + 1 if parent else 0


def described(tag: str, attributes: str) -> tuple[str, bool]:
    """Classes and id as part of the path, and whether tag or names tell of boilerplate."""
    if tag in BOILERPLATE_TAGS:
        return "", True
    names, bad = "", False
    for m in NAMES.finditer(attributes) if attributes else ():
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "role":
            bad = bad or value.strip().lower() in BOILERPLATE_ROLES
        elif kind == "aria-hidden":
            bad = bad or value.strip().lower() == "true"
        elif kind != "hidden":
            names += "." + value
            if tag not in ("html", "body", "main", "article"):
                bad = bad or any(w.lower() in BOILERPLATE_NAMES for w in WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
    return names, bad


def blocks_of(page: str) -> list[tuple[Element, str, int]]:
    """(element, text, characters inside links) of every block with text, in page order."""
    root = Element("", "", False, None)
    stack, found = [root], []
    held: list[str] = []
    links, in_link, at, n = 0, 0, 0, len(page)

    def end_block() -> None:
        nonlocal links
        if held:
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                found.append((stack[-1], text, links))
            held.clear()
        links = 0

    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            held.append(page[at:stop])
            links += in_link * (stop - at)
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not closing and not m.group(0).endswith("/>"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            end_block()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                end_block()
            continue
        end_block()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        else:
            if stack[-1].tag == tag and tag in CLOSED_BY_SAME or stack[-1].tag == "p" and tag in P_ENDS_AT:
                stack.pop()
            elif tag in ("td", "th") and stack[-1].tag in ("td", "th") or tag in ("dt", "dd") and stack[-1].tag in ("dt", "dd"):
                stack.pop()
            names, bad = described(tag, m.group(3))
            stack.append(Element(tag, names, bad, stack[-1]))
    end_block()
    return found


def smoothed(values: list[float]) -> list[float]:
    """Each value with a fourth of each neighbour's."""
    last = len(values) - 1
    return [0.25 * values[max(0, k - 1)] + 0.5 * values[k] + 0.25 * values[min(last, k + 1)] for k in range(last + 1)]


def main_text(page: str | None) -> str:
    """The article of one page."""
    blocks = [b for b in blocks_of(page or "") if not b[0].boilerplate]
    if not blocks:
        return ""
    paths: dict[str, list[float]] = {}
    for element, text, links in blocks:
        own = paths.setdefault(element.path, [0, 0, 0])
        own[0] += max(0, len(text) - links)  # linked text is no content
        own[1] += len(PUNCTUATION.findall(text))
        own[2] += 1
    lengths, marks = smoothed([v[0] / v[2] for v in paths.values()]), smoothed([v[1] / v[2] for v in paths.values()])
    fused = {p: a * (1 + b) if paths[p][0] else 0.0 for p, a, b in zip(paths, lengths, marks)}
    mean = sum(fused.values()) / len(fused)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in fused.values()) / len(fused))
    limit = min(mean + THRESHOLD * deviation, max(fused.values()))
    content = [(e, len(t)) for e, t, _ in blocks if fused[e.path] >= limit]
    inside: dict[Element, int] = {}
    for element, size in content:
        while element is not None:
            inside[element] = inside.get(element, 0) + size
            element = element.parent
    wanted = HELD * sum(size for _, size in content)
    article = max((e for e, size in inside.items() if size >= wanted and (e.tag in CONTAINERS or e.parent is None)), key=lambda e: e.depth)
    named = article
    while named is not None and named.tag not in ("article", "main"):
        named = named.parent
    article = named or article

    def within(e: Element | None) -> bool:
        while e is not None and e is not article:
            e = e.parent
        return e is article

    return " ".join(t for e, t, _ in blocks if within(e))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text): one row per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")
