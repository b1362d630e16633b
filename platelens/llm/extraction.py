"""Main text of web pages by tag-path ratios.

A page becomes its text blocks in order, each with the path of tags from the root to it. Per path the length of text,
the punctuation and the text inside links are added up and divided by the number of blocks on the path: long,
punctuated, unlinked paths are content. These ratios are put back on the blocks, smoothed along the page (a heading
takes part of the weight of the paragraphs around it, an entry of a menu that of other entries), fused into one score by
their product, and averaged by path. Paths above a share of the mean score, weighted by text, are content. A block counts
as ``LONGEST`` characters at most, so that a very long one doesn't raise the mean above all others. Entries of lists and
tables, preformatted text and headings are content with the container they stand in: anywhere in it, or between content
blocks where it is the page itself. Of an article that stands for the
page nothing else is left out, lists of links included.

What pages mark themselves is taken from the marks: parts that are never text (scripts, styles, forms ...), parts named
by their tag or role as navigation, advert, notice, comment and the like, and hidden parts are left out before the ratios
are taken. A form, or a class or id of that kind, only makes a part suspect: it is left out unless it holds most of the page's
unlinked text with punctuation (so does a comment part longer than all the rest, and it stays). Articles and main parts
that hold most of that text, or have less than ``LONGEST`` characters of it beside them, stand for the page: blocks outside
are left out. Where all this leaves nothing, the
ratios decide alone over everything that can be text.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. A line
break and an inline tag do not end a block. Null, empty and malformed pages give what text there is, at worst an empty
one; unclosed tags end with the page. Repeated rows are extracted each; an empty table gives an empty result; extra
columns are not read. Pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platelens.llm.common import byte_column, pieces, utf8

#: A path is content when its score is above this share of the mean score.
SHARE = 0.08
#: Weight of the blocks before and after when ratios are smoothed.
KERNEL = np.array([0.1, 0.2, 0.4, 0.2, 0.1])
MOST_LINKED = 0.6
#: Characters of a block that count in its score.
LONGEST = 300
TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s=/>"']+)""", re.S)
#: Fixed values of HTML: elements without content, elements of raw text, inline elements, and what ends an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Parts that are never the article, by tag, role or a word of their class or id.
NEVER = frozenset("nav footer aside script style noscript template iframe svg button select textarea object dialog menu canvas audio video head title".split())
#: Of these, parts that hold no running text; all that is left out when the marks leave nothing.
NO_TEXT = RAW | frozenset("noscript template svg button select object canvas audio video head".split())
ROLES = frozenset("navigation banner complementary contentinfo search alert dialog alertdialog menu menubar form status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert"
    " popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies respond discussion"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar skip widget widgets search commentlist".split()
)
#: What goes with the text around it, and what such parts stand in without being a container of their own.
PARTS = frozenset("li td th dt dd pre caption h1 h2 h3 h4 h5 h6".split())
WITHIN = PARTS | frozenset("ul ol dl table thead tbody tfoot tr p blockquote figure figcaption".split())
#: Words that may stand beside them in a class or id that still names such a part.
BESIDE = frozenset(
    "left right top bottom main site page list box bar block links container inner header section item primary secondary user users article post slot unit area wrapper"
    " stories story posts articles".split()
)
#: A class or id of these words alone is a header of the page, outside of articles.
HEADER = frozenset("header site page global top main".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？«»“”„]")


@dataclass
class Block:
    path: str
    inside: int
    container: int = 0
    part: bool = False
    suspects: tuple[int, ...] = ()
    text: list[str] = field(default_factory=list)
    linked: int = 0


def unwanted(tag: str, attributes: str, in_article: bool, plain: bool = False) -> bool:
    """Whether a part is left out whatever it holds; ``plain``: only what is hidden or can't be text."""
    if tag in (NO_TEXT if plain else NEVER) or tag == "header" and not in_article and not plain:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5] or "").lower()
        value = html.unescape(m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value in ROLES and not plain or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def suspect(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a part is a form, or a class or id, taken whole, names a part that is not the article."""
    if tag == "form":
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        if (m[1] or "").lower() in ("class", "id"):
            for name in html.unescape(m[2] or m[3] or m[4] or "").lower().split():
                words = set(re.split(r"[^a-z]+", name)) - {""}
                if words & NAMES and words <= NAMES | BESIDE or "header" in words and words <= HEADER and not in_article:
                    return True
    return False


def blocks(page: str, plain: bool = False) -> list[Block]:
    """Text blocks in page order; ``inside`` counts the articles and main parts around a block, ``container`` names
    the element it stands in (0: the page)."""
    stack: list[tuple[str, bool, int, int, tuple[int, ...]]] = []  # tag, left out, articles around, container, suspect parts around
    out: list[Block] = []
    current: Block | None = None
    links = made = 0

    def text(raw: str) -> None:
        nonlocal current
        if not raw or stack and stack[-1][1]:
            return
        if current is None:
            if raw.isspace():
                return
            path = [t for t, *_ in stack if t not in INLINE]
            current = Block("/".join(path), stack[-1][2] if stack else 0, stack[-1][3] if stack else 0, not PARTS.isdisjoint(path), stack[-1][4] if stack else ())
            out.append(current)
        current.text.append(raw)
        if links:
            current.linked += len(raw.strip())

    def pop(n: int) -> None:
        nonlocal current, links
        for t, *_ in stack[n:]:
            links -= t == "a"
            if t not in INLINE:
                current = None
        del stack[n:]

    def close(tags: frozenset[str] | set[str], barrier: frozenset[str] | set[str]) -> None:
        for n in range(len(stack) - 1, -1, -1):
            if stack[n][0] in tags:
                pop(n)
                return
            if stack[n][0] in barrier:
                return

    at = 0
    while m := TAG.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in VOID:
                close({tag}, frozenset() if tag not in INLINE else {"body", "article", "div", "td", "li"} - {tag})
            continue
        if tag in P_ENDERS:
            close({"p"}, {"button", "table", "td", "object", "article", "body"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("br", "wbr", "hr"):
            if tag == "hr":
                current = None
            else:
                text(" ")
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else len(page)
        around = stack[-1][2] if stack else 0
        gone = bool(stack and stack[-1][1]) or unwanted(tag, m[3], around > 0, plain)
        if tag not in INLINE:
            current = None
        links += tag == "a"
        container = stack[-1][3] if stack else 0
        if tag not in WITHIN and tag not in INLINE and tag not in ("html", "body"):
            container = made = made + 1
        inside = stack[-1][4] if stack else ()
        if not gone and suspect(tag, m[3], around > 0):
            inside = (*inside, m.start())
        stack.append((tag, gone, around + (tag in ("article", "main") and not gone), container, inside))
    text(page[at:])
    return out


def running(rows: list[tuple[Block, str]]) -> np.ndarray:
    """Characters of each block that count as running text: unlinked, and punctuated or long."""
    return np.array([max(len(t) - b.linked, 0) if len(t) > LONGEST or PUNCTUATION.search(t) else 0 for b, t in rows], dtype=float)


def select(found: list[Block], plain: bool = False) -> list[str]:
    """Texts of the content blocks; ``plain``: by ratios only."""
    rows = [(b, " ".join(html.unescape("".join(b.text)).split())) for b in found]
    rows = [(b, t) for b, t in rows if t]
    if not plain and any(b.suspects for b, _ in rows):
        parts: dict[int, float] = {}
        held = running(rows)
        for (b, _), h in zip(rows, held.tolist(), strict=True):
            for p in b.suspects:
                parts[p] = parts.get(p, 0.0) + h
        marked = any(b.inside and h and not b.suspects for (b, _), h in zip(rows, held.tolist(), strict=True))
        spared = {p for p, h in parts.items() if 2 * h > held.sum() and not (marked and h < LONGEST)}
        rows = [(b, t) for b, t in rows if spared.issuperset(b.suspects)]
    inside = np.array([b.inside > 0 for b, _ in rows], dtype=bool)
    held = running(rows)
    article = not plain and bool(inside.any()) and bool(2 * held[inside].sum() > held.sum() or held[~inside].sum() < LONGEST)
    if article:
        rows = [(b, t) for b, t in rows if b.inside]
    if not rows:
        return []
    paths: dict[str, int] = {}
    of = np.array([paths.setdefault(b.path, len(paths)) for b, _ in rows])
    length = np.array([len(t) for _, t in rows], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t in rows], dtype=float)
    used = np.minimum(length, LONGEST)
    marks *= used / length
    linked = np.minimum(np.array([b.linked for b, _ in rows], dtype=float), length)
    n = np.bincount(of)
    whole = np.bincount(of, length)
    text_ratio, mark_ratio, link_share = np.bincount(of, used) / n, np.bincount(of, marks) / n, np.bincount(of, linked) / whole

    def smooth(x: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(x)), KERNEL)[2:-2]
        return np.convolve(x, KERNEL)[2:-2] / weight

    score = smooth(text_ratio[of] * (1 - link_share[of])) * smooth(1 + mark_ratio[of])
    by_path = np.bincount(of, score) / n
    weight = np.bincount(of, used)
    mean = float((by_path * weight).sum() / weight.sum())
    good = (by_path >= SHARE * mean) & (link_share < MOST_LINKED) | article
    kept = good[of]
    span: dict[int, tuple[int, int]] = {}  # first and last content block of each container
    for i in np.flatnonzero(kept).tolist():
        c = rows[i][0].container
        span[c] = (span.get(c, (i, i))[0], i)
    own = linked < MOST_LINKED * length
    for i, (b, _) in enumerate(rows):
        if b.part and own[i] and b.container in span:
            first, last = span[b.container]
            kept[i] |= b.container > 0 or first < i < last
    return [t for (_, t), k in zip(rows, kept.tolist(), strict=True) if k]


def main_text(page: str) -> str:
    return "\n".join(select(blocks(page)) or select(blocks(page, plain=True), plain=True))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            data, at = byte_column(batch.column("html"))
            texts = [main_text(data[a:b].tobytes().decode()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
