"""HTML extraction: flat text blocks, classified by a decision tree over their own and their neighbours' shallow features."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bound_batches

# Elements by their role in HTML.
DROPPED = ("script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "select", "button", "textarea", "datalist", "audio", "video", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
APART = frozenset("nav aside footer form dialog menu label legend fieldset".split())
MAIN = frozenset("article main".split())
#: elements whose content is raw to a parser: without an end tag they last to the page's end, the other dropped ones are then passed over
RAW = frozenset("script style title textarea iframe noscript".split())
#: elements that an article's start ends or reaches through, closed or not
PASSED = frozenset("nav form menu header footer".split())
#: elements apart that may be left open, with the elements right inside them that can't be theirs once they have text
_SECTIONS = frozenset("div section article main".split())
_PROSE = _SECTIONS | frozenset("p h1 h2 table blockquote pre".split())
ENDED_BY = {"nav": _PROSE, "menu": _PROSE, "form": _PROSE, "header": _SECTIONS}
#: words of class and id names that mark what isn't the article
NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs colophon comment comments consent cookie cookies copyright discussion disqus footer gdpr "
    "header imprint impressum legal login masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination paywall popup promo promoted promotion recirculation recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola teaser teasers toolbar topbar trending widget".split())
#: names that say so beside any other word, apart or grown together with one of the words above (user-comments-wrapper, commentlist)
STRONG = frozenset(
    "advert advertisement adverts advertising breadcrumb breadcrumbs comment comments cookie cookies disqus footer masthead navbar navigation newsletter outbrain "
    "pagination paywall promo sidebar sponsored subscribe taboola teaser teasers".split())
#: words beside which a name tells a state or a topic of the whole page or article (no-sidebar, comments-open, tag-cookies)
STATES = frozenset("active category closed disabled enabled format has have hide is js layout no non not off on open status tag template term theme topic type w with without".split())
#: pairs of words that mark what isn't the article
PAIRS = tuple(map(frozenset, (("more", "stories"), ("more", "articles"), ("more", "posts"), ("more", "news"), ("top", "stories"), ("latest", "news"), ("popular", "posts"), ("most", "read"), ("most", "popular"),
                              ("read", "next"), ("up", "next"), ("also", "like"))))
#: words that may stand beside these in one name; with any other word beside it, a name says something else (no-sidebar, share-price)
BESIDE = frozenset(
    "area articles aside bar block blog body bottom box btn button buttons center col column container content en entry form global group holder icons inner item items left "
    "level line link links list main media more outer page panel placeholder popular post posts primary right secondary section site slot stories sub text thread title to top unit wrap wrapper".split())

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: how a short note of rights begins, or what it holds
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)[^.]{0,40}\b(?:19|20)\d\d\b|[^.]{0,80}(?:©|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b)", re.I)
RIGHTS_WORDS = 30

#: The labelled table. words, link density; the same of the block before and after; place (1 in an
#: article, -1 in an element that isn't part of one, 0 neither); label (1: main text).
LABELLED = np.array([
    # in an article: prose of any length, headings, short paragraphs between long ones
    (60, 0, 9, 0, 75, 0, 1, 1), (140, 0.02, 60, 0, 12, 0, 1, 1), (1, 0, 80, 0, 55, 0, 1, 1), (9, 0, 0, 0, 70, 0, 1, 1), (3, 0, 4, 0, 5, 0, 1, 1), (2, 0, 1, 0, 1, 0, 1, 1),
    (11, 0, 8, 0, 30, 0, 1, 1), (25, 0.1, 90, 0, 0, 0, 1, 1), (8, 0, 1, 1, 9, 0, 1, 1), (400, 0, 5, 0, 9, 0, 1, 1), (5, 0, 40, 0, 10, 0, 1, 1), (12, 0.3, 40, 0, 35, 0, 1, 1),
    (1, 0, 0, 0, 0, 0, 1, 1), (30, 0, 8, 0, 10, 0, 1, 1), (6, 0.2, 33, 0, 41, 0.05, 1, 1), (18, 0.35, 22, 0, 60, 0, 1, 1), (1, 0, 6, 0, 10, 0, 1, 1), (4, 0, 200, 0, 9, 0.1, 1, 1),
    (50, 0, 60, 0, 20, 1, 1, 1), (3, 0, 70, 0, 14, 0.9, 1, 1), (9, 0, 0, 0, 12, 0.8, 1, 1), (80, 0.1, 2, 1, 9, 1, 1, 1),
    # lists of links in an article
    (2, 1, 60, 0, 2, 1, 1, 1), (3, 1, 2, 1, 2, 1, 1, 1), (5, 1, 3, 1, 0, 0, 1, 1), (8, 0.9, 70, 0, 6, 0.8, 1, 1), (12, 0.95, 9, 0.9, 11, 1, 1, 1), (6, 0.8, 2, 1, 40, 0, 1, 1),
    # in elements apart from the article
    (1, 1, 0, 0, 1, 1, -1, 0), (1, 1, 1, 1, 8, 0, -1, 0), (8, 0, 1, 1, 9, 0, -1, 0), (10, 0, 60, 0, 0, 0, -1, 0), (45, 0, 30, 0, 60, 0, -1, 0), (120, 0, 90, 0, 80, 0, -1, 0),
    (3, 0, 50, 0, 2, 1, -1, 0), (22, 0.1, 8, 0, 25, 0, -1, 0), (5, 0, 5, 0, 5, 0, -1, 0), (70, 0.05, 4, 1, 66, 0, -1, 0), (15, 0, 200, 0, 12, 0, -1, 0), (2, 0, 2, 0, 2, 0, -1, 0),
    # elsewhere: prose and what stands beside it
    (60, 0, 9, 0, 75, 0, 0, 1), (95, 0.05, 60, 0, 22, 0, 0, 1), (30, 0, 3, 1, 45, 0, 0, 1), (25, 0.1, 50, 0, 4, 1, 0, 1), (18, 0, 40, 0, 60, 0, 0, 1), (150, 0.2, 2, 1, 2, 1, 0, 1),
    (9, 0, 2, 1, 70, 0, 0, 1), (7, 0, 80, 0, 64, 0, 0, 1), (5, 0, 33, 0, 38, 0, 0, 1), (10, 0, 45, 0, 28, 0, 0, 1), (12, 0, 70, 0, 20, 0, 0, 1), (20, 0.25, 35, 0, 40, 0, 0, 1),
    (2, 0, 60, 0, 44, 0, 0, 1), (40, 0, 0, 0, 0, 0, 0, 1), (22, 0, 0, 0, 31, 0, 0, 1), (14, 0, 25, 0, 19, 0, 0, 1), (3, 0, 90, 0, 100, 0, 0, 1), (35, 0.3, 12, 0, 16, 0, 0, 1),
    (1, 0, 0, 0, 30, 0, 0, 1), (3, 0, 0, 0, 45, 0, 0, 1), (5, 0, 2, 1, 28, 0, 0, 1), (20, 0, 30, 0, 0, 0, 0, 1), (16, 0, 45, 0, 0, 0, 0, 1), (24, 0, 18, 0, 2, 1, 0, 1), (13, 0, 22, 0, 15, 0, 0, 1),
    (60, 0, 50, 0, 12, 1, 0, 1), (35, 0, 40, 0, 25, 0.9, 0, 1), (90, 0.1, 70, 0, 10, 0.8, 0, 1),
    # elsewhere: links, labels, notes
    (1, 1, 0, 0, 40, 0, 0, 0), (2, 1, 0, 0, 25, 0, 0, 0), (3, 0.9, 2, 1, 30, 0, 0, 0), (2, 1, 50, 0, 0, 0, 0, 0), (4, 0.8, 30, 0, 2, 1, 0, 0), (1, 1, 20, 0, 0, 0, 0, 0),
    (1, 1, 1, 1, 1, 1, 0, 0), (2, 1, 0, 0, 3, 1, 0, 0), (4, 1, 60, 0, 3, 1, 0, 0), (15, 0.9, 12, 1, 14, 1, 0, 0), (30, 0.7, 22, 0.8, 25, 0.9, 0, 0), (6, 0.6, 4, 1, 3, 0.5, 0, 0),
    (3, 0, 1, 1, 2, 1, 0, 0), (5, 0, 2, 1, 3, 1, 0, 0), (4, 0, 50, 0, 0, 0, 0, 0), (8, 0, 3, 0, 0, 0, 0, 0), (2, 0, 2, 0, 3, 0, 0, 0), (7, 0.5, 0, 0, 2, 1, 0, 0), (10, 0.4, 5, 1, 6, 1, 0, 0),
    (3, 0, 0, 0, 2, 1, 0, 0), (9, 0.45, 70, 0, 4, 1, 0, 0), (6, 0, 4, 0, 5, 0, 0, 0), (1, 0, 1, 1, 1, 1, 0, 0), (20, 0.8, 40, 0, 3, 1, 0, 0), (8, 0, 2, 1, 9, 1, 0, 0), (12, 0.7, 45, 0, 30, 0, 0, 0),
], float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 1) -> tuple | int:
    """A binary decision tree by Gini impurity: (feature, threshold, tree up to it, tree beyond it) or a label."""
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        left = np.arange(1, len(y))
        p, q = c[:-1] / left, (c[-1] - c[:-1]) / (len(y) - left)
        cost = left * p * (1 - p) + (len(y) - left) * q * (1 - q)
        cost[(v[1:] == v[:-1]) | (left < least) | (len(y) - left < least)] = np.inf
        i = int(np.argmin(cost))
        if cost[i] < best[0] - 1e-12:
            best = (cost[i], f, (v[i] + v[i + 1]) / 2)
    if best[0] == np.inf:
        return int(y.mean() >= 0.5)
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@lru_cache(maxsize=1)
def tree() -> tuple | int:
    return grow(LABELLED[:, :-1], LABELLED[:, -1])


def decide(node: tuple | int, features: tuple) -> int:
    while not isinstance(node, int):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, is an end tag, attributes) of a page's tags in one pass; comments, declarations and dropped elements have the name "" or their own with the attributes None.

    A < that opens nothing is text. Quoted attribute values may hold >; once quotes turn out to be left open up to the page's
    end, they count as plain characters from there on.
    """
    at, last, quotes, endless, closing = 0, page.rfind(">"), True, set(), {}
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if start > last:
            return
        m = _OPEN.match(page, start)
        if not m:
            if page.startswith(("<!", "<?"), start):
                at = page.find(">", start) + 1
                yield start, at, "", False, ""
            else:
                at = start + 1
            continue
        end, i = -1, m.end()
        while quotes and (stop := _STOP.search(page, i)):
            if stop[0] == ">":
                end = stop.start()
                break
            if (i := page.find(stop[0], stop.end()) + 1) == 0:
                break
        if end < 0:
            quotes = False
            end = page.find(">", m.end())
        tag, attrs, at = m[2].lower(), page[m.end() : end], end + 1
        if tag in DROPPED and not m[1] and not attrs.endswith("/"):
            if tag not in endless:
                shut = closing.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I)).search(page, at)
                if shut or tag in RAW:
                    at = shut.end() if shut else len(page)
                    yield start, at, tag, False, None
                    continue
                endless.add(tag)
            yield start, at, "", False, ""
            continue
        yield start, at, tag, bool(m[1]), attrs


def _grown(word: str) -> bool:
    halves = [(word[:i], word[i:]) for i in range(2, len(word) - 1)]
    return any(a in STRONG and b in NAMES | BESIDE or b in STRONG and (a in NAMES | BESIDE or a in ("user", "reader")) for a, b in halves)


@lru_cache(maxsize=20_000)
def _told(name: str, tag: str, inside: bool) -> bool:
    """Whether a class, id or role name marks what isn't the article; in one there may be headers, banners and comments of code."""
    parts = set(_PARTS.findall(name))
    told = parts & NAMES - ({"header", "banner"} if inside else set())
    if tag in MAIN:
        return bool(told & {"comment", "comments", "reply"}) and parts <= NAMES | BESIDE
    if inside and tag in INLINE and parts & {"comment", "comments"}:
        return False
    if told and parts <= NAMES | BESIDE:
        return True
    if parts & STATES:
        return False
    return bool(parts & STRONG) or any(_grown(x) for x in parts if len(x) < 32) or any(pair <= parts for pair in PAIRS)


def _apart(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is apart from the article by its kind or its names."""
    if tag in APART or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    return any(
        _told(name, tag, inside)
        for value in _NAMED.finditer(attrs) for name in _CAMEL.sub(r"\1-\2", value[1] or value[2] or value[3] or "").lower().split())


def _left_open(tags: list[tuple]) -> set[int]:
    """Starts of the elements of ``ENDED_BY`` that have no end tag of their own."""
    open_, spare = {name: [] for name in ENDED_BY}, set()
    for start, _, tag, ending, attrs in tags:
        if tag in ENDED_BY and attrs is not None and not attrs.endswith("/"):
            if not ending:
                open_[tag].append(start)
            elif open_[tag]:
                open_[tag].pop()
    for starts in open_.values():
        spare.update(starts)
    return spare


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of a page's text blocks, in page order."""
    out: list[tuple[str, int, float, int]] = []
    held: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements with the place they give, and whether an article reaches through
    opened: Counter[str] = Counter()
    link, place, through, head = False, 0, True, False

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                n = text.count(" ") + 1
                m = len(html.unescape(" ".join(linked)).split())
                rights = place == 0 and n <= RIGHTS_WORDS and _RIGHTS.match(text)
                out.append((text, n, min(1.0, m / n), -1 if rights else place))
        held.clear()
        linked.clear()

    def add(text: str) -> None:
        if text and not head:
            held.append(text)
            if link:
                linked.append(text)

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    tags = list(_tags(page))
    spare = _left_open(tags)
    loose: list[tuple[int, int]] = []  # elements left open: depth, blocks before
    at = 0
    for start, end, tag, ending, attrs in tags:
        add(page[at:start])
        at = end
        if not tag:
            continue
        if attrs is None:
            if tag in ("iframe", "object", "select", "textarea", "audio", "video", "title"):
                close()
            continue
        if tag == "head":
            head = not ending
            continue
        if tag == "body":
            head = False
        if tag == "br":
            held.append(" ")
            linked.append(" ")
            continue
        if tag == "a":
            link = not ending and "href" in attrs.lower()
        if tag not in INLINE:
            close()
            if ending or tag in ("p", "li"):
                link = False
        if tag in VOID or attrs.endswith("/"):
            continue
        if ending:
            # a stray end tag closes nothing
            if opened[tag] and not (tag in INLINE and stack[-1][0] not in INLINE):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                if stack[i][1] != (stack[i - 1][1] if i else 0):
                    close()
                while len(stack) > i:
                    pop()
            place, through = stack[-1][1:] if stack else (0, True)
            continue
        if tag == "p" or tag == "li":  # their end tags may be left out
            if stack and stack[-1][0] == tag:
                pop()
            elif tag == "p":
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                    pop()
            place, through = stack[-1][1:] if stack else (0, True)
        while loose and loose[-1][0] > len(stack):
            loose.pop()
        if loose and loose[-1][0] == len(stack) and len(out) > loose[-1][1] and tag in ENDED_BY[stack[-1][0]]:
            loose.pop()
            pop()
            place, through = stack[-1][1:] if stack else (0, True)
        own, reach = place, through
        main = tag in MAIN or tag in ("div", "section") and bool(attrs) and re.search(r"\brole\s*=\s*[\"']?main\b", attrs, re.I)
        if main and place < 0 and through and not _apart(tag, attrs, False):
            own = 1
        elif place >= 0 and tag not in ("html", "body"):
            if _apart(tag, attrs, place == 1):
                own, reach = -1, tag in PASSED
            elif main:
                own = 1
        elif place < 0:
            reach = through and not _apart(tag, attrs, False) or through and tag in PASSED
        if own != place:
            close()
        stack.append((tag, own, reach))
        opened[tag] += 1
        place, through = own, reach
        if start in spare:
            loose.append((len(stack), len(out)))
    add(page[at:])
    close()
    return out


def taken(found: list[tuple[str, int, float, int]]) -> list[bool]:
    """Which blocks the tree takes; of a page where it takes none, those that are neither apart nor links."""
    model, none = tree(), ("", 0, 0.0, 0)
    out = []
    for i, (_, n, density, place) in enumerate(found):
        before = found[i - 1] if i else none
        after = found[i + 1] if i + 1 < len(found) else none
        out.append(bool(decide(model, (n, density, before[1], before[2], after[1], after[2], place))))
    return out if any(out) else [place >= 0 and density < 0.5 for _, _, density, place in found]


def main_text(page: str | None) -> str:
    """The page's main text: the blocks that are taken, joined by a line end."""
    found = blocks(page or "")
    return "\n".join(block[0] for block, take in zip(found, taken(found), strict=True) if take)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per page: id, the columns to keep, text and n_chars (code points).

    Blocks end at block-level tags; inside one, white space (line breaks too) becomes one space.
    Besides the word counts and link densities of a block and its neighbours, the tree sees whether the
    block is inside an article or inside an element that is apart from it (menu, header, footer,
    sidebar, advert, form, notice, comments, hidden). An article's start inside a menu, header, footer or
    form that is still open isn't apart. A menu, form or header without an end tag ends where an element starts that can't be its own, once it has text.
    A note of rights of up to ``RIGHTS_WORDS`` words outside an article is apart. Of a page where the tree takes nothing, blocks that are neither
    apart nor links are the text. Pages of any length are read in one pass. Null, empty and text-less pages give an
    empty text; repeated rows repeat; other columns are left out.
    """

    bound_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text_of(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in batch], pa.string())

    done = pages.select(id_col, *keep, text_of(F.col(html_col)).alias("text"))
    return done.select(id_col, *keep, "text", F.length("text").cast("long").alias("n_chars"))
