"""Main text of web pages by tag-path ratios.

Method: a page is a sequence of text blocks, each below a path of elements from the root; blocks of one tag in the same
element share a path. For each path the length of its text, its punctuation and its text in links are summed. The
ratios are smoothed over neighbours within an element and fused to the path's weight, by which `article` and `main` have a share more and parts that
say what they are (`nav`, `footer`, a class `ad` and so on) have none; paths above a share of the page's mean weight are
content. Text of content paths counts for the elements around it, other text against them, and the element with the
highest sum holds the article. Blocks at its edges that are no content go, those between content stay if they have any weight.

Nothing depends on how long a page or an article is. All steps take time in proportion to the page, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow

# Names of elements in the HTML standard, and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter nobr output picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video title".split())
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg math canvas audio video select button textarea dialog menu title".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner billboard breadcrumb breadcrumbs byline-ad comment comments commentlist consent cookie cookies disclaimer discussion disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription teaser toc toolbar tracking widget".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
NOISE_ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = frozenset("article main".split())

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>?|<[!?][^>]*>?", re.S)
_ATTRS = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_MARKS = re.compile(r"[.,;:!?…。，、؟]")


def _noise(tag: str, attrs: str, in_article: bool) -> int:
    """2 for what no reader sees, 1 for what says that it isn't the article, else 0."""
    if tag in HIDDEN:
        return 2
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return 1
    if not attrs or tag in ("html", "body") or "=" not in attrs and "hidden" not in attrs:
        return 0
    found = 0
    for name, *values in _ATTRS.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" and tag not in INLINE or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name == "role" and value in NOISE_ROLES:
            found = 1
        if name in ("class", "id") and tag not in ("main",):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & NOISE_WORDS and not (tag == "article" and not words & {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "related", "teaser"}) or words & HEADER_WORDS and not in_article:
                found = 1
    # what stands within a block can't be weighed for itself
    return 2 if found and tag in INLINE else found


class Page:
    """Elements in document order, and text blocks, with those that are noise by name marked."""

    def __init__(self, page: str):
        self.tags, self.parents, self.in_article = [""], [0], [False]
        #: (element, text, characters in links, whether it's noise by name)
        self.blocks: list[tuple[int, str, int, bool]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int]] = []  # tag, the noise that it or one around it is, element
        open_at: dict[str, list[int]] = {}  # places of a tag's open elements in the stack
        solid: list[int] = []  # places of those that aren't inline
        held: list[str] = []
        element = links = 0
        named = False

        def end() -> None:
            nonlocal links
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                self.blocks.append((element, text, links, named))
            held.clear()
            links = 0

        def last(tags) -> int:
            return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

        def cut(place: int) -> None:
            while len(stack) > place:
                open_at[stack.pop()[0]].pop()
                if solid and solid[-1] >= len(stack):
                    solid.pop()

        def text(piece: str) -> None:
            nonlocal element, links, named
            if not piece or stack and stack[-1][1] == 2:
                return
            if not held:
                if piece.isspace():
                    return
                element = stack[solid[-1]][2] if solid else 0
                named = bool(stack and stack[-1][1])
            held.append(piece)
            if open_at.get("a"):
                links += len(piece.strip())

        at, size = 0, len(page)
        while at < size:
            m = _TAG.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if closing:
                k = last((tag,))
                if k >= 0:
                    if tag in INLINE and solid and solid[-1] > k:
                        continue  # an inline end tag doesn't close blocks
                    if tag not in INLINE:
                        end()
                    cut(k)
                elif tag not in INLINE:
                    end()
                continue
            if tag == "br":
                text("\n" if held else "")
                continue
            if tag not in INLINE:
                end()
                if tag in CLOSES_P and (k := last(("p",))) >= 0 and last(("td", "th", "table", "div", "button", "object")) < k:
                    cut(k)
                if tag in SIBLINGS:
                    close, stop = SIBLINGS[tag]
                    while (k := last(close)) > last(stop - close):
                        cut(k)
                        if tag != "tr":
                            break
            if tag in VOID or attrs.endswith("/") and tag in ("svg", "path", "use"):
                continue
            inside = self.in_article[stack[solid[-1]][2]] if solid else False
            noise = max(stack[-1][1] if stack else 0, _noise(tag, attrs, inside))
            if tag in RAW:  # ends at its own end tag only
                e = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
                at = size if e is None else e.end()
                continue
            own = 0
            if tag not in INLINE:
                own = len(self.tags)
                self.parents.append(stack[solid[-1]][2] if solid else 0)
                self.tags.append(tag)
                self.in_article.append(inside or tag in ARTICLE)
                solid.append(len(stack))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, noise, own))
        end()


#: Share of a page's mean weight above which a path is content, and share of text in links above which it isn't.
THRESHOLD, LINKS = 0.3, 0.5
#: How many times a path's weight is what its ratios say: in `article` and `main`, and in parts that are noise by name.
ARTICLE_PRIOR, NOISE_PRIOR = 4.0, 0.0


def _smooth(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Over neighbours of the same group; at a group's edge a block stands in for its missing neighbour."""
    before = np.where(np.append(False, group[1:] == group[:-1]), np.roll(x, 1), x)
    after = np.where(np.append(group[1:] == group[:-1], False), np.roll(x, -1), x)
    return 0.25 * before + 0.5 * x + 0.25 * after


def path_weights(path: np.ndarray, holder: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, share in links) of each block's path. path: the blocks' paths, as numbers from 0; holder: the elements around these.

    A path's characters and marks a block are smoothed, over blocks, and fused: characters times one more than marks times the share outside of links."""
    total, chars, points, link = (np.bincount(path, weights=x) for x in (np.ones(len(path)), length, marks, linked))
    density = (link / chars)[path]
    return _smooth((chars / total)[path], holder) * (1 + _smooth((points / total)[path], holder)) * (1 - density), density


def threshold(weight: np.ndarray, length: np.ndarray) -> float:
    """THRESHOLD times the mean weight, each character counted by its weight, so that text without weight doesn't lower it however long it is."""
    return THRESHOLD * (weight * weight) @ length / max(weight @ length, 1e-300)


def main_text(page: str | None) -> str:
    """The article of a page; empty if there is none."""
    own = Page(page or "")
    if not own.blocks:
        return ""
    element = np.array([b[0] for b in own.blocks])
    length = np.array([len(b[1]) for b in own.blocks], float)
    marks = np.array([len(_MARKS.findall(b[1])) for b in own.blocks], float)
    linked = np.array([min(b[2], len(b[1])) for b in own.blocks], float)
    named = np.array([b[3] for b in own.blocks])
    parent, tag = np.array(own.parents), [own.tags[e] for e in element]
    holder, inside = parent[element], np.array(own.in_article)[element]
    names = {t: i for i, t in enumerate(sorted(set(tag)))}
    _, path = np.unique((holder * len(names) + np.array([names[t] for t in tag])) * 2 + named, return_inverse=True)
    weight, density = path_weights(path, holder, length, marks, linked)
    weight = weight * np.where(named, NOISE_PRIOR, np.where(inside, ARTICLE_PRIOR, 1.0))
    heading = np.array([re.fullmatch("h[1-6]", t) is not None for t in tag])
    only_links = linked > LINKS * length
    text = (weight > 0) & (density <= LINKS) & ~only_links
    title = np.array([t in ("h1", "h2") for t in tag]) & (weight > 0) & (density <= LINKS)
    links = (density > LINKS) & only_links & ~heading

    # a page of links alone has no weights to choose by
    content = text & (weight >= threshold(weight[text], length[text])) if text.any() else ~named
    # what elements hold: content for them, other text against them; headings, what is in an article, and what has no weight by its name, neither
    gain = np.where(content, length, np.where(inside | named | heading & (density <= LINKS), 0.0, -length))
    sums = np.bincount(element, weights=gain, minlength=len(parent))
    for e in range(len(parent) - 1, 0, -1):  # children come after their parents
        sums[parent[e]] += sums[e]
    root = int(len(sums) - 1 - np.argmax(sums[::-1]))  # of equals the innermost
    for e in _up(root, parent):
        if sums[e] < sums[root]:
            break
        if own.tags[e] in ARTICLE:
            root = e
    below = np.zeros(len(parent), bool)
    below[root] = True
    for e in range(root + 1, len(parent)):
        below[e] = below[parent[e]]
    keep = below[element] & ((weight > 0) | ~named)
    where = np.flatnonzero(keep & content)
    if not len(where):
        return ""
    here = np.arange(len(path))
    edge = (here < where[0]) | (here > where[-1])
    beside = np.isin(holder, holder[where]) & text
    keep &= ~edge | beside | heading & text | inside | title
    seen, to_come = np.cumsum(content & ~heading), np.cumsum((content & ~heading)[::-1])[::-1]
    keep &= ~(links & (edge | (seen == 0) | (to_come == 0)))  # links stay between content
    if not own.in_article[root]:  # titles that stand before the article's element, and text between them and it
        before = here < np.flatnonzero(below[element])[0]
        start = np.flatnonzero(title & before)
        if len(start):
            keep |= before & (here >= start[0]) & (text | title)
    return "\n\n".join(b[1] for b, k in zip(own.blocks, keep, strict=True) if k)


def _up(element: int, parents) -> Iterator[int]:
    """An element and those around it."""
    while element:
        yield element
        element = int(parents[element])


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [main_text(h) for h in b.column(2).to_pylist()]
        yield batch(_SCHEMA, b.column(0), b.column(1), found, [len(t) for t in found])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; n_chars counts code points.

    Null and empty html, and pages without text, give an empty text. What isn't closed ends where the standard
    ends it, or with the page. Repeated rows are extracted each for itself; other columns are ignored; an empty
    table gives an empty result.
    """
    return map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), _extract, "page_id long, url string, text string, n_chars long")
