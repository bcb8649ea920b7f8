"""Main text of web pages by tag-path ratios.

A page is read into blocks, each with the path of elements from the root to it. Text length and
punctuation are summed over each path (so a short paragraph shares its path's figures), the two ratios are
smoothed over neighbouring blocks, fused with what elements and their names say (menus, adverts, forms ...), and
paths above a threshold are content. Inside the element that holds most of it a lower threshold holds, and headings
complete it; all content blocks are kept whole, in page order.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._common import slices, texts_of

# Elements by what they mean for text, words of class, id and role that mark what is no article, and those before them that say what stands beside it.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video noframes".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SCOPES = frozenset("article section main body html div table td th aside nav header footer form blockquote figure li ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
APART = frozenset("nav footer aside form button select option menu dialog search fieldset label".split())
NO_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies "
    "dialog footer form gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion "
    "recommended related search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription teaser toc toolbar widget widgets alert complementary contentinfo "
    "overlay disclaimer copyright reactions replies reply".split()
)
BESIDE = frozenset("with without has no".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A comment, a declaration, a tag (values in quotes are taken whole; tags with longer ones are left to ``tag_end``) or text; what fits none may be a tag that breaks off.
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]{0,1000}\"|'[^']{0,1000}')*+)>|([^<]+|<(?![a-zA-Z/!?]))", re.S)
START = re.compile(r"<([a-zA-Z][^\s/<>]*)")
SPECIAL = re.compile(r"[<>\"']")
#: Attributes with their values, and a quick look for those that matter.
ATTRIBUTE = re.compile(r"([^\s=\"'/<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MATTERS = re.compile(r"class|id|role|aria-|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
WORDS = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？¿¡()\"'«»“”—-]")

#: Share of the strongest path's value from which a path is content on its own, from which it is content inside the element that holds most
#: content, share of a path's text in links above which it is a list of links, and share of the content from which an article element is the article.
THRESHOLD, INSIDE, LINKS, ARTICLE = 0.5, 0.12, 0.6, 0.2


def _apart(tag: str, attributes: str) -> int:
    """Does an element say of itself that it is no article? 2: by what it is; 1: by a name only; 0: no."""
    if tag in APART:
        return 2
    if not MATTERS.search(attributes):
        return 0
    named = 0
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next(filter(None, values), "")
        if key == "hidden" or (key == "style" and UNSEEN.search(value)) or (key == "aria-hidden" and value.lower() == "true"):
            return 2
        if key in ("class", "id", "role", "aria-label"):
            for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
                words = WORDS.findall(name)
                if words and words[0] not in BESIDE and not NO_ARTICLE.isdisjoint(words):
                    named = int(tag not in ("html", "body", "article", "main"))
    return named


def tag_end(html: str, at: int, broken: set[int]) -> int:
    """Where a tag whose name ends at a place is over: after the first > that is in no quotes; -1 if it breaks off, at a < or the page's end.
    ``broken`` keeps the places from which it was seen to, so that no stretch of a page is gone over for each of its tags."""
    seen = []
    while at not in broken:
        seen.append(at)
        m = SPECIAL.search(html, at)
        if m is None or m[0] == "<":
            break
        if m[0] == ">":
            return m.end()
        at = html.find(m[0], m.end()) + 1
        if not at:
            break
    broken.update(seen)
    return -1


class Page:
    """Blocks of a page: text, path, what is apart around (-1: by what it is; a number: the outermost element that only a name sets apart; 0: nothing),
    text in links, element, whether a heading."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, int, bool]] = []
        self._parents, self._open = [0], defaultdict(int)
        self._paths: dict[tuple[int, str], int] = {}
        # an element: (tag, number of path, apart, in a link, number of itself or the container around, in an article, in a heading)
        self._stack: list[tuple[str, int, int, bool, int, bool, bool]] = [("", 0, 0, False, 0, False, False)]
        self._named, self.articles = 0, {0}
        self._held: list[str] = []
        self._linked, self._number = 0, 0
        at, size, broken = 0, len(html), set()
        while at < size:
            m = TOKEN.match(html, at)
            if m is None:
                name = START.match(html, at)
                end = tag_end(html, name.end(), broken) if name else -1
                if end < 0:  # it breaks off: markup up to the next end, or to the page's
                    at = html.find(">", at) + 1 or size
                    continue
                at = self._tag(html, name[1].lower(), html[name.end() : end - 1], end)
                continue
            at = m.end()
            if m[4]:
                self._held.append(m[4])
                if self._stack[-1][3]:
                    self._linked += len(m[4])
            elif m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._end(tag)
                    continue
                at = self._tag(html, tag, m[3], at)
        self._flush()

    def _tag(self, html: str, tag: str, attributes: str, at: int) -> int:
        """A start tag that is over at a place; where to read on: after what is no text in it."""
        if tag not in RAW:
            self._start(tag, attributes)
            return at
        self._held.append(" ")
        if attributes.endswith("/"):
            return at
        close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
        return close.end() if close else len(html)

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            close = CLOSES.get(tag) or ()
            for k in range(len(self._stack) - 1, 0, -1):
                held = self._stack[k][0]
                if held == "p" or held in close or (held in HEADINGS and tag in HEADINGS):
                    self._cut(k)
                    break
                if held in SCOPES:
                    break
        elif tag == "br":
            self._held.append("\n")
        if tag in VOID:
            return
        if attributes.endswith("/") and tag not in BLOCKS:
            return
        parent = self._stack[-1]
        path = parent[1]
        if block or tag in APART:
            path = self._paths.setdefault((path, tag), len(self._paths) + 1)
        self._open[tag] += 1
        number = parent[4]
        if tag in SCOPES:
            self._number += 1
            self._parents.append(number)
            number = self._number
            if tag in ("article", "main"):
                self.articles.add(number)
        away, own = parent[2], _apart(tag, attributes)
        if own == 2 or (tag == "header" and not parent[5]):
            away = -1
        elif own and not away:
            self._named += 1
            away = self._named
        self._stack.append((tag, path, away, parent[3] or tag == "a", number, parent[5] or tag in ("article", "main"), parent[6] or tag in HEADINGS))

    def _end(self, tag: str) -> None:
        if tag == "p" or tag in BLOCKS:
            self._flush()
        elif tag in APART:
            self._flush()
        if not self._open[tag]:
            return
        for k in range(len(self._stack) - 1, 0, -1):
            held = self._stack[k][0]
            if held == tag:
                self._cut(k)
                return
            if held in SCOPES and tag not in SCOPES:
                return

    def _cut(self, k: int) -> None:
        for element in self._stack[k:]:
            self._open[element[0]] -= 1
        del self._stack[k:]

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self._held)).split()) if self._held else ""
        if text:
            top = self._stack[-1]
            self.blocks.append((text, top[1], top[2], self._linked, top[4], top[6]))
        self._held, self._linked = [], 0

    def content(self) -> list[str]:
        """The texts of content blocks in page order."""
        blocks = self.blocks
        if not blocks:
            return []
        length = np.array([len(b[0]) for b in blocks], float)
        away = np.array([b[2] for b in blocks])
        # a name sets an element apart, but where names would leave nothing but headings, the one that holds most is the page's own frame
        plain = (away >= 0) & ~np.array([b[5] for b in blocks])
        apart = away != 0
        if plain.any() and not (plain & ~apart).any():
            apart &= away != np.bincount(away[plain], length[plain]).argmax()
        paths = np.unique([b[1] for b in blocks], return_inverse=True)[1]
        # paths of links for the most part are lists of links
        links = np.bincount(paths, [b[3] for b in blocks]) / np.bincount(paths, length)
        open_ = ~apart & (links <= LINKS)[paths]
        if not open_.any():
            return []
        marks = np.array([len(PUNCTUATION.findall(b[0])) for b in blocks], float)
        weight = path_values(paths, length, marks, open_)
        headings = np.array([b[5] for b in blocks])
        # headings are short: what is around them decides
        strong = weight[paths[~headings]].max(initial=0) or weight.max()
        content = open_ & (weight[paths] >= INSIDE * strong)
        core = open_ & (weight[paths] >= THRESHOLD * strong) & ~headings
        core = core if core.any() else content
        # elements are numbered in page order, so what one holds is a range of numbers
        own = np.array([b[4] for b in blocks])
        size = len(self._parents)
        last = np.arange(size)
        held, shut, whole = (np.bincount(own, w, size) for w in (length * core, length * ~open_, length * ~headings))
        for e in range(size - 1, 0, -1):
            up = self._parents[e]
            last[up] = max(last[up], last[e])
            for sums in (held, shut, whole):
                sums[up] += sums[e]
        # the innermost element that holds most of what is content on its own; outwards while nothing but headings comes in
        total = length[core].sum()
        most = np.flatnonzero(held >= 0.8 * total)
        container = int(most[-1]) if len(most) else 0
        while container not in self.articles and not shut[self._parents[container]] and whole[self._parents[container]] <= whole[container]:
            container = self._parents[container]
        # an article element that holds a good part of it is the article, whatever stands around
        articles = [e for e in self.articles if e and held[e] >= ARTICLE * total]
        if articles:
            container = max(articles, key=lambda e: (held[e], e))
        inside = (own >= container) & (own <= last[container])
        return [b[0] for b, keep in zip(blocks, open_ & ((inside & (content | headings)) | (core & (not articles)))) if keep]


def path_values(paths: np.ndarray, length: np.ndarray, marks: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The value of each path: its ratios of text and punctuation to blocks, fused with those of the neighbourhood of its open blocks."""
    nodes = np.bincount(paths)
    by_length = (np.bincount(paths, length) / nodes)[paths]
    by_marks = (np.bincount(paths, marks) / nodes)[paths]
    kernel = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
    smooth = [np.convolve(np.pad(v, 2, mode="edge"), kernel / kernel.sum(), "valid") for v in (by_length, by_marks)]
    value = np.sqrt(np.sqrt(by_length * smooth[0]) * (1 + np.sqrt(by_marks * smooth[1]))) * open_
    return np.bincount(paths, value * length) / np.maximum(np.bincount(paths, length * open_), 1)


def main_text(html: str) -> str:
    """Content blocks joined by an empty line; the empty text if there are none."""
    return "\n\n".join(Page(html).content())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page, from the whole html.

    A null or empty html, or one without content, gives the empty text. Broken markup (elements that are
    never closed or never opened, comments and tags without an end) is read as far as it goes. Repeated rows,
    ties and null ids keep one row each; an empty table gives none; other columns are not read. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(h) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
