"""Main text of web pages by text-to-tag ratios.

The standard library's HTML parser is fed slice by slice; its events become
lines, one for each block element, with their ratio of characters to tags and
the element that holds them. Lines inside menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments have
ratio 0: by their tag or role, by a name that says nothing else (``SURE``, as a
whole), and an article among readers' comments is one. A name that may also be the text's own (inside an article, or next to a
word for a wrapper) only makes its element doubtful: it counts as such if none of
its lines, smoothed among themselves, reaches the threshold. The ratios are smoothed by a Gaussian over the neighbouring lines and
those at or above their standard deviation are content. The content region are
the outermost article and main elements with content lines, if they hold most of
their characters, or else the smallest container that holds all of them; its
lines, long and short, and the content lines outside it are the text.

Per page: one scan, no shuffle, pages whole.

Edge cases: null and empty pages, and pages without text, give an empty text;
unclosed elements end with their page, and so does a tag without its closing
mark; other broken markup is read as the parser reads it. The time is linear in
the page: open elements are found by their tag.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
                  "td tfoot th thead title tr ul".split())
CONTAINER = frozenset("article body center div html main section table tbody td tr".split())
DROPPED = frozenset("aside button canvas footer form head iframe menu nav noscript object script select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                  "disqus footer login menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo "
                  "promoted related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar".split())
#: A name with one of these may mean a wrapper of the text, not one of the above.
WRAPPERS = frozenset("article body container content entry has layout main page post text with wrap wrapper".split())
#: Names of headings come from their text; inside an article only these can be named as something else.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GROUPS = frozenset("aside div ol section ul".split())
#: Whole names of what is not the text, wherever it stands (- and _ are alike).
SURE = frozenset("ad ads ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper adbox adslot advert adverts advertisement advertisements advertising banner-ad sponsored "
                 "sponsored-content promo promoted promotion comment comments comment-list comment-section comment-thread comments-area comments-list "
                 "comments-section disqus disqus-thread post-comments reader-comments user-comments replies respond consent cookie-banner cookie-bar "
                 "cookie-consent cookie-notice cookies-notice consent-banner notice notices site-notice newsletter newsletter-box newsletter-form "
                 "newsletter-signup signup signup-form subscribe subscribe-box share-bar share-buttons share-links social social-links social-share sidebar "
                 "side-bar breadcrumb breadcrumbs pagination pager popup modal toolbar topbar menu nav navbar navigation login login-form".split())
#: Of those the ones that may as well be the anchor of a section of the text.
ANCHORS = frozenset("ad ads advertising promotion comment notice notices social consent menu navigation login replies respond sponsored".split())
SURE_TAGS = GROUPS | frozenset("blockquote details dialog dl figure p span table".split())
#: Containers in which an article is a reader's.
TALK = frozenset("comment comments discussion discussions replies responses thread".split())
STOPS = CONTAINER | DROPPED | frozenset("blockquote ol ul".split())
SLICE = 1 << 16
TAG = re.compile("<[a-zA-Z/!?]")


@dataclass(frozen=True)
class TextParams:
    sigma: float = 1.5
    region_share: float = 0.8


class _Lines(HTMLParser):
    """Collects (text, tags, node, dropped) lines; nodes are open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = [""]
        self.parent: list[int] = [0]
        self.off: list[bool] = [False]
        self.inside: list[bool] = [False]  # an article or main element
        self.doubt = [0]  # the nearest doubtful element, itself or above
        self.talk = [False]  # inside a container of readers' comments
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # depths of the open elements, by tag
        self.blocks: list[int] = []
        self.stops: list[int] = []
        self.lines: list[tuple[str, int, int, bool]] = []
        self.buf: list[str] = []
        self.seen = 0

    def flush(self) -> None:
        if self.buf:
            text = " ".join("".join(self.buf).split())
            self.buf.clear()
            if text:
                self.lines.append((text, self.seen, self.open[-1], self.off[self.open[-1]]))
        self.seen = 0

    def _boiler(self, tag: str, attrs: list, inside: bool) -> tuple[bool, bool]:
        """Whether an element is dropped; whether it is doubtful."""
        if tag in DROPPED or tag == "header" and not inside:
            return True, False
        if tag in ("html", "body", "main"):
            return False, False
        named = [(k, v) for k, v in attrs if v and k in ("class", "id")]
        if tag == "article":
            talk = self.talk[self.open[-1]] or any(whole_name(n) in TALK for k, v in named if k == "class" for n in v.split())
            return talk, False
        doubt = False
        for k, v in attrs:
            if k == "role" and v and v.strip().lower() in ROLES:
                return True, False
        for k, v in named:
            for name in v.split():
                whole = whole_name(name)
                if whole in SURE and (tag in SURE_TAGS if k == "class" else tag in GROUPS and whole not in ANCHORS):
                    return True, False
                if tag not in HEADINGS and (tag in GROUPS or not inside):
                    words = set(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()))
                    wraps = words & WRAPPERS
                    if not inside and not wraps and (words & NAMES or "header" in words):
                        return True, False
                    doubt = doubt or bool(words & NAMES) and tag in BLOCK
        return False, doubt

    def _open(self, tag: str, node: int) -> None:
        depth = len(self.open)
        self.open.append(node)
        self.at.setdefault(tag, []).append(depth)
        if tag in BLOCK:
            self.blocks.append(depth)
        if tag in STOPS:
            self.stops.append(depth)

    def _close(self, depth: int) -> None:
        """Close all elements from ``depth`` up; each is closed once."""
        while len(self.open) > max(1, depth):
            tag = self.tags[self.open.pop()]
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in STOPS:
                self.stops.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.seen += 1
        if tag == "br":
            self.buf.append(" ")
        if tag in VOID:
            return
        if tag == "body":
            self._close(1)
        elif (tag == "p" or tag == "li") and self.at.get(tag) and self.at[tag][-1] > (self.stops[-1] if self.stops else 0):
            self._close(self.at[tag][-1])  # such an element ends the one that is open
        up = self.open[-1]
        node = len(self.tags)
        off, doubt = self._boiler(tag, attrs, self.inside[up])
        self.tags.append(tag)
        self.parent.append(up)
        self.inside.append(self.inside[up] or tag in ("article", "main"))
        self.talk.append(self.talk[up] or tag in GROUPS and any(whole_name(n) in TALK for k, v in attrs if v and k in ("class", "id") for n in v.split()))
        self.off.append(self.off[up] or off)
        self.doubt.append(node if doubt else self.doubt[up])
        self._open(tag, node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.tags[self.open[-1]] == tag and tag in ("svg", "path", "g", "use"):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        self.seen += 1
        depth = self.at[tag][-1] if self.at.get(tag) else 0
        if depth and (tag in BLOCK or not self.blocks or self.blocks[-1] < depth):  # an inline end tag closes no block
            self._close(depth)

    def handle_data(self, data):
        if not self.off[self.open[-1]] or self.tags[self.open[-1]] not in ("script", "style"):
            self.buf.append(data)

    def read(self, html: str) -> None:
        """Feed slices; what the parser can't finish yet is not read again
        before as much has come. A tag that never closes ends with the page."""
        at = 0
        while at < len(html):
            end = at + max(SLICE, len(self.rawdata))
            self.feed(html[at:end])
            at = end
        if ">" not in self.rawdata:
            tail, self.rawdata = self.rawdata, ""
            cut = TAG.search(tail)
            tail = unescape(tail[: cut.start()] if cut else tail)
            if tail:
                self.handle_data(tail)
        self.close()
        self.flush()


def whole_name(name: str) -> str:
    return name.lower().replace("_", "-")


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over neighbouring lines; the ends have fewer neighbours."""
    r = math.ceil(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    same = slice(r, r + len(x))
    return np.convolve(x, k)[same] / np.convolve(np.ones(len(x)), k)[same]


def _low(parser: _Lines, ratio: np.ndarray, sigma: float) -> list[bool]:
    """For each line, whether it lies in a doubtful element without any line
    that reaches the threshold, smoothed among that element's own lines."""
    own: dict[int, list[int]] = {}
    for i, (_, _, node, off) in enumerate(parser.lines):
        if not off and parser.doubt[node]:
            own.setdefault(parser.doubt[node], []).append(i)
    if not own:
        return [False] * len(ratio)
    least = smoothed(ratio, sigma).std()
    doubtful = sorted({*parser.doubt} - {0})
    high = {0} | {n for n, at in own.items() if smoothed(ratio[at], sigma).max() >= least}
    high |= {n for n in range(1, len(parser.tags)) if parser.tags[n] in ("article", "main")}
    for n in range(len(parser.tags) - 1, 0, -1):
        if n in high:  # what holds an article or such lines is not low
            high.add(parser.doubt[parser.parent[n]])
    low = {0: False}
    for n in doubtful:
        low[n] = low[parser.doubt[parser.parent[n]]] or n not in high
    return [low[parser.doubt[node]] for _, _, node, _ in parser.lines]


def main_text(html: str | None, p: TextParams = TextParams()) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.read(html)
    lines = parser.lines
    ratio = np.array([0.0 if off else len(t) / max(1, tags) for t, tags, _, off in lines])
    if not ratio.any():
        return ""
    low = np.array(_low(parser, ratio, p.sigma))
    if low.any() and ratio[~low].any():
        lines = [(t, tags, node, off or bad) for (t, tags, node, off), bad in zip(lines, low.tolist(), strict=True)]
        ratio[low] = 0.0
    soft = smoothed(ratio, p.sigma)
    picked = (soft >= soft.std()) & (ratio > 0)
    if not picked.any():
        picked = ratio > 0
    mass: dict[int, int] = {}
    for (t, _, node, _), ok in zip(lines, picked, strict=True):
        if ok:
            mass[node] = mass.get(node, 0) + len(t)
    for node in range(len(parser.tags) - 1, 0, -1):  # children have higher numbers
        if node in mass:
            up = parser.parent[node]
            mass[up] = mass.get(up, 0) + mass[node]
    tags, total = parser.tags, mass[0]
    # nothing below the outermost articles, if they hold the mass; or else what covers every content line: of those, the one opened last
    tops = [n for n in mass if tags[n] in ("article", "main") and not parser.inside[parser.parent[n]]]
    if sum(mass[n] for n in tops) < p.region_share * total or not tops:
        tops = [max(n for n, m in mass.items() if m == total and (tags[n] in CONTAINER or not n))]
    within = [False] * len(tags)
    for n in tops:
        within[n] = True
    for node in range(1, len(tags)):
        within[node] = within[node] or within[parser.parent[node]]
    return "\n".join(t for (t, _, node, off), ok in zip(lines, picked, strict=True) if not off and (ok or within[node]))


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
                 params: TextParams | None = None) -> DataFrame:
    """``keep`` of every row, text and n_chars."""
    p = params or TextParams()
    types = dict(pages.select(*keep).dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.num_columns - 1)
            _, offs = C.text_bytes(col)
            for i, j in C.chunks(offs):
                texts = [main_text(h, p) for h in col.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:-1]), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return C.map_batches(pages.select(*keep, pages[html].cast("string").alias("__html")), run, schema)
