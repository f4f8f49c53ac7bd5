"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering of regions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role in HTML.
SKIP = frozenset("script style noscript template svg canvas iframe object select textarea button head audio video math".split())
ASIDE = frozenset("form nav footer aside dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("html body main article section div table tbody tr td center form nav aside footer header dialog".split())
# Words of class, id and role that name what is not main text, and words that deny the next one.
NOISE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header masthead comment comments commentlist discussion disqus replies reply respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget toolbar copyright legal search hidden complementary contentinfo".split())
DENIES = frozenset("with has no without".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Standard deviation, in lines, of the smoothing.
SIGMA = 1.0
#: Share of its parent's content that an element must hold to stand for it.
SHARE = 0.8
_SPACE = re.compile(r"\s+")
_CUT_OFF = re.compile(r"<[!?/a-zA-Z]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _named(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words of NOISE in class, id and role; `hidden` for what is not shown."""
    found = set()
    for k, v in attrs:
        if k in ("hidden", "aria-hidden") and v != "false" or k == "style" and _HIDDEN.search(v or ""):
            found.add("hidden")
        elif k in ("class", "id", "role") and v:
            for name in v.split():
                words = [w.lower() for w in _WORD.findall(name)]
                found.update(w for before, w in zip(["", *words], words, strict=False) if w in NOISE and before not in DENIES)
    return found


class Lines(HTMLParser):
    """Cuts a page into lines, one for each block, and notes the block elements around them.

    lines: text, tags, characters inside links, and number of the innermost element. parents, tags_of, named: of each
    element; element 0 is the page. named tells what its tag, class, id or role says that it is, if not main text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parents, self.tags_of, self.named = [-1], [""], [frozenset()]
        self.open: list[tuple[str, int]] = []  # with the number of block elements, else -1
        self.skipping = 0  # depth at which an element without text began
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, min(self.linked, len(text)), self._element()))
            self.tags = 0
        self.text, self.linked = [], 0

    def _element(self) -> int:
        return next((n for _, n in reversed(self.open) if n >= 0), 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipping:
            if tag not in VOID:
                self.open.append((tag, -1))
            return
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in CLOSES_P and self._near("p"):
            self.handle_endtag("p")
        elif tag == "li" and self._near("li", "ul", "ol", "menu"):
            self.handle_endtag("li")
        if tag not in INLINE:
            self.flush()
            self.links = 0
        if tag in VOID:
            return
        if tag in SKIP:
            self.flush()
            self.open.append((tag, -1))
            self.skipping = len(self.open)
            return
        named = _named(attrs) if attrs and tag not in ("html", "body") else frozenset()
        if tag in INLINE and not named:
            self.links += tag == "a"
            self.open.append((tag, -1))
            return
        if named:
            self.flush()
        parent = self._element()
        if tag in ("article", "main"):
            named = named & {"hidden"}
        elif tag in ASIDE or (tag == "header" and not any(x in ("article", "main") for x, _ in self.open)):
            named = {*named, tag + " element"}
        self.open.append((tag, len(self.parents)))
        self.parents.append(parent)
        self.tags_of.append(tag)
        self.named.append(frozenset(named))

    def _near(self, tag: str, *walls: str) -> bool:
        for x, _ in reversed(self.open):
            if x == tag:
                return True
            if x in walls or x in ("article", "section", "div", "td", "table", "body", "main", "button"):
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not any(x == tag for x, _ in self.open):
            return
        if not self.skipping:
            self.tags += 1
        at = max(i for i, (x, _) in enumerate(self.open) if x == tag)
        if tag in INLINE and any(x not in INLINE for x, _ in self.open[at:]):
            return  # a stray inline end does not close blocks
        if not self.skipping and (tag not in INLINE or self.open[at][1] >= 0):
            self.flush()
        while len(self.open) > at:
            self._close()

    def _close(self) -> None:
        tag, _ = self.open.pop()
        if tag == "a" and self.links:
            self.links -= 1
        if self.skipping > len(self.open):
            self.skipping = 0

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        if _CUT_OFF.match(self.rawdata):  # markup that the page ends within
            self.rawdata = ""
        super().close()
        if not self.skipping:
            self.flush()


def smooth(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian over neighbouring lines, normalised at the ends."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    n = len(ratio)
    return np.convolve(ratio, kernel)[r : r + n] / np.convolve(np.ones(n), kernel)[r : r + n]


def content_lines(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Whether each line's smoothed ratio of text outside links to tags reaches the threshold: the smoothed ratios'
    standard deviation, as far as their median allows."""
    ratio = smooth(np.array([(len(t) - linked) / max(tags, 1) for t, tags, linked, _ in lines], np.float64))
    return ratio >= min(ratio.std(), float(np.median(ratio)))


def extract(html: str | None) -> str:
    """Main text: its blocks in page order, one a line.

    Content lines by smoothed text-to-tag ratio are gathered by the elements around them. What is named as noise goes,
    unless it holds most of the content and a first heading, article or main element (or, where there is none, three
    content lines at least): then it is a wrapper with an unlucky name, a form around the page or an element never
    closed. From the page downwards the region is narrowed to the element that holds nearly all of the content left;
    sibling articles stay together. All lines of the region stay, so short paragraphs do. Where the region is the page
    itself or such a wrapper, parts without content lines and parts that are mostly links go.
    """
    page = Lines()
    page.feed(html or "")
    page.close()
    lines = page.lines
    if not lines:
        return ""
    n, parents, tags = len(page.parents), page.parents, page.tags_of
    content = content_lines(lines)
    kept = _without_noise(page, content)
    held, articles, titles = [0] * n, [0] * n, [0] * n
    for (text, _, _, e), ok in zip(lines, content, strict=True):
        if not kept[e]:
            held[e] += len(text) * bool(ok)
            titles[e] += tags[e] == "h1"
    children: dict[int, list[int]] = {}
    for e in range(n - 1, 0, -1):  # children have larger numbers
        held[parents[e]] += held[e]
        titles[parents[e]] += titles[e]
        articles[parents[e]] += tags[e] == "article" and held[e] > 0
        if tags[e] in SECTIONS:
            children.setdefault(parents[e], []).append(e)
    region = 0
    while tags[region] != "article" and (inner := [e for e in children.get(region, []) if held[e] and held[e] >= SHARE * held[region]]):
        best = max(inner, key=held.__getitem__)
        if (tags[best] == "article" and articles[region] > 1) or titles[region] > titles[best] == 0:
            break
        region = best
    # the section of the region that each element lies in, or the region; -1 outside
    part = [-1] * n
    part[region] = region
    for e in range(region + 1, n):
        up = part[parents[e]]
        part[e] = e if up == region and tags[e] in SECTIONS else up
    if tags[region] not in ("", "html", "body") and not page.named[region]:
        return "\n".join(t for t, _, _, e in lines if part[e] >= 0 and not kept[e])
    size, links, some = [0] * n, [0] * n, [False] * n
    for (text, _, linked, e), ok in zip(lines, content, strict=True):
        if part[e] >= 0 and not kept[e]:
            size[part[e]] += len(text)
            links[part[e]] += linked
            some[part[e]] |= bool(ok)
    out = []
    for text, _, linked, e in lines:
        p = part[e]
        if p >= 0 and not kept[e] and (2 * linked < len(text) if p == region else some[p] and 2 * links[p] < size[p]):
            out.append(text)
    return "\n".join(out) or "\n".join(t for t, _, _, e in lines if not kept[e])


def _without_noise(page: Lines, content: np.ndarray) -> list[bool]:
    """Of each element, whether it is noise or lies in noise."""
    n, parents, tags, named = len(page.parents), page.parents, page.tags_of, page.named
    held, count, marks, headed = [0] * n, [0] * n, [0] * n, [False] * n
    for (text, _, _, e), ok in zip(page.lines, content, strict=True):
        marks[e] += tags[e] in ("h1", "article", "main")
        headed[e] |= tags[e] in HEADINGS
        if ok:
            held[e] += len(text)
            count[e] += 1
    for e in range(n - 1, 0, -1):
        p = parents[e]
        held[p] += held[e]
        count[p] += count[e]
        marks[p] += marks[e]
        headed[p] |= headed[e]
    out = [False] * n
    for e in range(1, n):
        p = parents[e]
        if out[p]:
            out[e] = True
        elif named[e]:
            wrapper = 2 * held[e] >= held[0] and (marks[e] > 0 if marks[0] else count[e] >= 3)
            # the title's own box inside a text, not the page's
            title = named[e] == {"header"} and headed[e] and tags[p] not in ("", "html", "body")
            out[e] = "hidden" in named[e] or not (wrapper or title)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row; null html gives empty text; rows are independent, so repeated rows
    stay; other columns are ignored; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url").schema.simpleString()[7:-1]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"{schema},text:string,n_chars:bigint")
