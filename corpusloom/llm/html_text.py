"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser hands over tags and text as it reads. Text is gathered into
lines, one for each block of the page, with the number of tags it took. Blocks inside elements that
never hold an article (scripts, menus, forms) are left out as they come. Elements whose class or id
names an advert, a notice, comments and the like are left out too, but not one that holds most of
the page's text or its article, nor headings, paragraphs and dense sections of an article for the sake of their id
(see ``unmuted``). Over the lines that remain, the ratio of
text to tags is smoothed with a Gaussian; one-dimensional two-means finds the level that parts
text from the rest. The content region is the ``article`` or ``main`` elements that hold lines
above that level, or, on a page without them, the innermost element around all lines above
it. Every line of the region is kept, short ones too; on a page without such an
element, lines outside all regions of text are not.

Defined cases: null html is empty; a page without text gives the empty string; markup that
never ends is read to its end; unknown and unclosed tags are fine, an open ``head`` ends where the body begins. Rows are independent of
each other, so repeated rows and null ids need no care. Columns other than those named are passed
on; one named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.5
FEED = 1 << 16

# Element names by their part in a page, and words that name what is no article.
SILENT = set("script style noscript template head svg math iframe object embed canvas audio video select textarea button datalist".split())
ASIDE = set("nav footer aside form menu dialog search".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "caption", "option", "optgroup", "legend", "summary", "figcaption"}
REGION = ("article", "main")
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner banners cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription "
    "signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar toolbar "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations "
    "widget widgets pagination pager skip tags".split()
)
PAGE_HEADER = set("header topbar masthead".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Words that also name what an article speaks of.
DOUBTFUL = set("alert discussion navigation notice notices related reply replies respond share sharing skip social subscription tags".split())
# Never an article; a listed class or id; one that only contains a listed word; inside an article or main, an id or a doubtful name.
HARD, NAMED, PART, WEAK = 4, 3, 2, 1

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Lines(HTMLParser):
    """Collects ``text, tags, path, marks`` for each block.

    ``path`` numbers the open sections, ``marks`` the open elements muted by their name.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...], tuple[int, ...]]] = []
        self.kinds: dict[int, str] = {}
        self.open: list[tuple[str, int, int]] = []  # name, section number or -1, how it silences or 0
        self.path: list[int] = []
        self.muted = 0
        self.marks: tuple[int, ...] = ()
        self.strength: list[int] = []
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0
        self.sections = 0

    def flush(self) -> None:
        if self.parts:
            found = []
            for marks in sorted({m for _, m in self.parts}, key=len, reverse=True):
                text = _SPACE.sub(" ", "".join(t for t, m in self.parts if m == marks)).strip()
                if text:
                    found.append((text, marks))
            for k, (text, marks) in enumerate(found):
                # the line with the fewest marks takes the tags
                self.lines.append((text, self.tags if k == len(found) - 1 else 0, tuple(self.path), marks))
            if found:
                self.tags = 0
            self.parts = []

    def _mutes(self, tag: str, attrs) -> int:
        if tag in SILENT or tag in ASIDE:
            return HARD
        inside = any(self.kinds[s] in REGION for s in self.path)
        if tag == "header" and not inside:
            return HARD
        if tag in ("html", "body", *REGION):
            return 0
        found = 0
        running = tag == "p" or tag in HEADINGS
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return HARD
            if name == "role" and (value or "").lower() in ROLES:
                return HARD
            if name in ("class", "id") and value and not (running and (inside or name == "id")):
                listed = MARKS if inside else MARKS | PAGE_HEADER
                whole = {w.lower() for w in value.split()} & listed
                part = {w.lower() for w in _TOKEN.split(value)} & listed
                if not part and not whole:
                    continue
                if inside and (name == "id" or not whole - DOUBTFUL):
                    found = max(found, WEAK)
                else:
                    found = max(found, NAMED if whole else PART)
        return found

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "body" or tag not in IN_HEAD and self._in_head():
            self._close("head")
        if tag == "p" or tag in CLOSES_P:
            self._close("p", only_if_near=True)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, only_if_near=True)
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append((" ", self.marks))
        if tag in VOID:
            return
        mutes = 0 if self.muted else self._mutes(tag, attrs)
        section = -1
        if mutes == HARD:
            self.muted = len(self.open) + 1
        elif mutes:
            self.marks += (len(self.strength),)
            self.strength.append(mutes)
        if tag in BLOCK and tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd"):
            self.sections += 1
            section = self.sections
            self.kinds[section] = tag
            self.path.append(section)
        self.open.append((tag, section, mutes))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def _close(self, tag: str, only_if_near: bool = False) -> None:
        for back in range(len(self.open) - 1, -1, -1):
            name = self.open[back][0]
            if name == tag:
                break
            if only_if_near and name in BLOCK:
                return
        else:
            return
        self.flush()
        for _, section, mutes in reversed(self.open[back:]):
            if section >= 0:
                self.path.pop()
            self._unmute(mutes)
        del self.open[back:]

    def _unmute(self, mutes: int) -> None:
        if mutes == HARD:
            self.muted = 0
        elif mutes:
            self.marks = self.marks[:-1]

    def _in_head(self) -> bool:
        return bool(self.open) and self.open[-1][0] == "head"

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", self.marks))
            return
        if tag not in BLOCK:
            # an inline end tag closes nothing beyond its block
            self._close_inline(tag)
        else:
            self._close(tag)

    def _close_inline(self, tag: str) -> None:
        for back in range(len(self.open) - 1, -1, -1):
            name, _, mutes = self.open[back]
            if name == tag:
                if mutes:
                    for _, _, inner in reversed(self.open[back:]):
                        self._unmute(inner)
                    del self.open[back:]
                else:
                    del self.open[back]
                return
            if name in BLOCK:
                return

    def handle_data(self, data):
        if self.muted and self._in_head() and data.strip():
            self._close("head")
        if not self.muted:
            self.parts.append((data, self.marks))


def smooth(values: np.ndarray) -> np.ndarray:
    """Gaussian smoothing with mirrored ends."""
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    padded = np.pad(values, reach, mode="symmetric") if len(values) else values
    return np.convolve(padded, kernel / kernel.sum(), mode="valid") if len(values) else values


def threshold(values: np.ndarray) -> float:
    """Where two-means parts low from high values; all are high if there is no second level."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return low
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            break
        now = (below.mean(), above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _dense(lines) -> tuple[np.ndarray, np.ndarray, float]:
    """Size of each line, whether its ratio of text to tags is of the upper level, and where that begins."""
    ratio = smooth(np.array([len(line[0]) / max(1, line[1]) for line in lines]))
    cut = threshold(ratio)
    return np.array([len(line[0]) for line in lines]), ratio >= cut, cut


def unmuted(parser: Lines) -> list[tuple[str, int, tuple[int, ...]]]:
    """The lines without those of elements that stay muted by their class or id.

    An element whose name only contains a listed word is heard if it holds most of the dense text,
    or an article or main with at least the text of those outside such elements. One that is
    named by a listed word is heard on the same terms if the page has no article or main outside.
    Inside an article or main, an id or a doubtful name silences only elements whose own ratio of text to
    tags is of the lower level.
    """
    lines = parser.lines
    heard: set[int] = set()
    if any(marks for *_, marks in lines):
        size, dense, cut = _dense(lines)
        weight = (size * dense).tolist()
        region = [any(parser.kinds[s] in REGION for s in path) for _, _, path, _ in lines]
        bare = [w for w, r, line in zip(weight, region, lines, strict=True) if r and not line[3]]
        held: dict[int, list[int]] = {}
        above: dict[int, int] = {}
        for (text, tags, _, marks), w, r in zip(lines, weight, region, strict=True):
            for outer, inner in zip((-1, *marks), marks, strict=False):
                above[inner] = outer
                held.setdefault(inner, [0, 0, 0, 0])
            if marks:
                for k, amount in enumerate((w, w * r, len(text), tags)):
                    held[marks[-1]][k] += amount
        for mark in sorted(held, reverse=True):
            whole, article, text_size, tag_count = held[mark]
            strength = parser.strength[mark]
            most = whole * 2 > sum(weight) or article and article >= sum(bare)
            if strength == WEAK and text_size >= cut * max(1, tag_count) or (strength <= PART or not bare) and most:
                heard.add(mark)
                if above[mark] >= 0:
                    for k in range(4):
                        held[above[mark]][k] += held[mark][k]
    out, tags = [], 0
    for text, n, path, marks in lines:
        tags += n
        if heard.issuperset(marks):
            out.append((text, tags, path))
            tags = 0
    return out


def main_text(html: str) -> str:
    """The article's blocks, joined by line feeds."""
    parser = Lines()
    for lo in range(0, len(html), FEED):
        parser.feed(html[lo : lo + FEED])
    parser.close()
    parser.flush()
    lines = unmuted(parser)
    if not lines:
        return ""
    dense = _dense(lines)[1]
    wanted = [[s for s in p if parser.kinds[s] in REGION] for _, _, p in lines]
    if any(wanted):
        # outermost article or main elements with dense lines
        outer = [w[0] if w else 0 for w in wanted]
        regions = {o for o, d in zip(outer, dense, strict=True) if o and d} or {o for o in outer if o}
        keep = [o in regions for o in outer]
    else:
        # the innermost section around all dense lines
        around = commonprefix([path for d, (_, _, path) in zip(dense, lines, strict=True) if d])
        keep = [path[: len(around)] == around for _, _, path in lines]
    return "\n".join(t for (t, _, _), k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col`` in place of ``html_col``."""
    rest = [c for c in pages.columns if c not in (html_col, text_col)]

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.fillna("").map(main_text)

    return pages.select(*rest, read(F.col(html_col)).alias(text_col))


def op4_text_tag_ratio(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
