"""Main text of web pages (operator 1).

The standard library's streaming parser turns a page into lines (blocks of
text) with the number of tags in each.  Elements that are no content by their
name (menus, footers, scripts, forms and so on) are left out, and so are those
that a class or id marks as adverts, comments, notices and the like, but with
care: a mark must be a whole word of the class, beside words that only say
where it stands; a marked element or form that holds most of the page or an
article is not believed; inside an article the weaker marks only count where the
text-to-tag ratio agrees.  The rest is judged by text-to-tag ratio: ratios are
smoothed by a Gaussian along the page and clustered against a threshold, and
regions that reach it are the content.  A region is an article or main element
where the page has one, else a run of lines around those that reach the
threshold, with headings and paragraphs without links that adjoin it.

Defined cases: null or empty html gives an empty text; a page of any length is
parsed whole, in time linear in its length however malformed it is; a tag or
comment that never ends goes to the end of the page, as in browsers; repeated rows
are extracted alike; null ids and addresses are kept; other columns of the input
are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

#: Fixed lists of element names.
SKIPPED = frozenset("script style noscript template head title nav footer aside form select button textarea iframe object svg math canvas menu dialog datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside menu dialog".split()
)
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed words of classes and ids: those that mark an element as no content anywhere, those that do so outside articles, and those that only say where it stands.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsored sidebar nav navbar navigation navmenu breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe "
    "subscription signup login comment comments commentlist reply replies respond disqus share sharing pagination pager".split()
)
WEAK = frozenset("banner promo promotion menu footer masthead notice notices notification alert overlay social related recommended recommendations widget toolbar copyright legal disclaimer skip".split())
PLACES = frozenset(
    "site page top bottom left right main global header head foot bar box block wrap wrapper container section area inner outer panel list item items link links form content text body button buttons icon icons "
    "post posts article articles story stories message messages mobile desktop sticky fixed slot unit google primary secondary js the and to".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
HEADERS = frozenset("site page top main global".split())
PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
SHOWN, UNLIKELY, SOFT, HARD = range(4)


class Block(NamedTuple):
    """A line of the page; region numbers the outermost article or main element, 0 outside; links is the text within links."""

    text: str
    tags: int
    region: int
    tag: str = ""
    links: int = 0
    marked: bool = False


def class_mark(value: str) -> int:
    """What a class or id says: each of its words may be made of parts, all of which must be marks or places, and one a mark."""
    found = SHOWN
    for word in value.split():
        parts = {p.lower() for p in PARTS.split(word) if p}
        if parts <= STRONG | WEAK | PLACES:
            found = max(found, SOFT if parts & STRONG else UNLIKELY if parts & WEAK else SHOWN)
            if "header" in parts and parts & HEADERS and len(parts) == 2:
                found = max(found, UNLIKELY)
    return found


def verdict(tag: str, attrs: list[tuple[str, str | None]], in_content: bool) -> int:
    """How far an element is no content: HARD by its name or style, SOFT if most text in it would say otherwise, UNLIKELY if ratios decide in articles."""
    if tag == "form":
        return SOFT
    if tag in SKIPPED or tag == "header" and not in_content:
        return HARD
    found = SHOWN
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and HIDDEN.search(value):
            return HARD
        if name == "role" and value and value.lower() in ROLES and tag not in CONTENT:
            found = SOFT
        if name in ("class", "id") and value and tag not in ("html", "body", "main"):
            found = max(found, class_mark(value))
    return found


class BlockParser(HTMLParser):
    """Collects a page's blocks.  ``trusted`` numbers elements, in page order, whose marks are not believed."""

    def __init__(self, trusted: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.trusted = trusted
        self.stack: list[tuple[str, int, int, int]] = []  # name, verdict, number, what was softly hidden before
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by name
        self.blocks_at, self.contents_at, self.hidden_at = [-1], [-1], [-1]
        self.hard = self.soft = self.unlikely = self.regions = self.tags = self.seen = self.links = 0
        self.text: list[str] = []
        self.marked = False
        self.blocks: list[Block] = []
        self.lost: defaultdict[int, int] = defaultdict(int)  # text that an element hides, by its number
        self.softly: list[int] = []

    # Without an end these go to the end of the page.
    def parse_comment(self, i: int, report: bool = True) -> int:
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        return self.after("-->", i + 4)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.after(">", i + 2)

    def parse_pi(self, i: int) -> int:
        return self.after(">", i + 2)

    def parse_bogus_comment(self, i: int, report: bool = True) -> int:
        return self.after(">", i + 2)

    def after(self, mark: str, i: int) -> int:
        at = self.rawdata.find(mark, i)
        return len(self.rawdata) if at < 0 else at + len(mark)

    def end_block(self) -> None:
        if self.text:
            if words := SPACE.sub(" ", "".join(self.text)).strip():
                inside = self.blocks_at[-1]
                region = self.regions if len(self.contents_at) > 1 else 0
                self.blocks.append(Block(words, self.tags, region, self.stack[inside][0] if inside >= 0 else "", self.links, self.marked))
            self.text.clear()
        self.tags = self.links = 0
        self.marked = self.unlikely > 0

    def pop(self) -> None:
        name, level, number, before = self.stack[-1]
        if name in BLOCK:
            self.end_block()
        self.stack.pop()
        at = len(self.stack)
        self.places[name].pop()
        for kind in (self.blocks_at, self.contents_at, self.hidden_at):
            if kind[-1] == at:
                kind.pop()
        self.hard -= level == HARD
        if level == SOFT:
            self.soft -= 1
            self.softly.pop()
        self.unlikely -= level == UNLIKELY
        if before >= 0:
            self.soft = before
        self.marked = self.unlikely > 0 if not self.text else self.marked

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag == "body" and self.places["head"]:
            self.handle_endtag("head")
        if tag in VOID:
            if tag == "hr":
                self.end_block()
            self.tags += 1
            return
        if tag in BLOCK:
            # An open paragraph ends here, whatever inline elements were left open in it.
            p = self.places["p"][-1:]
            if p and p[0] == self.blocks_at[-1] and self.hidden_at[-1] <= p[0]:
                while len(self.stack) > p[0]:
                    self.pop()
            if tag in ("li", "td", "th", "tr", "dt", "dd") and self.stack and self.stack[-1][0] == tag:
                self.pop()
            self.end_block()
        inside = len(self.contents_at) > 1
        level, self.seen = verdict(tag, attrs, inside), self.seen + 1
        if level == UNLIKELY and not inside:
            level = SOFT
        if level == SOFT and self.seen in self.trusted:
            level = SHOWN
        opened, before, at = tag in CONTENT and not self.hard and level < SOFT, -1, len(self.stack)
        if opened:
            if not inside:
                self.regions += 1
            # A mark around an article is not believed.
            before, self.soft = self.soft, 0
            self.contents_at.append(at)
        self.hard += level == HARD
        if level == SOFT:
            self.soft += 1
            self.softly.append(self.seen)
        self.unlikely += level == UNLIKELY
        self.marked |= level == UNLIKELY
        if tag in BLOCK:
            self.blocks_at.append(at)
        if level >= SOFT:
            self.hidden_at.append(at)
        self.places[tag].append(at)
        self.stack.append((tag, level, self.seen, before))
        self.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # "<div/>" opens an element in HTML, but inside pictures and formulas it doesn't.
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        # An end tag does not reach out of the article, and an inline one not out of its block.
        wall = -1 if tag in ("body", "html") else self.contents_at[-1] if tag in BLOCK or tag in SKIPPED else max(self.contents_at[-1], self.blocks_at[-1])
        at = self.places[tag][-1:]
        if at and at[0] >= wall:
            while len(self.stack) > at[0]:
                self.pop()
        elif tag == "p" and not self.hard and not self.soft:
            self.end_block()
        self.tags += 1

    def handle_data(self, data: str) -> None:
        if self.hard:
            return
        if self.soft:
            size = len(data.strip())
            for number in self.softly[-self.soft :]:
                self.lost[number] += size
            return
        self.text.append(data)
        if self.places["a"]:
            self.links += len(data)

    def finish(self) -> list[Block]:
        self.close()
        while self.stack:
            self.pop()
        self.end_block()
        return self.blocks


def blocks_of(html: str, most: float = 0.75) -> list[Block]:
    """The page's blocks, with those inside marked elements that hold more than ``most`` of the page, or all of it."""
    # A tag that never ends is none.
    tail = html.rfind(">") + 1
    if (open_ := re.search(r"<[A-Za-z/!?]", html[tail:])) and not html.startswith("<!--", tail + open_.start()):
        html = html[: tail + open_.start()]
    trusted: frozenset[int] = frozenset()
    while True:
        parser = BlockParser(trusted)
        parser.feed(html)
        blocks = parser.finish()
        shown = sum(len(b.text) for b in blocks)
        widest = max(parser.lost.values(), default=0)
        wide = [k for k, n in parser.lost.items() if n > most * (shown + widest)]
        if not wide or len(trusted) >= 8 or parser.regions and shown:
            return blocks
        trusted |= frozenset(wide)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian; the edges are weighted by what lies inside."""
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / inside


def choose(blocks: list[Block], sigma: float = 1.0, share: float = 0.5) -> list[str]:
    """The content blocks.  The threshold is ``share`` standard deviations of the smoothed ratios, and it never exceeds their maximum."""
    blocks = [Block(*b) for b in blocks]
    if not blocks:
        return []
    ratio = np.array([len(b.text) / max(1, b.tags) for b in blocks])
    level = smooth(ratio, sigma)
    threshold = min(share * float(level.std()), float(level.max()))
    regions, marked = np.array([b.region for b in blocks]), np.array([b.marked for b in blocks])
    if regions.any():
        # An article is content as a whole; of several, those whose peak reaches the threshold.
        good = [r for r in np.unique(regions[regions > 0]) if level[regions == r].max() >= threshold]
        chosen = np.isin(regions, good) if good else regions > 0
        if (chosen & ~marked).any():
            # Marks in an article count where the lines have less text a tag than its others.
            chosen &= ~marked | (ratio >= float(np.median(ratio[chosen & ~marked])))
        return [b.text for b, c in zip(blocks, chosen, strict=True) if c]
    # Smoothing also lifts the lines next to a region; those of almost nothing but tags are no part of it.
    high = np.flatnonzero((level >= threshold) & (ratio >= 0.1 * threshold))
    if not len(high):
        high = np.flatnonzero(level >= threshold)
    first, last = int(high[0]), int(high[-1])
    adjoins = [b.tag in HEADINGS or b.tag == "p" and 4 * b.links < len(b.text) for b in blocks]
    while first and adjoins[first - 1]:
        first -= 1
    while last + 1 < len(blocks) and adjoins[last + 1] and blocks[last + 1].tag == "p":
        last += 1
    return [b.text for b in blocks[first : last + 1]]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.5) -> str:
    return "\n\n".join(choose(blocks_of(html), sigma, share)) if html else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """The columns ``keep``, then text and n_chars; one row per page, without a shuffle."""
    chosen = pages.select(*keep, F.col(html).cast("string").alias("html__"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                texts = [main_text(x.as_py(), sigma, share) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"]
                )

    return chosen.mapInArrow(tidy(run), f"{kinds}, text string, n_chars bigint")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
