"""Main text of HTML pages by two-pass block rules.

Blocks in menus, headers, footers, sidebars, notices, adverts, forms or reader comments are no part of the text by the
elements around them, and decide nothing about others. Pass one decides the other blocks from their words and links:
blocks of link text alone that no article or main element holds are out; long blocks of few links are in, where they have
enough stop words, or where the page as a whole has too few for any of the known languages; the rest stays open. Pass two
gives an open block the label of its nearest decided neighbour, under an article or main element of those that the same
element holds; a heading takes that of the block it stands before. Where nothing is in, open blocks are.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dom import LenientParser
from .common import arrow_schema, slices

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were what which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sur un une vous "
    "als am auch auf aus bei bin da das dem den der die du ein eine einen er es für hat ich ihr im ist mit nach nicht noch sich sie sind so und von vor war wie wir zu zum zur "
    "al como con cuando del el ella era es esta este esto ha hay lo los las me mi muy más no nos para pero por sin sobre su sus también te tu una uno y ya".split()
)
# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg iframe canvas audio video select textarea button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset("nav footer aside form menu dialog fieldset search".split())
# Words in class, id and role that mark boilerplate, and those that mark the article's own parts.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies copyright disqus footer gdpr header legal masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promotion recommendations recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
OWN_WORDS = frozenset("article body content entry main page post story text wrapper".split())
STRONG_WORDS = CHROME_WORDS - frozenset("header page search notice related legal".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Share of links from which a block is mostly links; characters of a long block, where one of a script without spaces counts WIDE; share of stop words of a long block, and of a page in a known language.
LINK_DENSITY, LONG, WIDE, STOP_DENSITY = 0.5, 60, 3, 0.08
_WORDS = re.compile(r"[^\W\d_]+")
_NAMES = re.compile(r"[a-z0-9]+")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")


def _boilerplate(tag: str, attrs: dict[str, str | None], in_article: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (attrs.get("style") or "").lower()):
        return True
    names = set(_NAMES.findall(" ".join(attrs.get(k) or "" for k in ("class", "id", "role")).lower()))
    if tag in ("html", "body") or not names:
        return False
    return bool(names & (STRONG_WORDS if names & OWN_WORDS or in_article else CHROME_WORDS))


class Block(NamedTuple):
    """text; characters within links; letters and digits outside of them; whether it is boilerplate; number of the article or main element around it, else 0; whether it is a heading."""

    text: str
    linked: int
    plain: int
    chrome: bool
    container: int
    heading: bool


class Blocks(LenientParser):
    """Collects the blocks in page order.

    A block ends where a block element begins or ends. An end tag closes up to its own start tag and is ignored without
    one; inline elements other than links leave no mark; the page's end closes everything.
    """

    def __init__(self):
        super().__init__()
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # tag, boilerplate, container, within an article
        self.parts: list[str] = []
        self.linked, self.plain, self.links, self.silent, self.containers = 0, 0, 0, [], 0

    def _state(self) -> tuple[str, bool, int, bool]:
        return self.open[-1] if self.open else ("", False, 0, False)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tag, chrome, container, _ = self._state()
            self.blocks.append(Block(text, self.linked, self.plain, chrome, container, tag in HEADINGS))
        self.parts, self.linked, self.plain = [], 0, 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body":
            self.silent = []
        if tag in SILENT:
            if tag in ("select", "textarea", "button", "head", "title") or not self.silent:
                self.silent.append(tag)
            return
        if tag == "a":
            self.links += 1
        elif tag == "br":
            self.parts.append("\n")
        elif tag in BLOCK:
            self._flush()
            self.links = 0
            if tag == "p" and self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag in VOID:
                return
            _, chrome, container, article = self._state()
            own = _boilerplate(tag, dict(attrs), article)
            if tag in ("article", "main") and not own:
                self.containers += 1
                chrome, container, article = False, self.containers, True
            self.open.append((tag, chrome or own, container, article))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID or tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in BLOCK and any(x[0] == tag for x in self.open):
            self._flush()
            self.links = 0
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.parts.append(data)
        if self.links:
            self.linked += len("".join(data.split()))
        else:
            self.plain += sum(map(str.isalnum, data))

    def close(self) -> None:
        super().close()
        self._flush()


def _stops(text: str) -> tuple[int, int]:
    """(stop words, words)"""
    words = _WORDS.findall(text.lower())
    return sum(map(STOP_WORDS.__contains__, words)), len(words)


def decide(blocks: list[Block]) -> list[bool | None]:
    """Pass one: in, out or open, from each block's own words and links. Boilerplate is not among the blocks."""
    counts = [_stops(b.text) for b in blocks]
    known = sum(c[0] for c in counts) >= STOP_DENSITY * sum(c[1] for c in counts)

    def label(b: Block, stops: int, words: int) -> bool | None:
        if b.linked > LINK_DENSITY * (len(b.text) - b.text.count(" ")):
            return None if b.container or b.plain else False
        long = len(b.text) >= LONG or len(b.text) + (WIDE - 1) * len(_WIDE.findall(b.text)) >= LONG
        return True if long and (not known or stops >= STOP_DENSITY * max(words, 1)) else None

    return [label(b, *c) for b, c in zip(blocks, counts)]


def inherit(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Pass two: the labels with open blocks' own. Of two neighbours equally near one that is in suffices."""
    decided = [i for i, x in enumerate(labels) if x is not None]
    if not any(labels[i] for i in decided):
        return [x is not False for x in labels]
    by_container: dict[int, list[int]] = {}
    for i in decided:
        by_container.setdefault(blocks[i].container, []).append(i)
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels)):
        if label is None:
            # under an article its own blocks decide, and without any decided one its place there does
            near = by_container.get(block.container, []) if block.container else decided
            at = bisect_left(near, i)
            sides = near[at : at + 1] if block.heading and at < len(near) else near[max(0, at - 1) : at + 1]
            least = min((abs(j - i) for j in sides), default=0)
            label = not sides or any(labels[j] for j in sides if abs(j - i) == least)
        out.append(label)
    return out


def main_text(html: str | None) -> str:
    """The page's main text: kept blocks in page order, white space within each as single spaces, joined by line feeds."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    blocks = [b for b in parser.blocks if not b.chrome]
    return "\n".join(b.text for b, kept in zip(blocks, inherit(blocks, decide(blocks))) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    Null and empty html give the empty text. Rows are independent: repeated rows give repeated results; other columns are
    not looked at; an empty table gives an empty result; whole pages are read, however long.
    """
    schema = "page_id long, url string, text string, n_chars long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)
