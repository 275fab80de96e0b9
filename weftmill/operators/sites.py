"""Catalogue pages: listings, descriptions, chapter lists and neighbour links, one parse of each page by its site's rules.

Everything is local to a page, so nothing is shuffled; chapter numbers and order are Column expressions on the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numerals as N
from ..functions import text as T
from ..sources import sites as S
from .batches import slices
from .catalog import keep_first, natural_order
from .dom import Nodes, Page, select

ITEM = "title string, url string, author string, description string, latest_chapter string, cover_url string, rating string"
INFO = "title string, author string, description string, cover_url string, status string, rating string, word_count string, categories array<string>, recommendations array<struct<title:string,url:string>>"
KINDS = {
    "search": f"array<struct<{ITEM.replace(' string', ':string')}>>",
    "feed": f"array<struct<{ITEM.replace(' string', ':string')}>>",
    "info": "struct<" + INFO.replace(" string", ":string").replace(" array", ":array") + ">",
    "chapters": "array<struct<title:string,url:string,original_index:int>>",
    "listed": "array<struct<title:string,url:string,original_index:int>>",
    "links": "struct<previous_url:string,next_url:string,directory_url:string,list_pages:array<string>>",
}


def source_of(url: Column, known: tuple[S.Site, ...] = S.SITES) -> Column:
    """The first site whose id or base host is part of the URL's host, else null."""
    out = F.lit(None).cast("string")
    for site in reversed(known):
        h = T.host(url)
        out = F.when(h.contains(site.source) | h.contains(site.base_url.split("/")[2]), F.lit(site.source)).otherwise(out)
    return out


def joined(base: str, href: str) -> str:
    """href against base; as it is where either can't be parsed."""
    try:
        return urljoin(base, href)
    except ValueError:
        return href


class Catalogue:
    """The parts of one page, by its site's rules or, without a site, by the generic ones; links are against the site's or the page's URL."""

    def __init__(self, html: str, url: str, site: S.Site | None):
        self.n = Nodes(Page(html))
        for i, tag in enumerate(self.n.page.tag):
            if tag in ("script", "style", "!"):
                self.n.drop(i)
        self.url, self.site, self.base = url, site, site.base_url if site else url

    def first(self, selector: str, root: int | None = None) -> int | None:
        return next(iter(select(self.n, selector, root)), None) if selector else None

    def text(self, selector: str, root: int | None = None) -> str:
        return "" if (i := self.first(selector, root)) is None else self.n.get_text(i)

    def attr(self, i: int | None, name: str) -> str:
        return "" if i is None else self.n.page.attrs[i].get(name, "")

    def image(self, selector: str, root: int | None = None) -> str:
        i = self.first(selector, root)
        return "" if i is None else joined(self.base, self.attr(i, "src"))

    def listing(self, rules: S.Listing | None) -> list[dict]:
        """Rows of a search or feed page in page order, repeats kept; without rules, links to books by their paths."""
        n, out = self.n, []
        row = dict.fromkeys(x.split()[0] for x in ITEM.split(", "))
        if rules is None:
            for i in select(n, "a[href]"):
                href, title = self.attr(i, "href"), n.get_text(i)
                if any(p in href for p in S.BOOK_PATHS) and 5 < len(title) < 100:
                    out.append({**dict.fromkeys(row, ""), "title": title, "url": joined(self.base, href)})
            return out
        for item in select(n, rules.items):
            cells = select(n, "td", item) if rules.cells else []
            if rules.cells and len(cells) < 3:
                if rules.other and rules.other.items.removeprefix(".") in self.attr(item, "class").split() and (row := self.row(rules.other, item)):
                    out.append(row)
                continue
            if row := self.row(rules, item, cells):
                out.append(row)
        return out

    def row(self, rules: S.Listing, item: int, cells: list[int] | None = None) -> dict | None:
        """One row of a listing; None where it names no book."""
        n, cells = self.n, cells or []
        link = self.first("a", cells[0]) if rules.cells else self.first(rules.title, item)
        if link is None and not rules.cells and rules.least_title > 1:  # rows that name no title: the first link to a book
            link = next((a for a in select(n, "a[href]", item) if any(p in self.attr(a, "href") for p in ("/novels/", "/novel/"))), None)
        if link is None or len(title := n.get_text(link)) < (rules.least_title if rules.least_title > 1 else 0):
            return None
        cell = lambda k: n.get_text(cells[k]) if k < len(cells) else ""
        return dict(
            title=title, url=joined(self.base, self.attr(link, "href")), author=(cell(rules.cells[0]) if rules.cells else self.text(rules.author, item)).replace(S.LABELS["author"], ""),
            description=self.text(rules.description, item), latest_chapter=cell(rules.cells[1]) if rules.cells else self.text(rules.latest, item), cover_url=self.image(rules.cover, item), rating=self.text(rules.rating, item),
        )

    def chapters(self) -> list[dict]:
        """Links of the chapter list, each URL once: its first link counts even where that link's title is too short to be kept."""
        return self.linked(self.site.chapters if self.site else S.GENERIC_CHAPTERS)

    def listed(self) -> list[dict]:
        """The same of a further page of a chapter list."""
        return self.linked(S.LISTED)

    def linked(self, rules: S.Chapters) -> list[dict]:
        seen, out = set(), []
        for k, i in enumerate(select(self.n, rules.links)):
            href = self.attr(i, "href")
            if not href or any(x in href.lower() for x in rules.refused) or (url := joined(self.base, href)) in seen:
                continue
            seen.add(url)
            if len(title := self.n.get_text(i)) >= rules.least_title:
                out.append({"title": title, "url": url, "original_index": k})
        return out

    def info(self) -> dict:
        n, rules = self.n, self.site.info if self.site else S.GENERIC_INFO
        out = {k: self.text(getattr(rules, k)) for k in ("title", "author", "description", "status", "rating", "word_count")}
        out["author"] = out["author"].replace(S.LABELS["author"], "")
        for i in select(n, rules.labelled) if rules.labelled else []:
            for name, label in S.LABELS.items():
                if label in (text := n.get_text(i)):
                    out[name] = text.replace(label, "").strip()
        out["title"] = out["title"] or self.text("h1") or "Unknown Novel"
        return {**out, "cover_url": self.image(rules.cover), "categories": [t for i in select(n, rules.categories) if (t := n.get_text(i))], "recommendations": self.related()}

    def related(self) -> list[dict]:
        """Valid ones of the first RELATED_MOST items of the related section: by class, else what follows its heading, else around it."""
        n, section = self.n, self.first(S.RELATED)
        if section is None:
            for h in select(n, "h2, h3"):
                if any(x in n.get_text(h) for x in S.RELATED_HEADINGS):
                    up = n.page.parent[h]
                    after = [c for c in (n.children(up) if up >= 0 else n.elements()) if c > n.page.last[h] and n.page.tag[c] not in ("", "!")]
                    section = after[0] if after else up if up >= 0 else None
                    break
        out = []
        for item in select(n, S.RELATED_ITEMS, section)[: S.RELATED_MOST] if section is not None else []:
            title, href = self.text(S.RELATED_TITLE, item), self.attr(self.first("a[href]", item), "href")
            if title and href:
                out.append({"title": title, "url": joined(self.base, href)})
        return out

    def links(self) -> dict:
        """The first links to the next and the previous page, to the chapter directory, and the pages of a paginated list without this one."""
        n, out = self.n, {"previous_url": None, "next_url": None, "directory_url": None}
        for i in select(n, "a[href]"):
            href = self.attr(i, "href")
            words = f"{n.get_text(i)} {self.attr(i, 'class')} {self.attr(i, 'id')} {self.attr(i, 'rel')}".lower()
            name = "next_url" if any(x in words for x in S.NEXT) else "previous_url" if any(x in words for x in S.PREVIOUS) else None
            if name and out[name] is None:
                out[name] = joined(self.url, href)
            if out["directory_url"] is None and ("/dir" in href or "/chapters" in href or S.DIRECTORY_LABEL in words):
                out["directory_url"] = joined(self.base, href)
        pages = [joined(self.base, v) for i in select(n, S.LIST_PAGES) if (v := self.attr(i, "value"))]
        return {**out, "list_pages": [p for p in pages if p != self.url]}


def harvest(pages: DataFrame, kinds: list[str], known: tuple[S.Site, ...] = S.SITES, keep: tuple[str, ...] = ()) -> DataFrame:
    """page_id, url, source, the columns `keep` and one column for each of `kinds` (of KINDS) of pages (page_id, url, html), from one parse of each page.

    Null html counts as empty, a null url as an empty one; repeated rows give repeated results; other columns are not looked at.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), source_of(F.col("url").cast("string"), known).alias("source"), *keep, F.col("html").cast("string").alias("html"))
    schema = "page_id long, url string, source string, " + ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep] + [f"{k} {KINDS[k]}" for k in kinds])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out, by_name = to_arrow_schema(StructType.fromDDL(schema)), {s.source: s for s in known}

    def of(page: Catalogue, kind: str):
        if kind in ("search", "feed"):
            return page.listing(getattr(page.site, kind) if page.site else None)
        return getattr(page, kind)()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            found = []
            for html, url, source in zip(*(batch.column(c).to_pylist() for c in ("html", "url", "source"))):
                page = Catalogue(html or "", url or "", by_name.get(source))
                found.append([of(page, k) for k in kinds])
            first = 3 + len(keep)
            columns = [pa.array([f[j] for f in found], out.field(first + j).type) for j in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *columns], schema=out)

    return rows.mapInArrow(run, schema)


def chapter_list(pages: DataFrame, numerals: str = "intended", reverse: bool = False, known: tuple[S.Site, ...] = S.SITES) -> DataFrame:
    """Chapters of each page in natural order: page_id, position (from 1), title, url, number, volume, original_index."""
    each = harvest(pages, ["chapters"], known).select("page_id", F.inline("chapters"))
    n = N.chapter_number(F.col("title"), numerals)
    numbered = each.select("*", n["number"].alias("number"), n["volume"].alias("volume"))
    return natural_order(numbered, "page_id", reverse).select("page_id", "position", "title", "url", "number", "volume", "original_index")


def novel_info(pages: DataFrame, known: tuple[S.Site, ...] = S.SITES) -> DataFrame:
    """Description of each page's book with total_chapters, the number of its different chapter links."""
    return harvest(pages, ["info", "chapters"], known).select("page_id", "url", "source", "info.*", F.size("chapters").alias("total_chapters"))


RECORD = "title url source author description cover_url status rating word_count categories recommendations".split()


def novels(pages: DataFrame, numerals: str = "intended", known: tuple[S.Site, ...] = S.SITES) -> DataFrame:
    """novel, RECORD, chapters (title, url, number, volume, in natural order) and total_chapters of each novel of pages
    (novel, kind, position, page_id, url, html).

    kind 'main' is the novel's own page (the first by position), 'list' a further page of its chapter list, of which the
    first LISTED_MOST count, and 'dir' its directory page. Links of the main page and then of the list pages count once
    each by URL. Where they are fewer than ENOUGH_CHAPTERS and the directory has more, its links take their place. Rows
    of other kinds or without a novel are left out, as are novels without a main page. Repeated pages change nothing.
    """
    c = F.col
    rows = pages.where("novel IS NOT NULL AND kind IN ('main', 'list', 'dir')")
    # ranks of pages, not their html, are shuffled
    turn = F.row_number().over(Window.partitionBy("novel", "kind").orderBy("position", "page_id"))
    ranks = rows.select("novel", "kind", "position", "page_id").distinct().withColumn("turn", turn).where((c("kind") != "list") & (c("turn") == 1) | (c("kind") == "list") & (c("turn") <= S.LISTED_MOST))
    found = harvest(rows, ["info", "chapters", "listed"], known, ("novel", "kind", "position"))
    found = found.join(ranks, ["novel", "kind", "position", "page_id"])
    links = found.select("novel", (c("kind") == "dir").alias("dir"), F.when(c("kind") == "list", c("turn")).otherwise(0).alias("part"), F.posexplode(F.when(c("kind") == "list", c("listed")).otherwise(c("chapters"))).alias("at", "c"))
    links = links.select("novel", "dir", "part", "at", "c.title", "c.url", c("c.original_index").alias("index"))
    once = keep_first(links, ["novel", "dir", "url"], [c("part"), c("at")])
    sizes = once.groupBy("novel").agg(F.count_if(~c("dir")).alias("own"), F.count_if("dir").alias("other"))
    once = once.join(sizes, "novel").where(c("dir") == ((c("own") < S.ENOUGH_CHAPTERS) & (c("other") > c("own"))))
    n = N.chapter_number(c("title"), numerals)
    # what list pages add comes after the main page's links
    placed = F.row_number().over(Window.partitionBy("novel").orderBy("part", "index", "at"))
    ordered = natural_order(once.withColumns({"number": n["number"], "volume": n["volume"], "original_index": placed}), "novel")
    main = found.where("kind = 'main'").groupBy("novel").agg(F.first(F.struct(c("info.title"), "url", "source", *[c(f"info.{x}") for x in RECORD[3:]])).alias("record"))
    lists = ordered.groupBy("novel").agg(F.array_sort(F.collect_list(F.struct("position", "title", "url", "number", "volume"))).alias("chapters"))
    chapters = F.coalesce(F.transform("chapters", lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["number"].alias("number"), x["volume"].alias("volume"))), F.array().cast("array<struct<title:string,url:string,number:double,volume:int>>"))
    return main.join(lists, "novel", "left").select("novel", *[c(f"record.{x}") for x in RECORD], chapters.alias("chapters")).withColumn("total_chapters", F.size("chapters"))


def larger_list(chapters: DataFrame, others: DataFrame, book: str, least: int = 10) -> DataFrame:
    """One list (column chapters) for each book: that of others where the book's own has fewer than `least` and the other has more."""
    other = others.select(F.col(book), F.col("chapters").alias("__other"))
    longer = (F.size("chapters") < least) & (F.coalesce(F.size("__other"), F.lit(-1)) > F.size("chapters"))
    return chapters.join(other, book, "left").withColumn("chapters", F.when(longer, F.col("__other")).otherwise(F.col("chapters"))).drop("__other")
