"""Queries of catalogue pages made from `part`: its rows are books of listings and chapters of novels, said in each site's markup, and the same in SQL from the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sites

HOSTS = {"ixdzs8": "https://ixdzs8.com", "xbiquge": "https://www.xbiquge.info", "biquge_company": "https://www.biquge.company", "ttkan": "https://www.ttkan.co", "shuhaige": "https://m.shuhaige.net", "": "https://other.example"}
#: A book's markup in each site's listings; $ marks stand for columns of part.
ROWS = {
    "ixdzs8": '<li><h3><a href="/read/$key/">$name</a></h3><span class="author">作者：$brand</span><p class="desc">$type</p><i class="latest-chapter">Ch $size</i><div class="cover"><img src="/i/$key.jpg"></div><b class="score">$size</b></li>',
    "xbiquge": '<tr><td><img src="/c/$key.jpg"><a href="../book/$key/">$name</a></td><td>$brand</td><td>x</td><td>Ch $size</td></tr>',
    "xbiquge old": '<div class="bookbox"><h4 class="bookname"><a href="/old/$key">$name</a></h4><div class="author">作者：$brand</div><div class="cat">to <a href="/l">Ch $size</a></div></div>',
    "biquge_company": '<div class="bookbox"><h4 class="bookname"><a href="/$key/">$name</a></h4><div class="author">作者：$brand</div><div class="cat"><a>Ch $size</a></div><div class="update">$type</div></div>',
    "ttkan": '<div class="novel_cell"><a href="/novel/$key">$name</a><span class="author">$brand</span><p class="rating">$size</p></div>',
    "shuhaige": '<li><p class="bookname"><a href="/b/$key">$name</a></p><p class="data"><a>$brand</a> <a>x</a> <a>Ch $size</a></p></li>',
    "": '<p><a href="/book/$key">$name</a> <a href="/book/x">x</a> <a href="/other/$key">$name</a></p>',
}
AROUND = {"ixdzs8": ('<ul class="u-list">', "</ul>"), "xbiquge": ('<table id="maincontent">', "</table>"), "shuhaige": ('<ul class="list">', "</ul>")}
PER_PAGE = 10


def _said(markup: str) -> Column:
    out = F.lit(markup)
    for name, column in (("key", F.col("p_partkey").cast("string")), ("name", F.col("p_name")), ("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string"))):
        out = F.replace(out, F.lit("$" + name), column)
    return out


def _listings(spark, sf_dir) -> DataFrame:
    """Pages of ten rows of part each, in turn of the sites."""
    part, names = spark.read.parquet(f"{sf_dir}/part.parquet"), list(HOSTS)
    page = F.floor(F.col("p_partkey") / PER_PAGE)
    site = F.element_at(F.array(*map(F.lit, names)), (page % len(names) + 1).cast("int"))
    row = F.lit("")
    for name in names:
        new = _said(ROWS[name])
        if name == "xbiquge":  # every other page in the old layout
            new = F.when(F.floor(page / len(names)) % 2 == 0, new).otherwise(_said(ROWS["xbiquge old"]))
        row = F.when(site == name, new).otherwise(row)
    rows = part.select(page.alias("page_id"), site.alias("site"), "p_partkey", row.alias("row"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "row"))), lambda x: x["row"]), "\n")
    pages = rows.groupBy("page_id", "site").agg(html.alias("html"))
    first, last, host = F.lit(""), F.lit(""), F.lit(HOSTS[""])
    for name in names:
        first = F.when(F.col("site") == name, AROUND.get(name, ("", ""))[0]).otherwise(first)
        last = F.when(F.col("site") == name, AROUND.get(name, ("", ""))[1]).otherwise(last)
        host = F.when(F.col("site") == name, HOSTS[name]).otherwise(host)
    return pages.select("page_id", F.concat(host, F.lit("/list/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit("<html><body>"), first, F.col("html"), last).alias("html"))


def listed_books(spark, sf_dir):
    return sites.harvest(_listings(spark, sf_dir), ["search"]).select("page_id", "source", F.inline("search"))


def fed_books(spark, sf_dir):
    return sites.harvest(_listings(spark, sf_dir), ["feed"]).select("page_id", "source", F.inline("feed"))


def _novel_pages(spark, sf_dir) -> DataFrame:
    """A novel for each brand: some parts are links of its page, others of its further list pages or its directory; two parts in turn share a URL."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.pmod("p_partkey", F.lit(16))
    few = F.pmod(F.substring("p_brand", 7, 2).cast("int"), F.lit(2)) == 0  # such novels link little on their page
    kind = F.when(few & (k == 0) | ~few & (k < 6), "main").when(k < 14, "list").otherwise("dir")
    position = F.when(kind == "list", k).otherwise(0).cast("int")
    title = F.when(F.pmod("p_partkey", F.lit(5)) == 0, F.col("p_name")).otherwise(F.concat(F.lit("第"), F.col("p_size").cast("string"), F.lit("章 "), "p_name"))
    link = F.concat(F.lit('<li><a href="/c/'), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit('">'), title, F.lit("</a></li>"))
    rows = part.select(F.col("p_brand").alias("novel"), kind.alias("kind"), position.alias("position"), "p_partkey", link.alias("link"))
    pages = rows.groupBy("novel", "kind", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "link"))), lambda x: x["link"]), "").alias("links"), F.min("p_partkey").alias("page_id"))
    # every novel has a page of its own, with links or without
    empty = part.select(F.col("p_brand").alias("novel"), F.lit("main").alias("kind"), F.lit(0).alias("position")).distinct().select("novel", "kind", "position", F.lit("").alias("links"), F.lit(-1).cast("long").alias("page_id"))
    pages = pages.unionByName(empty).groupBy("novel", "kind", "position").agg(F.max("links").alias("links"), F.max("page_id").alias("page_id"))
    head = F.concat(F.lit('<h1 class="book-title">Book of '), "novel", F.lit('</h1><p class="author">作者：A. Writer</p><p class="intro">About it</p><div class="category"><a>One</a><a>Two</a></div><div class="similar-books"><li><h3><a href="/b/1">Like it</a></h3></li></div>'))
    html = F.when(F.col("kind") == "main", F.concat(head, F.lit('<div class="chapter-list">'), "links", F.lit("</div>"))).when(F.col("kind") == "list", F.concat(F.lit('<div class="read">'), "links", F.lit("</div>"))).otherwise(F.concat(F.lit('<div class="chapter-list">'), "links", F.lit("</div>")))
    return pages.select("novel", "kind", "position", "page_id", F.concat(F.lit("https://m.shuhaige.net/"), F.col("kind"), F.lit("/"), F.col("position").cast("string")).alias("url"), html.alias("html"))


def novel_records(spark, sf_dir):
    found = sites.novels(_novel_pages(spark, sf_dir))
    chapters = F.array_join(F.transform("chapters", lambda c: F.concat_ws(" ", c["number"].cast("int").cast("string"), c["url"], c["title"])), "\n")
    return found.select("novel", "title", "author", "source", "description", F.array_join("categories", ",").alias("categories"), F.col("recommendations")[0]["url"].alias("like_it"), chapters.alias("chapters"), "total_chapters")


QUERIES = [listed_books, fed_books, novel_records]

_SITE = "[" + ", ".join(f"'{x}'" for x in HOSTS) + f"][(p_partkey // {PER_PAGE}) % {len(HOSTS)} + 1]"
_BOOKS = f"books AS (SELECT *, p_partkey // {PER_PAGE} AS page_id, {_SITE} AS site, (p_partkey // {PER_PAGE} // {len(HOSTS)}) % 2 = 1 AS old FROM part)"
SQL = {
    "listed_books": f"""WITH {_BOOKS} SELECT page_id, nullif(site, '') AS source, p_name AS title,
        CASE site WHEN 'ixdzs8' THEN '{HOSTS["ixdzs8"]}/read/' || p_partkey || '/' WHEN 'xbiquge' THEN '{HOSTS["xbiquge"]}' || CASE WHEN old THEN '/old/' || p_partkey ELSE '/book/' || p_partkey || '/' END WHEN 'biquge_company' THEN '{HOSTS["biquge_company"]}/' || p_partkey || '/'
            WHEN 'ttkan' THEN '{HOSTS["ttkan"]}/novel/' || p_partkey WHEN 'shuhaige' THEN '{HOSTS["shuhaige"]}/b/' || p_partkey ELSE '{HOSTS[""]}/book/' || p_partkey END AS url,
        CASE WHEN site = '' THEN '' ELSE p_brand END AS author, CASE WHEN site IN ('ixdzs8', 'biquge_company') THEN p_type ELSE '' END AS description,
        CASE WHEN site IN ('ttkan', '') THEN '' ELSE 'Ch ' || p_size END AS latest_chapter,
        CASE WHEN site = 'ixdzs8' THEN '{HOSTS["ixdzs8"]}/i/' || p_partkey || '.jpg' WHEN site = 'xbiquge' AND NOT old THEN '{HOSTS["xbiquge"]}/c/' || p_partkey || '.jpg' ELSE '' END AS cover_url,
        CASE WHEN site IN ('ixdzs8', 'ttkan') THEN p_size::VARCHAR ELSE '' END AS rating FROM books WHERE site <> '' OR length(p_name) BETWEEN 6 AND 99""",
    "fed_books": f"""WITH {_BOOKS} SELECT page_id, nullif(site, '') AS source, p_name AS title,
        CASE site WHEN 'ixdzs8' THEN '{HOSTS["ixdzs8"]}/read/' || p_partkey || '/' WHEN 'xbiquge' THEN '{HOSTS["xbiquge"]}/book/' || p_partkey || '/' ELSE '{HOSTS[""]}/book/' || p_partkey END AS url,
        CASE WHEN site = '' THEN '' ELSE p_brand END AS author, CASE WHEN site = 'ixdzs8' THEN p_type ELSE '' END AS description, '' AS latest_chapter,
        CASE WHEN site = 'ixdzs8' THEN '{HOSTS["ixdzs8"]}/i/' || p_partkey || '.jpg' WHEN site = 'xbiquge' THEN '{HOSTS["xbiquge"]}/c/' || p_partkey || '.jpg' ELSE '' END AS cover_url, CASE WHEN site = 'ixdzs8' THEN p_size::VARCHAR ELSE '' END AS rating
        FROM books WHERE site = 'ixdzs8' OR site = 'xbiquge' AND NOT old OR site = '' AND length(p_name) BETWEEN 6 AND 99""",
    "novel_records": """
        WITH links AS (SELECT p_brand AS novel, p_partkey, p_partkey % 16 AS k, substr(p_brand, 7, 2)::INT % 2 = 0 AS few, '/c/' || p_partkey // 2 AS href, p_size,
                CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE '第' || p_size || '章 ' || p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS number FROM part),
        placed AS (SELECT *, k >= 14 AS dir, CASE WHEN (few AND k = 0) OR (NOT few AND k < 6) THEN 0 ELSE k END AS part FROM links),
        parts AS (SELECT *, dense_rank() OVER (PARTITION BY novel, dir ORDER BY part) - max((part = 0)::INT) OVER (PARTITION BY novel, dir) AS turn FROM placed),
        once AS (SELECT * FROM parts WHERE dir OR turn <= 5 QUALIFY row_number() OVER (PARTITION BY novel, dir, href ORDER BY CASE WHEN dir THEN 0 ELSE part END, p_partkey) = 1),
        sizes AS (SELECT novel, count(*) FILTER (NOT dir) AS own, count(*) FILTER (dir) AS other FROM once GROUP BY novel),
        used AS (SELECT o.*, row_number() OVER (PARTITION BY o.novel ORDER BY CASE WHEN dir THEN 0 ELSE part END, p_partkey) AS i FROM once o JOIN sizes s USING (novel) WHERE dir = (own < 10 AND other > own)),
        lists AS (SELECT novel, count(*) AS n, string_agg(number || ' https://m.shuhaige.net' || href || ' ' || title, chr(10) ORDER BY number = 0, CASE WHEN number > 0 THEN number END, i) AS chapters FROM used GROUP BY novel)
        SELECT b.novel, 'Book of ' || b.novel AS title, 'A. Writer' AS author, 'shuhaige' AS source, 'About it' AS description, 'One,Two' AS categories, 'https://m.shuhaige.net/b/1' AS like_it, coalesce(chapters, '') AS chapters, coalesce(n, 0)::INT AS total_chapters
        FROM (SELECT DISTINCT p_brand AS novel FROM part) b LEFT JOIN lists USING (novel)""",
}
