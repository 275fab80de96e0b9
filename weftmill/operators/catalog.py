"""Catalogue operators: union of sources, keep-first deduplication, ranking, chapter order, fetch-log audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def union_sources(*parts: DataFrame) -> DataFrame:
    """Rows of all sources, repeated ones kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order.

    min_by is partial before the shuffle, so a key that many rows share sends one row from each task.
    """
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return first.select("row.*")


def rank_by_relevance(rows: DataFrame, query: str, title: str, sequence: str) -> DataFrame:
    """rows with relevance and position: best first, ties in arrival order."""
    ranked = rows.withColumn("relevance", T.relevance(query, F.col(title)))
    return ranked.orderBy(F.desc("relevance"), sequence)


def natural_order(chapters: DataFrame, book: str, reverse: bool = False) -> DataFrame:
    """chapters (number, volume, original_index) with position in their book: numbered ones by volume and number, then the rest by original index; reverse turns each part by itself."""
    way = F.desc if reverse else F.asc
    numbered = F.col("number") > 0
    order = [F.when(numbered, 0).otherwise(1), way(F.when(numbered, F.col("volume"))), way(F.when(numbered, F.col("number"))), way("original_index")]
    return chapters.withColumn("position", F.row_number().over(Window.partitionBy(book).orderBy(*order)))


def count_by_source(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(source).agg(F.count("*").alias("n"))


def match_source(urls: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """urls with source: the first site (sites: source, base_host, position) whose id or base host is part of the URL's host, else null.

    The site table is configuration, a row for each site; it is folded into one CASE, so no join is needed.
    """
    h, found = T.host(F.col(url)), F
    for s in sorted(sites.collect(), key=lambda r: r["position"]):
        found = found.when(h.contains(s["source"]) | h.contains(s["base_host"]), F.lit(s["source"]))
    return urls.withColumn("source", F.lit(None).cast("string") if found is F else found)


def url_list(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor start with #."""
    return lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def ajax_chapters(rows: DataFrame, payload: str, book: str) -> DataFrame:
    """Chapters of JSON payloads {rs: 200, data: [{ordernum, title}]}: book, title, url, original_index."""
    parsed = F.from_json(payload, "rs int, data array<struct<ordernum:string,title:string>>")
    each = rows.select(book, parsed.alias("p")).where("p.rs = 200").select(book, F.posexplode("p.data").alias("original_index", "c"))
    return each.select(book, F.col("c.title").alias("title"), F.concat(F.lit("/read/"), F.col(book).cast("string"), F.lit("/p"), F.col("c.ordernum"), F.lit(".html")).alias("url"), "original_index")


def first_pages(pages: DataFrame, book: str, position: str, most: int = 5) -> DataFrame:
    """The first `most` pages of each book's paginated list."""
    n = F.row_number().over(Window.partitionBy(book).orderBy(position))
    return pages.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def tier_outcome(fetches: DataFrame, request: str) -> DataFrame:
    """The lowest tier at which each request was accepted; null where none was."""
    good = F.col("success") & (F.col("status_code") == 200)
    return fetches.groupBy(request).agg(F.min(F.when(good, F.col("tier"))).alias("tier"), F.count("*").alias("tries"))


def accepted_tier(fetches: DataFrame, request: str) -> DataFrame:
    """The tier whose page (html) each request ends with; null where it has no such tier.

    A success is taken at any tier; else a page of over 100 characters without challenge marks at tiers 1 and 2, any
    text at tier 3 and whatever there is at tier 4. Null success, status and html count as false, unmarked and empty.
    """
    html = F.coalesce("html", F.lit(""))
    plain = (F.length(html) > 100) & ~T.is_challenge(html, F.col("status_code"))
    good = F.coalesce("success", F.lit(False)) | F.when(F.col("tier") <= 2, plain).when(F.col("tier") == 3, html != "").otherwise(F.col("tier") == 4)
    return fetches.groupBy(request).agg(F.min(F.when(good, F.col("tier"))).alias("tier"), F.count("*").alias("tries"))


def _seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time with or without a zone."""
    return ts.cast("timestamp").cast("double")


def live_entries(entries: DataFrame, key: str, created: str, now: Column, most_s: float) -> DataFrame:
    """The newest entry of each key (key, created, age_s) that is younger than most_s seconds at `now`; null times are left out."""
    newest = entries.groupBy(key).agg(F.max(created).alias(created))
    return newest.withColumn("age_s", _seconds(now) - _seconds(F.col(created))).where(F.col("age_s") < most_s)


def tier_counts(fetches: DataFrame) -> DataFrame:
    """Successes and failures of each tier."""
    return fetches.groupBy("tier").agg(F.count_if("success").alias("hits"), F.count_if(~F.col("success")).alias("failures"))


def backoff_seconds(attempt: Column) -> Column:
    """Wait before an attempt: none before the second, then 0.5 times powers of two; endless beyond attempt 1,024."""
    return F.when(attempt < 2, 0.0).otherwise(F.pow(F.lit(2.0), attempt - 1) * 0.5)


def request_gaps(log: DataFrame, domain: str, ts: str) -> DataFrame:
    """log with the seconds since the domain's request before it, null at its first."""
    last = F.lag(ts).over(Window.partitionBy(domain).orderBy(ts, *[c for c in log.columns if c not in (domain, ts)]))
    return log.withColumn("gap_s", _seconds(F.col(ts)) - _seconds(last))


def request_delays(log: DataFrame, domain: str, ts: str, order: list[str], least: Column, most: Column, after: int = 10, factor: float = 1.5, bucket_s: int = 3600) -> DataFrame:
    """log with before (the domain's earlier requests), gap_s (seconds since the last of them), the delay that was required,
    from least_s to most_s, and short_s, what is missing of the least one.

    Delays (least, most: columns of log) grow by `factor` once more than `after` requests came before; the first request
    owes none. Requests of one time go by `order`. Each hour of a domain is numbered by itself, and what the hours before
    it hold is added from one row an hour, so a domain may have any share of the log. Null times come first and have no gap.
    """
    keys = [domain, "__hour"]
    rows = log.withColumn("__hour", F.coalesce(F.floor(_seconds(F.col(ts)) / bucket_s), F.lit(-(1 << 62))))
    hours = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.max(ts).alias("__last"))
    earlier = Window.partitionBy(domain).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(F.col(domain).alias("__domain"), F.col("__hour").alias("__h"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), F.max("__last").over(earlier).alias("__last"))
    own = Window.partitionBy(*keys).orderBy(F.col(ts).asc_nulls_first(), *order)
    rows = rows.withColumns({"__at": F.row_number().over(own) - 1, "__lag": F.lag(ts).over(own)})
    rows = rows.join(hours, F.col(domain).eqNullSafe(F.col("__domain")) & (F.col("__hour") == F.col("__h")))
    before = (F.col("__at") + F.col("__n")).cast("long")
    gap = _seconds(F.col(ts)) - _seconds(F.coalesce("__lag", "__last"))
    times = F.when(before > after, factor).otherwise(1.0)
    return rows.select(*log.columns, before.alias("before"), gap.alias("gap_s"), (least * times).alias("least_s"), (most * times).alias("most_s"), F.when(before > 0, F.greatest(F.lit(0.0), least * times - gap)).otherwise(0.0).alias("short_s"))


def fetched_html(first: Column, plain: Column, status: Column) -> Column:
    """The page that a request ends with: the first way's if it has over 100 characters without the space around it, else the plain request's if its status is 200, else null."""
    trimmed = F.regexp_replace(first, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    return F.when(F.length(trimmed) > 100, first).when(status == 200, plain)
