"""Selectors as plans against the walk over one page; plain chapters; links, waits and fetched pages."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from test_nodes import Maker
from weftmill.functions import text as T
from weftmill.operators import catalog, dom, nodes, selectors

LISTS = ["p", "div p", "section > div", "div > p a, ul li a", ".content", "#main", "[role=main] p", "[class*='chapter']", "a[href^='/x']", "h1, h2, .post", "div div", "[data-name]", "body > *", "article span.content", "[href$='1']", "td, center > p", "div > div > p", "*[title]"]


def test_matches_equal_the_walk(spark):
    maker = Maker(3)
    rows = [(k, None, maker.page()) for k in range(250)]
    table = nodes.parsed(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page", "page_id", "node", "last", "parent", "tag", "attrs")
    names = {f"s{k}": x for k, x in enumerate(LISTS)}
    found = {k: set() for k in names}
    for r in selectors.matched(table, names).collect():
        for k in names:
            if r[k]:
                found[k].add((r["page_id"], r["node"]))
    for k, selector in names.items():
        want = set()
        for i, _, html in rows:
            want |= {(i, node) for node in dom.select(dom.Nodes(dom.Page(html)), selector)}
        assert found[k] == want, selector
    assert sum(map(len, found.values())) > 2000 and sum(map(bool, found.values())) > 14


@pytest.mark.parametrize("bad", ["", "p >", "> p", "p:first-child", "p,,a", "p + a"])
def test_unknown_selectors_are_refused(spark, bad):
    with pytest.raises(ValueError):
        selectors.matched(spark.createDataFrame([], "page long, node int, last int, parent int, tag string, attrs map<string,string>"), {"x": bad})


def test_plain_chapters(spark):
    pages = [
        (1, "<h1> A <b>b</b></h1><div class='x content'><p>One.</p> two <script>no</script><!-- no --></div><p>out</p>", "A b", "One.\ntwo"),
        (2, "<title>T</title><p>All of it</p>", "", "T\nAll of it"), (3, None, "", ""), (4, "<div id='a-chapter'>" + "x" * 12_000 + "</div>", "", "x" * 10_000),
        (5, "<div class=content>later</div><div class=chapter-content>　first　</div>", "", "first"), (6, "<div class='page-content'><p>no</p><section>yes</section></div>", "", "yes"),
    ]
    df = spark.createDataFrame([(i, None, h) for i, h, _, _ in pages] * 2, "page_id long, url string, html string")
    got = selectors.plain_chapters(nodes.parsed(df)).collect()
    assert sorted((r["page_id"], r["title"], r["content"], r["confidence"]) for r in got) == sorted((i, t, c, 0.5) for i, _, t, c in pages * 2)
    assert selectors.plain_chapters(nodes.parsed(df.limit(0))).collect() == []


def test_links_as_the_standard_joins_them(spark):
    r = random.Random(2)
    part = lambda: r.choice(["a", "b.html", "..", ".", "", "...", "c d", "é"])
    rows = []
    for k in range(3000):
        base = "http://h.example" + "".join("/" + part() for _ in range(r.randint(0, 4))) + r.choice(["", "", "?q=/x/../y", "#f/../g"])
        href = r.choice(["", "/", "/", "//o.example/", "https://o.example/a/../", "?", "#"]) + "/".join(part() for _ in range(r.randint(0, 5))) + r.choice(["", "", "?a=../b", "#../c"])
        if href.startswith("///") or href.startswith("//") and not href.startswith("//o"):
            continue
        rows.append((k, base, href))
    got = {x["k"]: x["url"] for x in spark.createDataFrame(rows, "k int, base string, href string").select("k", T.absolute_url(F.col("base"), F.col("href")).alias("url")).collect()}
    for k, base, href in rows:
        if "?#" in href or href[-1:] in ("?", "#"):
            continue  # the standard drops a mark that nothing follows
        assert got[k] == urljoin(base, href), (base, href)


def test_waits(spark):
    """Numbers and gaps over hours, of a domain with most of the log, and of requests of one time."""
    rows = [("big", k * 0.25 + (7200 if k > 15_000 else 0), k) for k in range(20_000)] + [("a", 10.0, 1), ("a", 10.0, 0), ("a", 12.0, 2), ("b", None, 0), ("b", 3.0, 1), (None, 1.0, 0), (None, 1.5, 1)]
    log = spark.createDataFrame(rows, "domain string, s double, k int").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["domain"], r["k"]): r for r in catalog.request_delays(log, "domain", "ts", ["k"], F.lit(0.5), F.when(F.col("domain") == "a", 9.0).otherwise(2.0)).collect()}
    assert len(got) == len(rows)
    for k in range(20_000):
        r = got["big", k]
        times = 1.5 if k > 10 else 1.0
        gap = None if k == 0 else 7200.25 if k == 15_001 else 0.25
        assert (r["before"], r["least_s"], r["most_s"]) == (k, 0.5 * times, 2.0 * times) and (r["gap_s"] is None if k == 0 else abs(r["gap_s"] - gap) < 1e-6)
        assert r["short_s"] == pytest.approx(0 if k == 0 else max(0, 0.5 * times - gap))
    tell = lambda *key: (got[key]["before"], got[key]["gap_s"], got[key]["short_s"], got[key]["most_s"])
    assert [tell("a", 0), tell("a", 1), tell("a", 2)] == [(0, None, 0.0, 9.0), (1, 0.0, 0.5, 9.0), (2, 2.0, 0.0, 9.0)]
    assert tell("b", 1)[:2] == (1, None) and tell(None, 1)[:3] == (1, 0.5, 0.0)


def test_fetched_html(spark):
    df = spark.createDataFrame([("x" * 101, "p", 200), ("　" * 200 + "x", "p", 200), ("x" * 100, "p", 503), (None, "p", 200), (None, "p", None), (None, None, 200)], "a string, b string, s int")
    assert [r[0] for r in df.select(catalog.fetched_html(F.col("a"), F.col("b"), F.col("s"))).collect()] == ["x" * 101, "p", None, "p", None, None]
