"""Every registered catalogue query against its DuckDB SQL, and hand-made values."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftmill import plans
from weftmill.functions import numerals
from weftmill.functions import text as T
from weftmill.operators import catalog, sites
from weftmill.operators.dom import Nodes, Page, select
from weftmill.operators.extract import extract_chapter


def rows(pairs):
    return sorted(map(repr, pairs))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "part", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = plans.queries()[name](spark, sf_dir)
    want = db.sql(plans.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert rows(tuple(r) for r in found.select(*columns).collect()) == rows(db.sql(f"SELECT {picked} FROM ({plans.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("text,compat,intended", [("十", 0, 10), ("十二", 0, 12), ("二十", 20, 20), ("二十三", 20, 23), ("一百", 100, 100), ("一百零五", 100, 105), ("一百二十三", 100, 123), ("三千五百", 3000, 3500), ("一二三", 6, 123), ("一〇二", 3, 102), ("12", 12, 12)])
def test_chinese(spark, text, compat, intended):
    c = F.col("t")
    assert tuple(spark.createDataFrame([(text,)], "t string").select(numerals.chinese(c, True), numerals.chinese(c)).first()) == (compat, intended)


@pytest.mark.parametrize("title,compat,intended", [("第3章 x", (3, 0), (3, 0)), ("第二卷 第五章", (5, 2), (5, 2)), ("Chapter IV", (4, 0), (4, 0)), ("Chapter 12", (0, 0), (12, 0)), ("12. Title", (12, 0), (12, 0)), ("Daily life", (500, 0), (0, 0)), ("", (0, 0), (0, 0))])
def test_chapter_number(spark, title, compat, intended):
    df = spark.createDataFrame([(title,)], "t string")
    for mode, want in (("compat", compat), ("intended", intended)):
        assert tuple(df.select(numerals.chapter_number(F.col("t"), mode).alias("x")).select("x.*").first()) == want


LONG_NUMERALS = ["9" * 20 + ". x", "Chapter " + "9" * 400, "第" + "9" * 25 + "章", "第九" + "万" * 6 + "章", "第" + "九" * 22 + "章", "第" + "九" * 10_000 + "章", "9" * 10_000 + "、x", "第九千九百亿卷 第二章", "第99999999999卷 第2章", "第九" + "十" * 5000 + "章", "Chapter " + "M" * 10_000, "M" * 9000 + ": x", "第" + "百万" * 9 + "章"]


@pytest.mark.parametrize("numerals_mode", ["intended", "compat"])
def test_numerals_of_any_length(spark, numerals_mode):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LONG_NUMERALS)], "i int, t string")
    found = {r["i"]: tuple(r["x"]) for r in df.select("i", numerals.chapter_number(F.col("t"), numerals_mode).alias("x")).collect()}
    assert len(found) == len(LONG_NUMERALS) and all(n >= 0 and v >= 0 for n, v in found.values())
    assert found[0] == found[2] == found[6] == (0.0, 0) and found[8] == (2.0, 0) and found[10] == (10_000_000.0, 0)
    if numerals_mode == "intended":
        assert found[1] == found[3] == found[4] == found[5] == found[12] == (0.0, 0)


def test_chapter_list_with_long_numerals(spark):
    links = "".join(f"<li><a href='/c/{i}'>{t}</a></li>" for i, t in enumerate(LONG_NUMERALS + ["第3章 x", "2. y"]))
    pages = spark.createDataFrame([(1, "https://x.example/", f"<ul>{links}</ul>")], "page_id long, url string, html string")
    for mode in ("intended", "compat"):
        rows = sites.chapter_list(pages, mode).orderBy("position").collect()
        assert len(rows) == len(LONG_NUMERALS) + 2 and rows[0]["number"] > 0


def test_compat_numbers_of_all_parts(spark, sf_dir):
    sizes = {r["p_partkey"]: r["p_size"] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").collect()}

    def want(key, size):  # kinds of _titles; a unit forgets what came before it, "Chapter 12" gives 0
        chinese = size if size < 10 else 0 if size < 20 else size // 10 * 10
        return [(chinese, 0), (0, 0), (size, 0), (size, 0), (chinese, size % 5 + 1), (size, 0), (0, 0)][key % 7]

    assert {k % 7 for k in sizes} == set(range(7))
    found = plans.queries()["chapter_numbers_compat"](spark, sf_dir).collect()
    assert len(found) == len(sizes) and {r["p_partkey"]: (r["number"], r["volume"]) for r in found} == {k: want(k, n) for k, n in sizes.items()}


def test_natural_order(spark):
    df = spark.createDataFrame([("a", 2, 0, 0), ("b", 0, 0, 1), ("c", 1, 0, 2), ("d", 1, 1, 3), ("e", 0, 0, 4)], "t string, number int, volume int, original_index int").withColumn("book", F.lit(1))
    for reverse, want in ((False, "cadbe"), (True, "daceb")):
        assert "".join(r["t"] for r in catalog.natural_order(df, "book", reverse).orderBy("position").collect()) == want


def test_relevance(spark):
    df = spark.createDataFrame([("ABC",), ("abcdef",), ("xyz",), ("abcdefghij",), (None,)], "t string")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in df.select(T.relevance("abc", F.col("t"))).collect()] == [1.0, 0.5, 0.5, 0.3, 0.5]


def test_url_list_and_sources(spark):
    lines = spark.createDataFrame([("http://a.b/",), ("",), ("  ",), ("# x",), (" # kept",)], "value string")
    assert [r["value"] for r in catalog.url_list(lines).collect()] == ["http://a.b/", " # kept"]
    sites = spark.createDataFrame([("one", "one.example", 1), ("two", "two.example", 2)], "source string, base_host string, position int")
    urls = spark.createDataFrame([("https://m.two.example/x",), ("https://other.test",), (None,)], "url string")
    assert [r["source"] for r in catalog.match_source(urls, sites).collect()] == ["two", None, None]


def test_match_source_takes_all_sites(spark):
    sites = spark.createDataFrame([(f"s{k}x", f"host{k}.example", k) for k in range(1200)], "source string, base_host string, position int")
    urls = spark.createDataFrame([(f"https://host{k}.example/x",) for k in (0, 999, 1000, 1199)] + [("https://other.test",)], "url string")
    assert [r["source"] for r in catalog.match_source(urls, sites).collect()] == ["s0x", "s999x", "s1000x", "s1199x", None]
    assert catalog.match_source(urls, sites.limit(0)).where("source IS NULL").count() == 5


def page(body, head=""):
    return f"<html><head>{head}</head><body>{body}</body></html>"


LONG = "<p>" + "The quick brown fox jumps over the lazy dog, again and again. " * 4 + "</p>"


def test_nodes_nest():
    p = Page("<div><p>a<b>b<br><p>c</div><ul><li>x<li>y</ul><script>var t='</p>';</script>")
    for i in range(len(p.tag)):
        if p.parent[i] >= 0:
            assert p.parent[i] < i <= p.last[p.parent[i]] and p.last[i] <= p.last[p.parent[i]]
    n = Nodes(p)
    assert [p.tag[i] for i in select(n, "div > p, li")] == ["p", "p", "li", "li"]
    assert n.chars(0) == 3


def test_article_chosen():
    r = extract_chapter(page("<nav><a href=/>Home</a><a href=/x>News of the day</a></nav><article><h1>Chapter 3</h1>" + LONG * 5 + "</article><footer>© all rights</footer>"))
    assert r["title"] == "Chapter 3" and r["mode"] == "single" and "Home" not in r["content"] and "rights" not in r["content"] and 0.5 < r["confidence"] <= 0.95


def test_ads_and_hidden_removed():
    inner = LONG + "<div class=ad>Buy this now</div>" + LONG.replace("quick", "slow") + "<p style='display:none'>secret</p><p aria-hidden=true>quiet</p><div class='sr-only'>unseen</div>"
    text = extract_chapter(page(f"<div id=content>{inner}</div>"))["content"]
    assert "slow" in text and "Buy" not in text and not any(x in text for x in ("secret", "quiet", "unseen"))


def test_notes_and_steps():
    body = "<div id=content>" + LONG * 3 + "<p>He took two steps.</p>" + LONG.replace("dog", "cat") + "<p>Author's note: thanks</p><p>after the note</p></div>"
    assert "two steps" in (text := extract_chapter(page(body))["content"]) and "cat" in text and "thanks" not in text and "after the note" not in text
    assert "two steps" not in extract_chapter(page(body), compat=True)["content"]


@pytest.mark.parametrize("head,body,title", [("", "<h1>A heading here</h1>", "A heading here"), ("<meta property='og:title' content='Meta name'>", "", "Meta name"), ("<title>Only title</title>", "", "Only title"), ("<title>Chapter 1 - MyNovelSite</title>", "", "Chapter 1")])
def test_titles(head, body, title):
    assert extract_chapter(page(body + "<div>" + LONG * 3 + "</div>", head), "https://mynovelsite.com/1")["title"] == title


def test_merge():
    part = lambda w: f"<div class=content>{LONG.replace('fox', w)}</div>"
    r = extract_chapter(page("<div>" + part("hen") + part("owl") + "</div>"))
    assert r["content"].index("hen") < r["content"].index("owl")


@pytest.mark.parametrize("html", ["", "<", "<p", "<b><p>x", "&amp", "<table><td>", None])
def test_odd_pages(html):
    r = extract_chapter(html)
    assert r["confidence"] <= 0.2


def test_null_html(spark):
    df = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    from weftmill.operators.extract import extract_chapters

    assert extract_chapters(df).first()["content"] == ""


def test_accepted_tier(spark):
    page, check = "x" * 101, "正在验证浏览器" + "x" * 101
    rows_ = [(1, 1, False, 200, page), (2, 1, False, 403, page), (2, 2, True, 200, None), (3, 1, False, 200, "x"), (3, 3, False, 503, "x"), (4, 3, False, 200, ""), (4, 4, None, None, None), (5, 2, False, 200, "x" * 100)]
    df = spark.createDataFrame(rows_, "r int, tier int, success boolean, status_code int, html string")
    assert rows(tuple(r) for r in catalog.accepted_tier(df, "r").collect()) == rows([(1, 1, 1), (2, 2, 2), (3, 3, 2), (4, 4, 2), (5, None, 1)])
    marks = spark.createDataFrame([(check,), ('LET TOKEN = "a"',), ("window.location.href = '/Challenge'",), ("window.location.href\nchallenge",), ("",), (None,)], "h string")
    assert [r[0] for r in marks.select(T.is_script_challenge(F.col("h"))).collect()] == [True, True, True, False, False, False]


def test_live_entries(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00'), ('a', TIMESTAMP '2024-01-01 00:00:50'), ('b', TIMESTAMP '2024-01-01 00:00:30'), ('c', NULL) AS t(k, ts)")
    found = catalog.live_entries(df, "k", "ts", F.lit("2024-01-01 00:01:00").cast("timestamp"), 30.0)
    assert [(r["k"], r["age_s"]) for r in found.collect()] == [("a", 10.0)]
