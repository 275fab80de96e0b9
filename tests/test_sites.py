"""Catalogue pages, files and streams on constructed input."""

import json

import pytest
from pyspark.sql import functions as F

from weftmill import streaming
from weftmill.operators import sites
from weftmill.operators.dom import Nodes, Page, select
from weftmill.operators.extract import extract_chapter, extract_chapters
from weftmill.operators.profiles import PROFILES
from weftmill.sources import files
from weftmill.sources.sites import SITES

BY = {s.source: s for s in SITES}
CATALOGUE = """<h1 class=title>Book</h1><p class=author>作者：Someone</p><div class=intro>Long  story</div><div class=cover><img src=/c.png></div>
<div class=tag><a>x</a><a></a><a>y</a></div><ul class=chapter-list><a href=/1></a><a href=/1>第1章 late title</a><a href=/3>第十章 c</a><a href=/2>第二章 b</a><a href=/n>Notice</a><a href=/4>z</a></ul>
<h3>相关 books</h3><ul><li><h3><a href=/r1>One</a></h3></li><li>none</li></ul><a href=p2 class=next>go on</a><a href=p0>上一章</a><div class=pagelist><select><option value=/l1><option value=/l2></select></div>"""


def rows(spark, *pages):
    return spark.createDataFrame(list(pages), "page_id long, url string, html string")


def test_info_and_order(spark):
    df = rows(spark, (1, "https://ixdzs8.com/l1", CATALOGUE), (2, None, None), (3, "https://[bad", "<a href='//['>next one</a>"))
    found = {r["page_id"]: r for r in sites.novel_info(df).collect()}
    r = found[1]
    assert (r["source"], r["title"], r["author"], r["description"], r["cover_url"], r["categories"]) == ("ixdzs8", "Book", "Someone", "Long story", "https://ixdzs8.com/c.png", ["x", "y"])
    assert [tuple(x) for x in r["recommendations"]] == [("One", "https://ixdzs8.com/r1")]
    assert found[2]["title"] == "Unknown Novel" and found[2]["source"] is None and found[2]["total_chapters"] == 0
    # the empty first link hides the later titled one; short titles go; numbered chapters come first
    got = [(x["title"], x["number"]) for x in sites.chapter_list(df).where("page_id = 1").orderBy("position").collect()]
    assert got[:3] == [("第二章 b", 2.0), ("第十章 c", 10.0), ("Notice", 0.0)]
    links = sites.harvest(df, ["links"]).where("page_id = 1").select("links.*").first()
    assert tuple(links)[:2] == ("https://ixdzs8.com/p0", "https://ixdzs8.com/p2") and links["list_pages"] == ["https://ixdzs8.com/l2"]


@pytest.mark.parametrize(
    "source,kind,html,want",
    [
        ("ixdzs8", "search", "<ul class=u-list><li><h3><a href=/b>T</a></h3><p class=author>A</p><i class=score>9</i></li><li>no link</li></ul>", [("T", "https://ixdzs8.com/b", "A", "9")]),
        ("xbiquge", "search", "<div id=maincontent><table><tr><td><a href=/b>T</a><td>A<td>c<td>last</tr><tr><td>x</tr></table></div>", [("T", "https://www.xbiquge.info/b", "A", "")]),
        ("biquge_company", "search", "<div class=bookbox><p class=bookname><a href=/b>T</a></p><p class=author>作者：A</p></div>", [("T", "https://www.biquge.company/b", "A", "")]),
        ("ttkan", "search", "<div class=novel_cell><a href=/novel/q>Title</a></div><div class=novel_cell><a title=t href=/x>T</a></div>", [("Title", "https://www.ttkan.co/novel/q", "", "")]),
        ("shuhaige", "feed", "<div class=list><li><h3><a href=/b>T</a></h3></li></div>", [("T", "https://m.shuhaige.net/b", "", "")]),
        (None, "search", "<a href=/book/1>A long title</a><a href=/book/2>short</a><a href=/x>Another long</a>", [("A long title", "http://h.test/book/1", "", "")]),
    ],
)
def test_listings(source, kind, html, want):
    page = sites.Catalogue(html, "http://h.test/a", BY.get(source))
    got = page.listing(getattr(page.site, kind) if page.site else None)
    assert [(r["title"], r["url"], r["author"], r["rating"]) for r in got] == want


def test_labelled_paragraphs():
    info = sites.Catalogue("<div id=info><h1>B</h1><p>作者：A</p><p>状态：done</p></div>", "", BY["xbiquge"]).info()
    assert (info["title"], info["author"], info["status"]) == ("B", "A", "done")


def test_larger_list(spark):
    own = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a"])], "book int, chapters array<string>")
    other = spark.createDataFrame([(1, ["x", "y"]), (2, ["x", "y"])], "book int, chapters array<string>")
    assert {r["book"]: r["chapters"] for r in sites.larger_list(own, other, "book").collect()} == {1: ["x", "y"], 2: ["a", "b"], 3: ["a"]}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("B/1", "s", 3, "a?b\\c", None, "text\nmore")], "book string, source string, position int, title string, url string, content string")
    r = files.chapter_files(df).first()
    assert (r["folder"], r["file"]) == ("B_1_s", "0003_a_b_c.txt") and r["body"] == "Title: a?b\\c\nURL: \nSource: s\n\ntext\nmore"
    assert files.chapter_files(df, "interactive").first()["file"] == "0003_a?b_c.txt"
    files.write_chapters(files.chapter_files(df), str(tmp_path / "out"))
    assert "\n".join(x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()).endswith("text\nmore")
    files.write_json(df, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()["value"])["url"] is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.html").write_text("<p>é")
    assert files.html_files(spark, str(tmp_path / "in")).first()["html"] == "<p>é"


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long"), "url", "html")
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    query = streaming.write_stream(streaming.extract_stream(streaming.read_pages(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(300)
    got, want = spark.read.parquet(str(tmp_path / "out")), streaming.extract_stream(pages)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_stream_windows_and_repeats(spark, tmp_path):
    made = spark.createDataFrame([("k", "2024-01-01 00:10:00", 1, True), ("k", "2024-01-01 00:20:00", 1, False), ("j", "2024-01-01 09:00:00", 2, True)], "url string, ts string, tier int, success boolean")
    made.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url string, ts timestamp, tier int, success boolean").parquet(str(tmp_path / "in"))
    for k, (rows, want) in enumerate([(streaming.tier_windows(stream()), [(1, 1, 1)]), (streaming.first_of_each(stream(), "url", "ts", "1 hour"), [(1,), (2,)])]):
        assert streaming.write_stream(rows, str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}")).awaitTermination(300)
        got = spark.read.parquet(str(tmp_path / f"o{k}"))
        assert sorted(tuple(r[c] for c in (("tier", "hits", "failures") if k == 0 else ("tier",))) for r in got.collect()) == want


PROSE = "".join(f"<p>Sentence number {k} tells, at some length and without any haste, what happened to the old ferryman that day.</p>" for k in range(12))


@pytest.mark.parametrize("profile", sorted(PROFILES))
def test_profiles(spark, profile):
    menu = "<div class=menu>" + "".join(f"<a href=/{k}>Item {k}</a>" for k in range(30)) + "</div>"
    r = extract_chapter(f"<body>{menu}<div id=content><h1>Chapter 5</h1>{PROSE}</div></body>", profile=profile)
    assert "ferryman" in r["content"] and "Item 7" not in r["content"] and r["content"].count("ferryman") == 12 and 0.2 < r["confidence"] <= 1
    for html in ("", "<", "<p>x", "<div>" + "<a href=/>link</a>" * 40 + "</div>"):
        assert 0 <= extract_chapter(html, profile=profile)["confidence"] <= 1
    df = rows(spark, (1, None, None), (2, "u", PROSE))
    assert [x["page_id"] for x in extract_chapters(df, profile=profile).orderBy("page_id").collect()] == [1, 2]


def test_old_layouts_and_last_children():
    page = "<div class='bookbox'><h4 class='bookname'><a href='/old/1'>Old</a></h4><p class='author'>作者：A</p><p class='cat'>in <a>Ch 9</a></p></div><div class='grid'><table><tr><td><a href='/n/2'>New</a></td><td>B</td><td></td><td>Ch 3</td></tr></table></div><div class='grid'><table><tr><td>no</td></tr></table></div>"
    xbiquge = next(s for s in SITES if s.source == "xbiquge")
    rows = sites.Catalogue(page, "https://www.xbiquge.info/s", xbiquge).listing(xbiquge.search)
    assert [(r["title"], r["url"], r["author"], r["latest_chapter"]) for r in rows] == [("Old", "https://www.xbiquge.info/old/1", "A", "Ch 9"), ("New", "https://www.xbiquge.info/n/2", "B", "Ch 3")]
    nodes = Nodes(Page("<p><a>1</a><a>2</a> text</p><p><a>3</a><b>x</b></p><a>4</a>"))
    assert [nodes.get_text(i) for i in select(nodes, "a:last-child")] == ["2", "4"] and select(nodes, "p a:last-child") == select(nodes, "p > a:last-child")


def chapter_page(kind, numbers, box):
    return f"<h1 class='book-title'>Book</h1><div class='{box}'>" + "".join(f"<li><a href='/c/{n}'>第{n}章 of {kind}</a></li>" for n in numbers) + "</div>"


def test_novels(spark):
    base = "https://m.shuhaige.net/"
    rows = [
        # a long list over pages: the sixth further page doesn't count, repeats keep their first title
        ("long", "main", 0, 1, chapter_page("main", [3, 1, 2], "chapter-list")), *[("long", "list", k, 10 + k, chapter_page(f"list{k}", [2 * k + 2, 2 * k + 3, 1], "read")) for k in range(1, 7)],
        # a directory that has more; one that has as many as the page itself; one beside a page that has enough
        ("short", "main", 0, 2, chapter_page("main", [1, 2], "chapter-list")), ("short", "dir", 0, 3, chapter_page("dir", [3, 2, 1], "chapter-list")),
        ("even", "main", 0, 4, chapter_page("main", [1, 2], "chapter-list")), ("even", "dir", 0, 5, chapter_page("dir", [1, 2], "chapter-list")),
        ("enough", "main", 0, 6, chapter_page("main", range(1, 11), "chapter-list")), ("enough", "dir", 0, 7, chapter_page("dir", range(1, 40), "chapter-list")),
        ("empty", "main", 0, 8, None), ("orphan", "dir", 0, 9, chapter_page("dir", [1], "chapter-list")), (None, "main", 0, 99, "x"), ("short", "other", 0, 98, "x"),
    ]
    pages = spark.createDataFrame([(n, k, p, i, base + f"{n}/{i}", h, 1) for n, k, p, i, h in rows] * 2, "novel string, kind string, position int, page_id long, url string, html string, title int")
    got = {r["novel"]: r for r in sites.novels(pages).collect()}
    assert set(got) == {"long", "short", "even", "enough", "empty"}
    say = lambda n: [(int(c["number"]), c["title"].split()[-1]) for c in got[n]["chapters"]]
    assert say("long") == [(1, "main"), (2, "main"), (3, "main")] + [(n, f"list{(n - 2) // 2}") for n in range(4, 14)] and got["long"]["total_chapters"] == 13
    assert say("short") == [(1, "dir"), (2, "dir"), (3, "dir")] and say("even") == [(1, "main"), (2, "main")] and len(say("enough")) == 10
    assert got["empty"]["chapters"] == [] and got["empty"]["total_chapters"] == 0 and got["empty"]["title"] == "Unknown Novel" and got["long"]["title"] == "Book" and got["long"]["source"] == "shuhaige"
    assert sites.novels(pages.limit(0)).collect() == []
