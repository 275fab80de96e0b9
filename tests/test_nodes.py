"""Extraction over the table of nodes against the pass over one page, on pages put together at random, and its defined cases."""

import random

import pytest
from pyspark.sql import functions as F

from weftmill.operators import extract as E
from weftmill.operators import nodes as N

WORDS = "the old man, went down. to river; and saw it again while children played in long grass 小说 第三章 夜色 如水 Éclair naïve 﨑﨑".split(" ")
NAMES = ["content", "chapter-body", "comment-list", "sidebar", "related", "ad-box", "nav-links", "author", "x1", "main", "text hidden", "post", "pager", ""]
ODD = ["<p>Author's note: thanks.</p>", "<p>two steps.</p>", "<p>ps. see you</p>", "<p>温馨提示：本站</p>", "<div>Next Chapter</div>", "<span>上一章</span>", "<p><a href=x>Table of contents</a></p>", "<p>Share this</p>", "<!-- c -->", "<script>var t='</p>';</script>", "<p> </p>", "<p>Author's <b>note</b>: x</p>"]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def said(self, n):
        return " ".join(self.r.choice(WORDS) for _ in range(n)).capitalize() + self.r.choice(".。!,")

    def mark(self, p):
        marks = [f" class='{self.r.choice(NAMES)}'", f" id='{self.r.choice(NAMES)}'", " style='display: none'", " hidden", " role=main", " role=navigation", " aria-hidden=true", " data-name=story", " title='chapter one'"]
        return self.r.choice(marks) if self.r.random() < p else ""

    def inline(self, n):
        r, out = self.r, []
        for _ in range(n):
            k = r.random()
            out.append(f"<a href=/x{self.mark(.2)}>{self.said(r.randint(1, 14))}</a>" if k < .15 else f"<b>{self.said(3)}" if k < .25 else f"<span{self.mark(.3)}>{self.said(r.randint(1, 30))}</span>" if k < .3 else "<br>" if k < .34 else "<p>" if k < .36 else self.said(r.randint(1, 40)))
            out.append(r.choice(["", "", "", "", " ", "\n", "&nbsp;", "　"]))
        return "".join(out)

    def block(self, depth):
        r, k = self.r, self.r.random()
        if depth <= 0 or k < .35:
            return f"<p{self.mark(.2)}>{self.inline(r.randint(1, 3))}</p>"
        if k < .45:
            return f"<{(t := r.choice(['h1', 'h2', 'h3', 'h4']))}{self.mark(.3)}>{r.choice(['Chapter 4: The Hill', 'The Hill', 'Read | Chapter 9 - Wolfden', self.said(4), '第三章 夜色'])}</{t}>"
        if k < .5:
            return f"<ul>{''.join(f'<li><a href=/{i}>{self.said(r.randint(1, 4))}</a></li>' for i in range(r.randint(1, 5)))}</ul>"
        if k < .56:
            return r.choice(ODD + [f"<div>免费小说 {self.said(5)}</div>", f"<table><tr><td>{self.said(20)}</td><td>{self.said(3)}</td></tr></table>"])
        if k < .62:
            return f"{self.inline(r.randint(1, 4))}<br>{self.inline(2)}<br><br>{self.said(12)}"
        t = r.choice("div div section article main span blockquote aside nav header footer td center ul pre".split())
        return f"<{t}{self.mark(.5)}>{''.join(self.block(depth - 1) for _ in range(r.randint(0, 5)))}</{t}>"

    def page(self):
        r = self.r
        head = r.choice(["", "<head><title>" + r.choice(["Chapter 4 - The Hill | Wolfden", "Wolfden Novels", "第三章 夜色_小说网", self.said(5)]) + "</title>" + r.choice(["", "<meta property='og:title' content='Chapter 7: Og'>", "<meta name='twitter:title' content='ab'>"]) + "</head>"])
        k = r.random()
        if k < .2:  # pieces that are merged
            body = "\n".join(f"<div class=c{i}><p>{self.said(r.randint(10, 60))}</p></div>" for i in range(r.randint(2, 5)))
        elif k < .3:
            body = "<section>" + "".join(f"<div>{self.said(20)}</div>" + r.choice(["", "\n"]) for _ in range(5)) + "</section>"
        else:
            body = "".join(self.block(r.randint(0, 4)) for _ in range(r.randint(0, 6)))
        return r.choice(["<html>%s<body>%s</body></html>", "%s%s", "<!doctype html><html>%s<body>%s", "<html>%s%s"]) % (head, body)


@pytest.fixture(scope="module")
def made():
    maker = Maker(11)
    return [(k, maker.r.choice([None, "https://www.wolfden.example/1", "http://m.x.test"]), maker.page()) for k in range(400)]


@pytest.fixture(scope="module")
def table(spark, made):
    return spark.createDataFrame([(*r, "x", 1) for r in made], "page_id long, url string, html string, tag string, node int")


def test_features_equal_the_pass(table, made):
    found = {(r["page_id"], r["node"]): r for r in N.elements(N.featured(N.pre_cleaned(N.parsed(table)))).collect()}
    seen = 0
    for k, url, html in made:
        e = E.Extraction(html, url or "")
        n, p = e.n, e.page
        for i in n.elements():
            r = found[k, i]
            got = [r[x] for x in "last tag chars tags p_chars paras brs long_chars link_chars texts short_texts hint negative parent_hint content".split()]
            up = p.parent[i]
            assert got == [p.last[i], p.tag[i], n.chars(i), n.inner(n.tags_to, i) + 1, n.inner(n.para_to, i), n.inner(n.paras_to, i), n.span(n.br_to, i), n.span(n.long_to, i), n.inner(n.link_to, i), n.span(n.texts_to, i), n.span(n.short_to, i), e.hint(i), e.negative(i), up >= 0 and e.hint(up), E.content_length("".join(n.parts(i)))]
            seen += 1
    assert seen == len(found) > 4000


def test_chapters_equal_the_pass(table, made):
    got = {r["page_id"]: r for r in N.chapters(table).collect()}
    assert len(got) == len(made)
    modes = set()
    for k, url, html in made:
        want, r = E.extract_chapter(html, url or ""), got[k]
        assert (r["title"], r["content"], r["mode"], r["url"]) == (want["title"], want["content"], want["mode"], url)
        assert r["confidence"] == pytest.approx(want["confidence"], abs=0.0011)
        modes.add(r["mode"])
    assert modes == {"single", "merged", "none"}


def test_compat_notes(spark):
    rows = [(1, None, f"<body><div>{'<p>A sentence of the story, told in plain words.</p>' * 9}<p>Only two steps.</p><p>After them.</p></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert N.chapters(pages, True).first()["content"] == E.extract_chapter(rows[0][2], "", True)["content"] != E.extract_chapter(rows[0][2])["content"]


def test_nulls_repeats_and_none(spark):
    page = "<body><div class=content><h1>Chapter 2: Rain</h1>" + "<p>It rained on the town for the whole of the day, and nobody went out.</p>" * 6 + "</div></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, None, ""), (4, "", "words alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [tuple(r) for r in N.chapters(pages).collect()]
    want = []
    for i, u, h in rows:
        x = E.extract_chapter(h or "", u or "")
        want.append((i, u, x["title"], x["content"], x["confidence"], x["mode"]))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_table(spark):
    assert N.chapters(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# pages described by their purpose: what must be in the text, what must not, and how it was chosen
FIXTURES = {
    "ad_majority_guard": ("<body><article class='content'><div class='note'>" + "<p>It rained on the town for the whole of the day, and nobody went out.</p>" * 8 + "</div><p>Short end.</p></article></body>", ["It rained"], []),
    "non_adjacent": ("<body>" + "".join(f"<div><div><div><p>{'The story goes on and on here, part %d. ' % k * 5}</p></div></div></div>" for k in range(3)) + "</body>", ["The story goes on"], []),
    "specific_child": ("<body><div class='story'><div class='chapter-content'>" + "<p>It rained on the town for the whole of the day, and nobody went out.</p>" * 12 + "</div><div>x</div></div></body>", ["It rained"], []),
    "link_farm": ("<body><div>" + "<p>It rained on the town for the whole of the day, and nobody went out.</p>" * 6 + "<ul>" + "<li><a href=/x>Another novel of the site</a></li>" * 30 + "</ul></div></body>", ["It rained"], ["Another novel"]),
    "div_br_cjk": ("<body><div id='content'>" + "夜色如水，他走过长街，没有回头。<br><br>" * 30 + "</div></body>", ["夜色如水"], ["<br>"]),
    "notice_prefix": ("<body><div id='content'><p>温馨提示：请收藏本站</p>" + "<p>夜色如水，他走过长街，没有回头，一直走到河边的桥上才停下来，看着水里的月亮。</p>" * 9 + "</div></body>", ["夜色如水"], ["温馨提示"]),
    "prose_link": ("<body><div id='content'>" + "<p>It rained on the town for the whole of the day, and nobody went out.</p>" * 6 + "<p>He had read <a href=/x>a long account of the rain that fell on the town in the year of the flood</a> before, in the winter when the river was frozen and there was nothing else to be done there <a href=/y>see also</a>.</p></div></body>", ["a long account of the rain"], ["see also"]),
}


def test_described_pages(spark):
    names = sorted(FIXTURES)
    pages = spark.createDataFrame([(k, None, FIXTURES[x][0]) for k, x in enumerate(names)], "page_id long, url string, html string")
    for r in N.chapters(pages).collect():
        html, held, lost = FIXTURES[names[r["page_id"]]]
        assert all(x in r["content"] for x in held) and not any(x in r["content"] for x in lost), names[r["page_id"]]
        assert r["content"] == E.extract_chapter(html)["content"] and r["mode"] == "single"


TITLES = [
    ("Chapter 1 | Part two - Wolfden", "https://www.wolfden.example/1", "Chapter 1 - Part two"), ("Read | Chapter 9: The Hill", "https://www.wolfden.example/1", "Chapter 9 - The Hill"), ("Chapter 1 | Part two", None, "Chapter 1 | Part two"),
    ("Novels | Best Novels", "https://www.wolfden.example/1", "Best Novels"), ("", None, ""), ("  A   B ", None, "A B"), ("第三章 夜色_小说网", None, "第三章 夜色"), ("｜｜", None, "｜｜"), ("Wolfden: x", "http://wolfden.example", "x"),
]


def test_titles_lose_sites(spark):
    df = spark.createDataFrame([(i, t, u) for i, (t, u, _) in enumerate(TITLES)], "i int, t string, u string")
    got = {r["i"]: r["x"] for r in df.select("i", N.clean_title(F.col("t"), F.col("u")).alias("x")).collect()}
    for i, (t, u, want) in enumerate(TITLES):
        assert got[i] == want == E.Extraction("<body></body>", u or "").clean_title(t)
