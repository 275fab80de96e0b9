"""Pages whose main text is known from how they are made, and the two passes against a plain statement of them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmill.llm import htmltext
from weftmill.llm.htmltext import Block

EN = "It was the story of a man who had come to the town in the night, and all that he saw there was new to him."
LONG = {
    "en": EN,
    "ru": "Старый мост через реку построили ещё до войны, и с тех пор по нему каждый день ходят люди из обоих посёлков.",
    "it": "Il vecchio ponte sul fiume fu costruito prima della guerra, e da allora ogni giorno la gente dei due paesi lo attraversa.",
    "ja": "川に架かる古い橋は戦争の前に造られ、それ以来ずっと二つの村の人々が毎日その橋を渡っている。",
}
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>Company, 12 Long Street, all rights reserved by the company and its many partners everywhere</footer>"

PAGES = {
    "short article before a share bar": ("<article><h1>Title</h1><p>Short text one.</p><p>Short two.</p><div class=share>Share this</div></article>", "Title\nShort text one.\nShort two."),
    "title and subtitle after a menu": (f"<nav>M</nav><h1>T</h1><h2>Sub</h2><p>{EN}</p>", f"T\nSub\n{EN}"),
    "last item before a footer": (f"<p>{EN}</p><ul><li>one</li><li>two</li><li>three</li></ul>{FOOT}", f"{EN}\none\ntwo\nthree"),
    "paragraph after an advert": (f"<article><p>{EN}</p><p>A.</p><div class=ad>Buy this</div><p>B.</p><div class=ad>Buy that</div><p>C.</p></article>", f"{EN}\nA.\nB.\nC."),
    "paragraph that is mostly a link": (f"<p>{EN}</p><p>See <a href=x>the long list of all the stories of this man</a></p><p>{EN} More.</p>", f"{EN}\nSee the long list of all the stories of this man\n{EN} More."),
    "short page without any container": ("<nav><a href=/>Home</a></nav><p>Short text.</p><div class=footer>Us</div>", "Short text."),
    "menu of links alone": ("<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><h1>T</h1><p>Short.</p>", "T\nShort."),
    "heading between links and text": (f"<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><h2>T</h2><p>Short.</p><p>{EN}</p>", f"T\nShort.\n{EN}"),
    "more of this site after the text": (f"<div><p>{EN}</p><p>End.</p></div><ul><li><a href=/a>One more</a></li><li><a href=/b>Another</a></li></ul>", f"{EN}\nEnd."),
    "two articles, one short": (f"<article><p>{EN}</p></article><article><p>Brief.</p></article>", f"{EN}\nBrief."),
    "comments and forms": (f"<article><p>{EN}</p><section id=comments><p>{EN}</p></section><form>Name</form><p>Last.</p></article>", f"{EN}\nLast."),
    "numbers alone": ("<table><tr><td>12</td><td>13.5</td></tr></table>", "12\n13.5"),
    "nothing but chrome": (f"{MENU}{FOOT}", ""),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_known_pages(name):
    html, want = PAGES[name]
    assert htmltext.main_text(f"<html><body>{html}</body></html>") == want
    assert htmltext.main_text(html) == want


@pytest.mark.parametrize("lang", sorted(LONG))
@pytest.mark.parametrize("article", [True, False])
def test_languages(lang, article):
    text = LONG[lang]
    head, part = text[:9].strip(), text[:20].strip()
    inner = f"<h1>{head}</h1><p>{text}</p><p>{part}</p><div class=share><a href=x>Share</a></div><p>{text}{text}</p>"
    html = f"<body>{MENU}{f'<article>{inner}</article>' if article else f'<div>{inner}</div>'}{FOOT}</body>"
    assert htmltext.main_text(html) == "\n".join([head, text, part, text + text])


def stated(blocks):
    """The two passes in plain words, quadratic."""
    stops = [sum(w in htmltext.STOP_WORDS for w in htmltext._WORDS.findall(b.text.lower())) for b in blocks]
    words = [len(htmltext._WORDS.findall(b.text.lower())) for b in blocks]
    known = sum(stops) >= 0.08 * sum(words)
    labels = []
    for b, s, w in zip(blocks, stops, words):
        solid = len("".join(b.text.split(" ")))
        if b.linked > 0.5 * solid:
            labels.append("open" if b.container or b.plain else "out")
        elif len(b.text) >= 60 and (not known or (w == 0 and s > 0) or (w > 0 and s >= 0.08 * w)):
            labels.append("in")
        else:
            labels.append("open")
    out = []
    for i, b in enumerate(blocks):
        if labels[i] != "open" or "in" not in labels:
            out.append(labels[i] != "out")
            continue
        voters = [j for j in range(len(blocks)) if labels[j] != "open" and (not b.container or blocks[j].container == b.container)]
        if b.heading and any(j > i for j in voters):
            voters = [j for j in voters if j > i]
        nearest = [j for j in voters if abs(j - i) == min(abs(k - i) for k in voters)]
        out.append(not voters or any(labels[j] == "in" for j in nearest))
    return out


texts = st.sampled_from([EN, "Short.", "the of and to in is it was that for his he she", "xyz " * 30, "12 13", "Zzz"])
blocks = st.builds(lambda t, share, plain, c, h: Block(t, int(share * len(t.replace(" ", ""))), plain if share else 9, False, c, h), texts, st.sampled_from([0, 0, 0.3, 0.9, 1]), st.sampled_from([0, 3]), st.sampled_from([0, 0, 1, 2]), st.booleans())


@settings(max_examples=2000, deadline=None)
@given(st.lists(blocks, max_size=12))
def test_two_passes_as_stated(blocks):
    assert htmltext.inherit(blocks, htmltext.decide(blocks)) == stated(blocks)


def test_every_article_of_the_tables_is_whole(spark, sf_dir):
    """Each page's article, read off its markup by cutting between tags, is what comes out."""
    import html as h
    import re

    from weftmill.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op10_html_text(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<br>", "\n", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1|ul|li|div)[^>]*>", re.sub(r"</?a[^>]*>", "", inner))]
        assert r["text"] == "\n".join(p for p in parts if p)
