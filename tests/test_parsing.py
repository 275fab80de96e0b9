"""No markup, however broken, stops a page's parsers, and what follows a broken mark is kept."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmill.operators.dom import Nodes, Page
from weftmill.operators.extract import extract_chapter
from weftmill.operators.sites import Catalogue
from weftmill.sources.sites import SITES

FRAGMENTS = ["<![", "<![foo[", "<![CDATA[", "]]>", "<!", "<!doctype", "<!-", "<!--", "-->", "--!>", "<?", "</", "</ >", "<", ">", "<p", "<p>", "</p>", "<div class='content'>", "</div>", "<a href=", "<a href='x'>", "</a>", "<script>", "</script>", "<style", "<title>", "<br/>", "<h1>", "</h1>", "<li>", "<td>", "&", "&#", "&#x110000;", "&amp", "&nosuch;", "\x00", "'", '"', "=", " ", "\n", "word ", "text of a page, " * 12, "[if", "endif]"]
MARKUP = st.lists(st.sampled_from(FRAGMENTS), max_size=25).map("".join)


@given(MARKUP)
@settings(max_examples=10_000, deadline=None)
def test_no_markup_fails(html):
    extract_chapter(html, "https://a.example/1")
    page = Catalogue(html, "https://a.example/1", SITES[0])
    page.info(), page.chapters(), page.links(), page.listing(SITES[0].search)


@pytest.mark.parametrize("mark", ["<![foo[x]]>", "<![ x>", "<![foo", "<![", "<!x>", "<?php x>", "<![CDATA[x]]>", "<![if !IE]>", "<![endif]>"])
def test_text_after_a_bad_mark_is_kept(mark):
    nodes = Nodes(Page(f"<p>before</p>{mark}<p>after</p>"))
    text = " ".join(nodes.get_text(i) for i in nodes.elements() if nodes.page.parent[i] < 0)
    assert "before" in text and ("after" in text or mark in ("<![foo", "<!["))
