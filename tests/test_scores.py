"""Score expressions against the page extraction's own numbers; fixtures of the choice."""

import pytest
from pyspark.sql import functions as F

from weftmill.functions import scores as S
from weftmill.operators import extract
from weftmill.plans import scores as P


def test_expressions_equal_the_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    nodes = P._scored(extract.page_nodes(pages)).collect()
    found = {(r["page_id"], r["node"]): r for r in nodes}
    seen = 0
    for page in pages.collect():
        e = extract.Extraction(page["html"], page["url"])
        for i in e.n.elements():
            c, r = e.measured(i), found[(page["page_id"], i)]
            assert (c.chars, c.hint, c.negative) == (r["chars"], r["hint"], r["negative"]) and c.score == pytest.approx(r["score"], abs=1e-9) and c.link_density == pytest.approx(r["link_density"])
            seen += 1
    assert seen == len(nodes) > 1000


def test_choice_equals_the_extraction(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    best = {r["page_id"]: r for r in S.chosen(S.density_candidates(P._scored(extract.page_nodes(pages)))).collect()}
    for page in pages.collect():
        e = extract.Extraction(page["html"], page["url"])
        found = sorted((c for c in (e.measured(i) for i in e.n.elements() if e.page.tag[i] in S.DENSE) if c.score > 0), key=lambda c: -c.score)
        if found:
            chosen, margin = e.choose(found)
            assert best[page["page_id"]]["margin"] == pytest.approx(margin)
            assert len(chosen) > 1 or best[page["page_id"]]["node"] == chosen[0].node


def test_no_candidate_is_trusted_little():
    r = extract.extract_chapter("<body><div>only nineteen chars</div></body>")
    assert r["mode"] == "none" and r["content"] == "only nineteen chars" and r["confidence"] == 0.017


def test_hidden_text_counts_for_the_page():
    text = "<p>" + "A sentence of the story, told in plain words. " * 20 + "</p>"
    plain = extract.extract_chapter(f"<body><div id=x>{text}</div></body>")["confidence"]
    hidden = extract.extract_chapter(f"<body><div id=x>{text}</div><form>{'some words ' * 150}</form></body>")["confidence"]
    assert hidden > plain  # the share of the page falls from all of it towards a third
    assert extract.Extraction(f"<body>{text}<script>{'x' * 500}</script></body>").page_chars == extract.Extraction(f"<body>{text}</body>").page_chars


def test_merged_blocks_go_by_line_then_score():
    block = lambda k, n: f"<div class=c{k}><p>{f'Block {k} has its words and more of them here. ' * n}</p></div>"
    one_line = extract.extract_chapter("<body><section>" + block(1, 4) + block(2, 6) + block(3, 5) + "</section></body>")
    lines = extract.extract_chapter("<body><section>\n" + "\n".join([block(1, 4), block(2, 6), block(3, 5)]) + "</section></body>")
    for r in (one_line, lines):
        assert r["mode"] in ("single", "merged") and all(f"Block {k}" in r["content"] for k in (1, 2, 3))


def test_titles_lose_sites_and_join_parts():
    e = extract.Extraction("<body></body>", "https://www.wolfden.example/1")
    assert e.clean_title("Chapter 1 | Part two - Wolfden") == "Chapter 1 - Part two"
    assert e.clean_title("Read | Chapter 9: The Hill") == "Chapter 9 - The Hill"
    assert e.clean_title("Chapter 1 | Part two") == "Chapter 1 | Part two"
    assert e.clean_title("Novels | Best Novels") == "Best Novels"


def test_leaves_count_content_characters():
    e = extract.Extraction("<body><section><div>" + "é" * 30 + "</div></section><article><p>" + "word " * 30 + "</p></article></body>")
    tags = {e.page.tag[i] for i in e.leaf_scores()}
    assert "article" in tags and "section" not in tags


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")
    assert extract.page_nodes(pages).count() == 0 and S.chosen(S.density_candidates(P._scored(extract.page_nodes(pages)))).count() == 0
    assert S.handed_up(P._leaves(extract.page_nodes(pages).withColumn("marks", F.lit(0))), extract.page_nodes(pages)).count() == 0
