"""Token counts of long pre-tokens, main text of broken pages and what an article holds, storage."""

import os
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmill.llm import common, htmltext, queries, tokencount


@pytest.fixture(scope="session")
def counter():
    return tokencount.MergeCounter(queries.tokenizer("piece_bpe_32k.model"))


@pytest.fixture(scope="session")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


PARTS = st.sampled_from(["a", "b", "th", "the", "tion", "ing", "un", "e", "s", "x", "zz", "0", "12", "é", "日", "本", ".", ",", "'", " ", "\n", "  ", "▁"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=80).map("".join), min_size=1, max_size=6))
def test_ranked_merging_equals_library(counter, library, texts):
    was, counter.known = counter.known, {"": 0}
    tokencount.LONG, held = 0, tokencount.LONG
    try:
        assert counter.count_texts(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]
    finally:
        tokencount.LONG, counter.known = held, was


def test_documents_by_ranked_merging(counter, library, spark, monkeypatch):
    monkeypatch.setattr(tokencount, "LONG", 0)
    monkeypatch.setattr(counter, "known", {"": 0})
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    glued = [t.replace(" ", "").replace("\n", "") for t in texts[:300]]
    for part in (texts, glued):
        assert counter.count_texts(pa.array(part)).tolist() == [len(library.encode(t)) for t in part]


def test_long_words_take_no_longer(counter, library):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "ab" * 100_000, "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(50_000))]
    want = [len(library.encode(t)) for t in texts]
    start = time.time()
    assert counter.count_texts(pa.array(texts)).tolist() == want
    assert time.time() - start < 5 and all(len(w) <= tokencount.LONG for w in counter.known)


FRAGMENTS = ["<![", "<![foo[", "<![CDATA[", "]]>", "<!", "<!--", "-->", "<?", "</", "<", ">", "<p>", "</p>", "<article>", "</article>", "<nav>", "</nav>", "<a href='x'>", "</a>", "<script>", "</script>", "<title>", "<select>", "<br/>", "<li>", "&", "&#x110000;", "\x00", "'", '"', " ", "word ", "text of a page that we have seen, " * 4]


@given(st.lists(st.sampled_from(FRAGMENTS), max_size=25).map("".join))
@settings(max_examples=10_000, deadline=None)
def test_no_markup_fails(html):
    text = htmltext.main_text(html)
    assert text == text.strip() and "\n\n" not in text


SENTENCE = "This is the text of the article that we have to keep, and it is long enough to be sure of it."


@pytest.mark.parametrize("mark", ["<![foo[x]]>", "<![ x>", "<![if x]>", "<!x>", "<![CDATA[x]]>"])
def test_text_after_a_bad_mark_is_kept(mark):
    assert htmltext.main_text(f"<article><p>{SENTENCE}</p>{mark}<p>After {SENTENCE}</p></article>") == f"{SENTENCE}\nAfter {SENTENCE}"


def test_an_article_loses_nothing():
    html = f"<article><p>{SENTENCE}</p><ul><li><a href=1>one</a></li><li>two</li></ul><p>Let <math><mi>x</mi> = 1</math> be <object>seen</object>.</p></article><ul><li><a href=2>more of this site</a></li></ul>"
    assert htmltext.main_text(html) == f"{SENTENCE}\none\ntwo\nLet x = 1 be seen."


def test_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_superseded_data_go(spark):
    first = common.saved(spark.range(3), "test")
    second = common.saved(first, "test", first)
    local = lambda df: df._saved_at.removeprefix("file://")
    assert not os.path.exists(local(first)) and os.path.exists(local(second)) and second.count() == 3
    common.discard(second)
    assert not os.path.exists(local(second))


def test_storage_goes_with_the_driver(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
from weftmill.llm import common, packing, queries
settings = lambda: {{r["key"]: r["value"] for r in spark.sql("SET").collect() if "warehouse" not in r["key"]}}
before = settings()
docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
assert packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json")).count() == 2
assert before == settings()
import os
assert any(x.startswith("weftmill") for x in os.listdir("{tmp_path}/shared"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=120)
    ours = lambda: [x for x in os.listdir(tmp_path / "shared") if x.startswith("weftmill")]  # noqa: E731 (Spark makes an empty folder of its own)
    for _ in range(50):
        if not ours():
            break
        time.sleep(0.2)
    assert ours() == []
