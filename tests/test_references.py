"""Queries over pages with references that are cut off, against their SQL, and confidences that lie between two thousandths."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weftmill import plans
from weftmill.functions import text as T
from weftmill.operators import extract as E

CUT = ["Rain &amp;&amp", "Rain &quot;&quot", "Rain &am", "Rain &a", "Rain &", "Rain &amp; on &copy"]
QUERIES = ["extract_chapter", "page_node_scores", "page_tree", "page_chapters", "page_features", "page_headings", "page_titles", "page_lines", "page_candidates", "page_choice", "plain_chapters"]


def page(title: str, letters: int = 90, key: int = 0) -> str:
    """A page in the form of the tables'."""
    body = "".join(f"<p>{title}; on the town it rained and rained, {'a' * letters}.</p>" for _ in range(4))
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><script>track({key});</script></head><body><nav><ul><li><a href="/a">the a</a></li></ul></nav><article><h1>{title}</h1>{body}</article><footer>&copy; x &middot; y</footer></body></html>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("cut")
    titles = [t for t in CUT for _ in range(7)]  # each kind meets each change that the queries make to pages
    html = [page(t, 90, k) for k, t in enumerate(titles)]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": ["https://rain.example/1"] * len(html), "html": html}), out / "pages.parquet")
    return str(out)


@pytest.mark.parametrize("name", QUERIES)
def test_cut_references(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    found = plans.queries()[name](spark, folder)
    picked = ", ".join(f'"{c}"' for c in found.columns)
    want = db.sql(f"SELECT {picked} FROM ({plans.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in found.collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


def test_what_a_reference_is(spark):
    said = {"a &amp b": "a &amp;amp b", "&amp;": "&amp;", "&#39;&#x1F;": "&#39;&#x1F;", "&#39 &#x;": "&amp;#39 &amp;#x;", "&": "&amp;", "&;": "&amp;;", "&amp&amp;": "&amp;amp&amp;", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in said], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.closed_references(F.col("t"))).collect()} == said


def test_extraction_itself_reads_html():
    assert E.extract_chapter(page("Rain &amp;&amp"))["title"] == "Rain &&"


def test_thousandths():
    assert [E.rounded(x) for x in (0.0, 0.8885, 0.8125, 0.0005, 0.00049999999999999, 0.2, 0.95)] == [0.0, 0.889, 0.813, 0.001, 0.0, 0.2, 0.95]
    assert math.isclose(E.rounded(0.1234), 0.123)
