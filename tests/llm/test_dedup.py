"""The near-duplicate stage: one row of each group, hot fingerprints and ids, no text in a shuffle."""

from collections import Counter

from pyspark.sql import functions as F

from weftmill.llm import simhash


def test_hot_groups(spark):
    rows = [(i, "" if i % 2 else f"document {i} with words of its own {i * 7} and {i * 13}") for i in range(400)]
    rows += [(7, f"the seventh again {k} and {k * k} other") for k in range(300)] + [(None, None)] * 50 + [(None, "without any id")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("row", "fp", "c0", "first", "root")})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    want, prints = {}, {}
    groups = {r["fingerprint"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    for i, t in rows:
        fp = f"{simhash.fingerprint(t):016x}"
        prints.setdefault(groups[fp] if groups[fp] is not None else fp, []).append((i is None, i or 0, t or ""))
    assert set(got.values()) == {1} and len(got) >= len(prints)
    assert all(any((None if n else i, t) in got for n, i, t in members) for members in prints.values())
    assert got[(1, "")] == 1 and got[(None, "without any id")] == 1 and (None, "") not in got


def test_texts_stay_where_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
