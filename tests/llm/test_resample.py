"""Importance resampling against plain Python, and its defined cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftmill.llm import resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hashed(text):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def expected(docs, target):
    rows = [(doc_id, *hashed(text)) for doc_id, text in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for text in target for b in hashed(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    out = []
    for doc_id, n, found in rows:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((i for i, r in enumerate(out) if r[4] >= 20), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    rank = {i: at + 1 for at, i in enumerate(order[: 5 * len(order) // 100])}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def compared(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


ODD = [None, "", " .,-", "a", "A b", "a b c", "É é ÉÉ x2", "日本語 と 日本語", "x" * 5000, "word " * 9000, "\x00a\x7fb~c", "p q r " * 7, "p q r " * 6 + "p q", "p q r " * 6 + "p"]


def test_equal_to_plain_python(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0").collect()]
    rows += [(100_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id but words " * 9)] * 2 + [(rows[0][0], rows[0][1])] * 60
    target = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, weight int, buckets string, n_words int")
    got = resample.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, rank int")).collect()
    compared(got, expected(rows, target))
    assert sum(r["rank"] is not None for r in got) > 10


def test_copies_of_one_document_take_ranks_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e " * 5)] * 400, "doc_id long, text string")
    got = resample.resample(docs, docs.select("text").limit(1)).collect()
    assert len(got) == 400 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))


@pytest.mark.parametrize("docs,target", [([], []), ([], ["a b"]), ([(1, "a b " * 30), (2, None)], [])])
def test_empty_tables(spark, docs, target):
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    compared(got, expected(docs, target))


def test_rows_like_the_target_are_drawn(spark):
    """Documents that share the target's words outweigh others by far more than the noise."""
    rows = [(i, ("apple pear plum fig " if i % 20 == 0 else "iron lead zinc gold ") * 10) for i in range(1000)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("pear plum fig apple pear",)] * 40, "text string")).collect()
    assert {r["doc_id"] for r in got if r["rank"]} == set(range(0, 1000, 20))


def test_only_totals_are_shuffled(spark):
    """One row a bucket and task at most leaves the scans; the gains are one literal."""
    docs = spark.createDataFrame([(i, "a b c d " * 50) for i in range(2000)], "doc_id long, text string").repartition(4)
    found = resample.features(docs, ("doc_id",))
    counts = found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning(bucket") > 0 and plan.count("HashAggregate") == 2
    scored = found.select(F.aggregate("buckets", F.lit(0).cast("long"), lambda t, b: t + F.element_at(resample.gain_literal(list(range(10_000))), b + 1)))
    assert "element_at([0,1,2,3,4" in scored._jdf.queryExecution().optimizedPlan().toString()
