"""Periodic runs against a brute-force search, and the query's digests against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmill.llm import periodic


def brute(ids, least=6, times=4):
    """Runs by their definition: for each lag each maximal stretch, unless a shorter period fits it."""
    n, out = len(ids), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(ids[t] == ids[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def repeats(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=60))
    for _ in range(draw(st.integers(0, 3))):
        unit = draw(st.lists(st.integers(0, 3), min_size=1, max_size=7))
        words += (unit * 9)[: draw(st.integers(1, 60))]
    return words


@settings(max_examples=1500, deadline=None)
@given(st.composite(repeats)())
def test_runs_equal_their_definition(ids):
    numbers = {}
    got = periodic.find_runs(np.array([numbers.setdefault(x, len(numbers)) for x in ids], dtype=np.int64))
    assert got == brute(ids)


@settings(max_examples=300, deadline=None)
@given(st.composite(repeats)(), st.integers(2, 9), st.integers(2, 5))
def test_other_limits(ids, least, times):
    assert periodic.find_runs(np.array(ids, dtype=np.int64), least, times) == brute(ids, least, times)


def test_bad_limits():
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(9, dtype=np.int64), 6, 1)


def test_many_words():
    """More distinct words than the first planes tell apart, and a text of one word."""
    ids = np.concatenate([np.arange(70_000), np.tile(np.arange(1000) + 100_000, 5), np.arange(10)])
    assert periodic.find_runs(ids) == [(70_000, 5000, 1000)]
    assert periodic.find_runs(np.zeros(5000, dtype=np.int64)) == [(0, 5000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32((b"" if doc_id is None else str(doc_id).encode()))
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *longest, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def query(docs):
    return periodic.digests(periodic.collapse_runs(periodic.with_planted(docs)))


def test_query_equals_brute_force(spark):
    """Short given texts, odd ones, null ids and texts, repeated rows, every remainder of the id's hash, clashing names."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 4000").collect()]
    odd = [None, "", " \t\n\x0b\x0c\r ", "a", "a a a a a", "a a a a a a", "x y " * 8, "A a " * 9, "\x1c b   " * 9, "日本 語 " * 40, "a b c d e " * 30 + "f " + "f g " * 12]
    rows += [(1_000_000 + 37 * i + j, t) for i, t in enumerate(odd) for j in range(37)] + [(None, t) for t in odd] + [(7, "b c " * 20)] * 5
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, runs string, k0 int")
    got = [tuple(r) for r in query(docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 100


def test_output_of_the_operator(spark):
    docs = spark.createDataFrame([("a  b " * 4 + "\nc", 5)], "text string, collapsed int")
    (row,) = periodic.collapse_runs(docs, ("text",)).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 8, 2)] and row["collapsed"] == "a b c" and row["text"] == docs.first()["text"]


def test_empty_table(spark):
    assert query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
