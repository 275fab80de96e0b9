"""Decontamination against all windows of all items, one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftmill.llm import decontam


def plain_find(items, words, k=5):
    """Each item's best window by exact similarity, over every window."""
    out = []
    for name, text in items:
        own = text.lower().split()
        n = min(k, len(own))
        grams = Counter(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
        m = min(len(own) - n + 1, len(words) - n + 1)
        best = (0.0, 0)
        for w in range(len(words) - n + 1 - m + 1 if m > 0 else 0):
            window = Counter(tuple(words[w + i : w + i + n]) for i in range(m))
            s = (window & grams).total() / (m * grams.total()) ** 0.5
            if s > best[0]:
                best = (s, w)
        if best[0] >= 0.8:
            out.append((name, pytest.approx(best[0]), best[1]))
    return out


@pytest.mark.parametrize("radius", [0, 15, 63])
def test_no_window_is_lost(monkeypatch, radius):
    monkeypatch.setattr(decontam, "RADIUS", radius)
    rng, planted = np.random.default_rng(8), 0
    for _ in range(150):
        word = lambda: f"w{rng.integers(0, 40)}" if rng.random() < 0.3 else f"u{rng.integers(0, 10**9)}"  # noqa: E731, B023
        items = [(i, " ".join(word() for _ in range(rng.integers(1, 70)))) for i in range(5)]
        items.append((9, items[0][1]))
        words = [word() for _ in range(15)]
        for _, text in (items[0], items[1], items[0]):  # 1 to 10 % of the words changed
            own = text.split()
            for at in rng.integers(0, len(own), max(1, int(len(own) * rng.uniform(0.01, 0.1)))):
                own[at] = word()
            words += own + [word() for _ in range(rng.integers(0, 12))]
        want = plain_find(items, words)
        planted += len(want)
        assert decontam.Items(items).find(decontam.word_hashes(pa.array([" ".join(words)]))[1]) == want
    assert planted > 150


def test_clashing_columns(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, "none of it"), (None, item)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("__found", "k0", "item_id", "similarity", "start_word")})
    items = spark.createDataFrame([(5, item, 1)], "item_id long, text string, doc_id long")
    assert sorted((r["doc_id"] or 0, r["start_word"]) for r in decontam.contaminations(docs, items).collect()) == [(0, 0), (1, 2)]
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
