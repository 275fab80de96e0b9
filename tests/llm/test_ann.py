"""NN-descent against brute force where it compares few of all pairs, and its parts."""

import numpy as np
from pyspark.sql import functions as F

from weftmill.llm import ann


def test_few_compared_pairs_find_most_neighbours(spark, monkeypatch):
    for name, value in (("DEGREE", 20), ("REVERSE", 12), ("POOL", 64)):
        monkeypatch.setattr(ann, name, value)
    rng, n = np.random.default_rng(4), 30_000
    centres = rng.normal(size=(300, 24))
    of = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 300, n))  # one cluster holds a third of all rows
    x = (centres[of] + 0.6 * rng.normal(size=(n, 24))).astype(np.float32) * (1 + rng.random((n, 1)).astype(np.float32))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    told = []
    found = ann.search(df, every=100, told=told.append).toPandas()
    hit = 0
    for q, g in found.groupby("query_id"):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:20].tolist()) & set(g.vec_id))
    assert len(found) == 20 * n / 100 and hit >= 0.9 * len(found)
    assert told[0]["nodes"] == n and told[0]["compared"] < 0.1 * n * (n - 1) / 2


def test_pairs_of_a_node_are_bounded(spark):
    """A node that all others list brings together no more than its own list and REVERSE others."""
    rng, n = np.random.default_rng(6), 3000
    x = rng.normal(size=(n, 8))
    x[0] = 0.01  # near the middle of all
    df = spark.createDataFrame([(i, (v / np.linalg.norm(v) if i else v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    told = []
    ann.search(df, every=500, told=told.append).count()
    most = (ann.DEGREE + ann.REVERSE) ** 2 / 2
    assert told[0]["compared"] <= n * (ann.NEAR_PIVOTS * ann.START + ann.ROUNDS * most)


def test_offers():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 30, 2000), rng.integers(0, 30, 2000)
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    table = rng.normal(size=(30, 30)).astype(np.float32)
    sims, least = table[a, b], rng.normal(size=30).astype(np.float32)
    own, other, got = ann._offers(a, b, sims, least, 5)
    for i in range(30):
        pairs = {(s, j) for p, q, s in zip(a.tolist(), b.tolist(), sims.tolist()) for j, me in ((q, p), (p, q)) if me == i and s > least[i]}
        assert list(zip(got[own == i].tolist(), other[own == i].tolist())) == sorted(pairs, key=lambda x: (-x[0], x[1]))[:5]


def test_lengths_are_searched_apart_and_doubles_kept(spark):
    rows = [(i, [1.0 + i * 1e-12, 1.0]) for i in range(0, 60)] + [(i, [float(i), 1.0, 2.0]) for i in range(60, 120)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).toPandas()
    assert set(found.query_id) == {0, 20, 40, 60, 80, 100}
    for q, g in found.sort_values("rank").groupby("query_id"):
        own = dict(rows)[q]
        want = sorted(((float(np.dot(own, v)), i) for i, v in rows if i != q and len(v) == len(own)), key=lambda x: (-x[0], x[1]))[:5]
        assert list(zip(g.score, g.vec_id)) == want


def test_exact_pass_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "EXACT", 3)
    x = np.random.default_rng(2).normal(size=(50, 4)).astype(np.float32)
    nodes = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, vec binary")
    got = ann.exact_pass(nodes.where(F.col("node") % 7 == 0), nodes, 4, 3).toPandas()
    flat = x.copy()
    flat[:, 3] = 0
    for i in range(0, 50, 7):
        s = x @ flat[i]
        s[i] = -9
        assert set(got[got.node == i].nbr) == set(np.argsort(-s)[:3].tolist())


def recall(spark, x, every, told=None, k=20):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = ann.search(df, k, every, told).toPandas()
    assert len(found) == k * -(-len(x) // every)
    hit = 0
    for q, g in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s, kind="stable")[:k].tolist()) & set(g.vec_id))
        assert g.sort_values("rank").score.is_monotonic_decreasing and np.allclose(g.score, s[g.vec_id])
    return hit / len(found)


def test_norms_may_differ(spark, monkeypatch):
    """One far outlier, and norms from 1 to 10^9, where bands are large enough for graphs of their own."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 16))
    x[77] *= 1e6
    told = []
    assert recall(spark, x, 100, told.append) >= 0.97
    assert [t["nodes"] for t in told] == [3999]
    monkeypatch.setattr(ann, "SMALL", 100)
    x = rng.normal(size=(3000, 16)) * 10 ** rng.uniform(0, 9, size=(3000, 1))
    x[:5] *= 1e100
    assert recall(spark, x, 150) >= 0.97


def test_bands():
    assert ann.bands({}) == [] and ann.bands({3: 7}) == [(3, 3, 7)]
    assert ann.bands({80: 1, 0: 5, -31: 6, -32: 7, -70: 1}) == [(80, 80, 1), (-31, 0, 11), (-32, -32, 7), (-70, -70, 1)]


def test_searches_that_are_cut_off_are_finished(spark, monkeypatch):
    monkeypatch.setattr(ann, "STEPS", 1)
    assert recall(spark, np.random.default_rng(9).normal(size=(1500, 12)), 50) == 1.0


def test_nodes_meet_their_lists_once(spark):
    """The round's left join is one of nodes with lists, not of all (block, node) that are sent."""
    nodes = spark.createDataFrame([(i, i % 2, bytes(4)) for i in range(6)], "node long, home long, vec binary")
    graph = spark.createDataFrame([(i, i % 2, i / 2, b"") for i in range(5)], ann.GRAPH)
    needed = spark.createDataFrame([(b, i) for b in range(9) for i in range(6)], "block long, node long")
    sent = ann._sent(needed, nodes, graph)
    assert sorted(map(tuple, sent.drop("vec").collect())) == [(b, i, i % 2, i / 2 if i < 5 else float("-inf")) for b in range(9) for i in range(6)]
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1 and plan.index("Join Inner") < plan.index("Join LeftOuter")
