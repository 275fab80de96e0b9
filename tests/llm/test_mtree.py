"""M-tree search against all products, its bounds at work, and odd vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmill.llm import mtree


def brute(rows, every=50, k=5, scale=256.0):
    """(query_id, rank, vec_id, score) from the definition, in whole numbers of any size."""
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=np.float64) * (scale or 1)).all():
            whole[i, tuple(int(np.floor(x * scale)) if scale else int(x) for x in v)] = None
    out = []
    for q, v in whole:
        if q % every == 0:
            score = lambda y: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, y))))  # noqa: E731, B023
            near = sorted({(-score(y), i) for i, y in whole if i != q and len(y) == len(v)})[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def found(spark, rows, schema="vec_id long, embedding array<double>", **options):
    return sorted(tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, schema), **options).collect())


@pytest.fixture
def small(monkeypatch):
    """Trees of several levels, several shards a pivot, several blocks and groups of them, on few rows."""
    for name, value in (("PAGE", 8), ("FANOUT", 4), ("SHARD", 60), ("BLOCK", 10), ("BLOCKS", 2)):
        monkeypatch.setattr(mtree, name, value)


@pytest.mark.parametrize("kind", ["clustered", "random", "hot", "outlier", "ties"])
def test_equal_to_all_products(spark, small, kind):
    rng, n = np.random.default_rng(3), 900
    x = rng.normal(size=(n, 6))
    if kind == "clustered":
        x = 9 * rng.normal(size=(12, 6))[rng.integers(0, 12, n)] + 0.1 * x
    elif kind == "hot":
        x[: n // 2] = x[0]
    elif kind == "outlier":
        x[77] *= 1e6
    elif kind == "ties":
        x = rng.integers(-1, 2, size=(n, 6)) / 256
    ids = rng.permutation(n).tolist()
    rows = list(zip(ids, x.tolist()))
    assert found(spark, rows, every=10) == brute(rows, every=10)


def test_given_vectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark, small):
    """Nulls, non-finite components, lengths, repeated rows, one id with two vectors, scores beyond 64 bits, clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(120)]
    rows += [(200, None), (None, [1.0, 2.0, 3.0]), (210, [1.0, None, 2.0]), (220, [float("nan"), 0.0, 1.0]), (230, [1.0, float("inf"), 1.0]), (240, [1e308, 1.0, 1.0])]
    rows += [(250, [1.0, 2.0]), (251, [3.0, 1.0]), (252, [-1.0, 0.0]), (260, []), (261, []), (270, [0.0, 0.0, 0.0])]
    rows += [(300, [1e12, -1e12, 5.0]), (301, [1e300, 1.0, 1.0]), (302, [-1e200, 1e200, 1e9]), (303, [3e13, 2e13, 1.0])]
    rows += [rows[0]] * 40 + [rows[7]] * 40 + [(20, [9.0, 9.0, 9.0])]
    more = [(*r, 1, "x") for r in rows]
    got = found(spark, more, "vec_id long, embedding array<double>, score int, pivot string", every=10)
    assert got == brute(rows, every=10)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [-1.0])]) == [(0, 1, 1, 512 * 256), (0, 2, 2, -256 * 256)]


def test_whole_numbered_vectors(spark):
    rows = [(i, [i, 2 * i % 7]) for i in range(60)]
    assert found(spark, rows, "vec_id long, embedding array<long>", scale=None, every=7) == brute(rows, every=7, scale=None)


def test_bounds_save_products(spark):
    """Clustered vectors: the stored bounds spare most of all products; 40,000 vectors, a third in one cluster."""
    rng, n = np.random.default_rng(4), 40_000
    centres = rng.normal(size=(200, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 200, n))] + 0.02 * rng.normal(size=(n, 16))
    told = []
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in mtree.top_k(df, told=told.append).collect())
    whole = np.floor(256 * x)
    want = []
    for q in range(0, n, 50):
        s = whole @ whole[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[:5]
        want += [(q, r + 1, int(i), int(s[i])) for r, i in enumerate(best)]
    assert got == want
    assert told[0]["products"] < 0.5 * told[0]["pairs"] and told[0]["pairs"] <= len(range(0, n, 50)) * n


vectors = st.integers(1, 5).flatmap(lambda d: st.lists(st.lists(st.integers(-300, 300), min_size=d, max_size=d), min_size=1, max_size=150))


@settings(max_examples=150, deadline=None)
@given(vectors, st.randoms())
def test_tree_covers_and_searches(rows, random):
    """Radii cover, parent distances are those, every row stands on one page, and a search equals sorting."""
    page, mtree.PAGE = mtree.PAGE, 4
    try:
        x, ids = np.array(rows, dtype=np.float64), np.array(random.sample(range(1000), len(rows)))
        shard = mtree.Shard.unpack(mtree.Shard.build(x, ids, 3).pack())
        tree = shard.tree
        assert sorted(tree.order.tolist()) == list(range(len(shard.vectors)))

        def below(node):
            part = slice(tree.first[node], tree.last[node])
            if tree.leaf[node]:
                assert np.allclose(tree.to_page[part], np.linalg.norm(shard.vectors[tree.order[part]] - shard.vectors[tree.routing[node]], axis=1))
                return tree.order[part].tolist()
            held = []
            for child in range(part.start, part.stop):
                assert np.isclose(tree.to_parent[child], np.linalg.norm(shard.vectors[tree.routing[child]] - shard.vectors[tree.routing[node]]))
                held += below(child)
            assert np.linalg.norm(shard.vectors[held] - shard.vectors[tree.routing[node]], axis=1).max() <= tree.radius[node] * (1 + 1e-9)
            return held

        below(0)
        best, at, _ = shard.search(x, ids, np.full(len(x), mtree.LOW), 3)
        _, query, _, found_ids, scores = mtree._found(shard, 3, 0, ids, best, at)
        for i in range(len(x)):
            got = sorted((-int(s), int(v)) for q, v, s in zip(query, found_ids, scores) if q == i)[:3]
            assert got == sorted((-int(x[i] @ x[j]), int(ids[j])) for j in range(len(x)) if j != i)[:3]
    finally:
        mtree.PAGE = page
