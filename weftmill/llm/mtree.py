"""Exact top-k search by inner product with M-trees: best-first over paged metric nodes, with bounds from stored distances.

Vectors are dealt to shards of bounded size around shared pivots, and each shard is an M-tree, one row of packed arrays: a
node has a routing vector, the covering radius of all below it and its distance to its parent's routing vector; a leaf
page has its vectors' distances to its own. As <q, x> <= <q, p> + |q| |x - p|, a radius bounds what a node can hold, and a
stored distance bounds that from the parent's product, before the node's own product is computed at all.

Queries come in blocks that lie near one pivot. Each block first asks one shard of its pivot, which gives every query a
least score to beat; then the pivots' reaches tell which shards may hold more, and those are asked, each by the queries
that still may gain there. So a query meets every vector, unless a bound proves that it needn't: results are exact for any
data. On nearly random vectors of many components no bound helps, and the work is that of all products, done page by page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, hashed_share, saved

#: Vectors of a leaf page, entries of an inner node, vectors of a shard, queries of a block, blocks that meet a shard in one task.
PAGE, FANOUT, SHARD, BLOCK, BLOCKS = 64, 16, 8192, 1024, 8
#: Most pivots, and most bytes of a shard's vectors and of all pivots (the bound of what is broadcast).
PIVOTS, BYTES = 4096, 16 << 20
LOW, HIGH = -(1 << 63), (1 << 63) - 1
NONE = HIGH  # no id


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered vectors, exact; beyond 64 bits they stop at the ends of a long."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), dtype=np.int64)
    most = np.abs(q).max() * np.abs(v).max() * q.shape[1]
    if most < 2**53:  # every partial sum is a whole number that a double holds
        return (q @ v.T).astype(np.int64)
    if most < 2**63:
        return q.astype(np.int64) @ v.astype(np.int64).T
    a, b = [[int(x) for x in row] for row in q], [[int(x) for x in row] for row in v]
    return np.array([[max(LOW, min(HIGH, sum(map(int.__mul__, x, y)))) for y in b] for x in a], dtype=np.int64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows; components near the end of the doubles don't overflow."""
    if not x.size:
        return np.zeros(len(x))
    most = np.maximum(np.abs(x).max(axis=1), 1e-300)
    with np.errstate(over="ignore"):
        return most * np.sqrt(np.square(x / most[:, None]).sum(axis=1))


def apart(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(norms(x - centre), nan=np.inf, posinf=np.inf)


class Tree:
    """An M-tree over the rows of x. Nodes are numbered level by level from the root; a node's entries follow one another.

    order: the rows, each leaf page's together; routing: row of each node's routing vector; radius, to_parent, first, last;
    leaf: whether first to last are places in order (of a page) or nodes; to_page: distance of each place to its page's.
    """

    FIELDS = ("order", "routing", "radius", "to_parent", "first", "last", "leaf", "to_page")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        routing, radius, to_parent, first, last, leaf, order, to_page = ([] for _ in range(8))
        waiting = [np.arange(len(x))]  # rows of the nodes not yet made, level by level
        parents, at, placed = [-1], 0, 0

        while at < len(waiting):
            rows = waiting[at]
            waiting[at] = None
            mean = x[rows].mean(axis=0) if x.shape[1] else x[0]
            middle = rows[int(np.argmin(apart(x[rows], mean)))]
            away = apart(x[rows], x[middle])
            routing.append(middle)
            radius.append(away.max())
            to_parent.append(0.0 if parents[at] < 0 else apart(x[middle][None], x[routing[parents[at]]])[0])
            if len(rows) <= PAGE:
                leaf.append(True)
                first.append(placed)
                order.append(rows)
                to_page.append(away)
                placed += len(rows)
                last.append(placed)
            else:
                leaf.append(False)
                parts = cls._parts(x, rows)
                first.append(len(waiting))
                waiting += parts
                parents += [at] * len(parts)
                last.append(len(waiting))
            at += 1
        as_int = lambda a: np.array(a, dtype=np.int64)
        return cls(order=np.concatenate(order), routing=as_int(routing), radius=np.array(radius), to_parent=np.array(to_parent), first=as_int(first), last=as_int(last), leaf=np.array(leaf), to_page=np.concatenate(to_page))

    @staticmethod
    def _parts(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """The rows in up to FANOUT parts, none much larger than the others: the largest is halved between two far rows of it."""
        parts = [rows]
        while len(parts) < FANOUT:
            parts.sort(key=len)
            if len(parts[-1]) <= PAGE:
                break
            own = parts.pop()
            one = x[own[int(np.argmax(apart(x[own], x[own[0]])))]]
            two = x[own[int(np.argmax(apart(x[own], one)))]]
            with np.errstate(over="ignore", invalid="ignore"):
                side = np.nan_to_num(apart(x[own], one) - apart(x[own], two))
            ranked = own[np.argsort(side, kind="stable")]
            parts += [ranked[: len(own) // 2], ranked[len(own) // 2 :]]
        return parts


class Shard:
    """Different vectors (rows of whole numbers), the k + 1 smallest ids of each (NONE where it has fewer), and their tree."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, tree: Tree):
        self.vectors, self.ids, self.tree = vectors, ids, tree

    @classmethod
    def build(cls, vectors: np.ndarray, ids: np.ndarray, k: int) -> Shard:
        """Of (id, vector) rows, repeated ones of which count once."""
        if vectors.shape[1]:
            different, of = np.unique(vectors, axis=0, return_inverse=True)
        else:
            different, of = vectors[:1], np.zeros(len(vectors), dtype=np.int64)
        of, rows = of.ravel(), np.lexsort((ids, of.ravel()))
        of, ids = of[rows], ids[rows]
        new = np.ones(len(of), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
        of, ids = of[new], ids[new]
        starts = np.searchsorted(of, np.arange(len(different)))
        nth = np.arange(len(of)) - starts[of]
        held = np.full((len(different), k + 1), NONE, dtype=np.int64)
        held[of[nth <= k], nth[nth <= k]] = ids[nth <= k]
        tree = Tree.build(different)
        return cls(different, held, tree)

    def pack(self) -> bytes:
        import io

        out = io.BytesIO()
        np.savez(out, vectors=_small(self.vectors), ids=self.ids, **{f: getattr(self.tree, f) for f in Tree.FIELDS})
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Shard:
        import io

        with np.load(io.BytesIO(raw)) as got:
            return cls(got["vectors"].astype(np.float64), got["ids"], Tree(**{f: got[f] for f in Tree.FIELDS}))

    def search(self, q: np.ndarray, own: np.ndarray, beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(k best scores, their vectors' rows or -1, number of products) for each query; own: its id, beat: a score that
        what it needs reaches at least. Ordered by score, then by the smallest id that isn't the query's own."""
        tree, n = self.tree, len(q)
        best, rows, names = np.full((n, k), LOW, dtype=np.int64), np.full((n, k), -1), np.full((n, k), NONE, dtype=np.int64)
        products, length = 0, norms(q)
        slack = 1e-9 * length * (1.0 + norms(self.vectors).max(initial=0.0))  # more than the rounding of any bound
        with np.errstate(over="ignore", invalid="ignore"):
            def reach(near: np.ndarray, far: np.ndarray, own: np.ndarray | slice = slice(None)) -> np.ndarray:
                """The most that the products of queries `own` can be at this distance from a vector of known product."""
                return np.nan_to_num(near + np.multiply.outer(length[own], far) + slack[own][:, None], nan=np.inf, neginf=LOW)

            bound, score = np.full((n, len(tree.routing)), -np.inf), np.zeros((n, len(tree.routing)))
            score[:, 0] = inner(q, self.vectors[tree.routing[:1]])[:, 0]
            products += n
            bound[:, :1] = reach(score[:, :1], tree.radius[:1])
            at_once = 1  # best node first; more of the best at a time as the scores to beat settle
            while True:
                limit = np.maximum(beat, best[:, -1]).astype(np.float64)
                some = min(at_once, bound.shape[1])
                top = np.argpartition(-bound, some - 1, axis=1)[:, :some]
                asked = np.take_along_axis(bound, top, axis=1)
                who, which = np.nonzero((asked >= limit[:, None]) & (asked > -np.inf))
                if not len(who):  # no query's best bound reaches its limit
                    return best, rows, products
                node = top[who, which]
                in_order = np.argsort(node, kind="stable")
                who, node = who[in_order], node[in_order]
                cuts = np.flatnonzero(np.diff(node)) + 1
                for mine, at in zip(np.split(who, cuts), node[np.concatenate([[0], cuts])].tolist()):
                    limit = np.maximum(beat[mine], best[mine, -1]).astype(np.float64)[:, None]
                    bound[mine, at] = -np.inf
                    part = slice(tree.first[at], tree.last[at])
                    near = score[mine, at][:, None]
                    if not tree.leaf[at]:
                        cheap = reach(near, tree.to_parent[part] + tree.radius[part], mine)
                        need = cheap >= limit
                        entries = np.flatnonzero(need.any(axis=0))
                        if not len(entries):
                            continue
                        children = tree.first[at] + entries
                        got = inner(q[mine], self.vectors[tree.routing[children]])
                        products += got.size
                        score[np.ix_(mine, children)] = got
                        bound[np.ix_(mine, children)] = np.where(need[:, entries], np.minimum(cheap[:, entries], reach(got, tree.radius[children], mine)), -np.inf)
                        continue
                    places = np.flatnonzero((reach(near, tree.to_page[part], mine) >= limit).any(axis=0))
                    if not len(places):
                        continue
                    page = tree.order[part][places]
                    got = inner(q[mine], self.vectors[page])
                    products += got.size
                    ids = self.ids[page]
                    name = np.where(ids[None, :, 0] == own[mine][:, None], ids[None, :, 1], ids[None, :, 0])
                    fits = (got >= np.maximum(beat[mine], best[mine, -1])[:, None]) & (name != NONE)
                    some_fit = fits.any(axis=1)
                    if not some_fit.any():
                        continue
                    mine, got, name, fits = mine[some_fit], got[some_fit], name[some_fit], fits[some_fit]
                    all_scores = np.concatenate([best[mine], np.where(fits, got, LOW)], axis=1)
                    all_names = np.concatenate([names[mine], np.where(fits, name, NONE)], axis=1)
                    all_rows = np.concatenate([rows[mine], np.where(fits, page[None, :], -1)], axis=1)
                    first = np.lexsort((all_names, np.invert(all_scores), all_rows < 0), axis=1)[:, :k]  # ~s falls as s grows, for every long
                    best[mine], names[mine], rows[mine] = (np.take_along_axis(a, first, axis=1) for a in (all_scores, all_names, all_rows))
                at_once *= 2


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    low, high = x.min(initial=0), x.max(initial=0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x


def _found(shard: Shard, k: int, number: int, own: np.ndarray, best: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Columns (block, query, query_id, vec_id, score) of the search's result: every id of each found vector but the query's own."""
    at, nth = np.nonzero(rows >= 0)
    ids = shard.ids[rows[at, nth]]
    i, j = np.nonzero((ids != NONE) & (ids != own[at][:, None]))
    return [np.full(len(i), number), at[i], own[at[i]], ids[i, j], best[at[i], nth[i]]]


def _deal(vectors: DataFrame, scale: float | None) -> tuple[DataFrame, object]:
    """(saved rows dim, pivot, row, vec_id, vector as packed doubles; broadcast pivots by dim)."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & real).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    count, size = rows.select(F.count("*"), F.max(F.size("embedding"))).first()
    want = int(min(PIVOTS, count // SHARD + 1, BYTES // (8 * max(size or 1, 1)) + 1)) if count else 0
    # a repeated row may be many of the sample, which then has fewer pivots: results stay the same
    sample = rows.where(hashed_share(F.col("vec_id"), min(1.0, 2.0 * want / count))).orderBy("vec_id").limit(2 * want).collect() if want > 1 else []
    pivots: dict[int, np.ndarray] = {}
    for r in sample:
        pivots.setdefault(len(r["embedding"]), []).append(r["embedding"])
    pivots = {d: np.unique(_whole(np.array(v, dtype=np.float64).reshape(-1, d), scale), axis=0)[:want] if d else np.zeros((1, 0)) for d, v in pivots.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = "dim int, pivot int, vec_id long, vector binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = np.asarray(batch.column("vec_id")), batch.column("embedding")
            sizes = np.asarray(lists.value_lengths() if len(lists) else [], dtype=np.int64)
            flat, ends = np.asarray(lists.flatten(), dtype=np.float64), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                x = _whole(flat[(ends[which] - dim)[:, None] + np.arange(dim)], scale)
                real = np.isfinite(x).all(axis=1)
                which, x, centres = which[real], x[real], shared.value.get(dim, np.zeros((1, dim)))
                least, pivot = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
                with np.errstate(over="ignore", invalid="ignore"):
                    for at in range(0, len(centres), 512):
                        c = centres[at : at + 512]
                        far = np.nan_to_num((c * c).sum(axis=1) - 2 * (x @ c.T), nan=np.inf)
                        near, low = far.argmin(axis=1), far.min(axis=1)
                        pivot, least = np.where(low < least, at + near, pivot), np.minimum(low, least)
                columns = [np.full(len(x), dim, dtype=np.int32), pivot.astype(np.int32), ids[which]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([v.tobytes() for v in x], pa.binary())], schema=out)

    return saved(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "vectors"), shared


def _whole(x: np.ndarray, scale: float | None) -> np.ndarray:
    with np.errstate(over="ignore"):
        return x if scale is None else np.floor(scale * x)


def _parts(dealt: DataFrame, most: int) -> DataFrame:
    """(dim, pivot, parts): into how many parts of about `most` rows, or of fewer bytes than BYTES, a pivot's rows go; one row for each pivot that has rows."""
    least = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(BYTES) / (8 * F.greatest("dim", F.lit(1))))))
    return dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n")).select("dim", "pivot", F.ceil(F.col("n") / least).cast("int").alias("parts"))


def _unpacked(table: pa.Table, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(table.num_rows, dim)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float | None = 256.0, told: Callable[[dict], None] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for the rows of vectors (vec_id, embedding) whose vec_id is divisible by
    `every`, the k other rows of highest inner product of floor(scale * component) (scale None: of whole-numbered
    components), ties to the smaller vec_id; all others, if they are fewer. Exact.

    Vectors that are null, hold null or components that aren't finite (scaled ones included) and rows without a vec_id
    take no part. Vectors of each length are searched among themselves. Rows that repeat id and vector count once; a row
    of the query's own id is no candidate. Scores beyond 64 bits stop at the ends of a long and rank as equal there. Empty
    vectors have the product 0. Other columns are not looked at; an empty table gives an empty result.
    told: is given the number of products and of pairs of a query and a vector.
    """
    dealt, pivots = _deal(vectors, scale)
    sc = vectors.sparkSession.sparkContext
    parts = F.broadcast(_parts(dealt, SHARD))  # at most PIVOTS rows a length
    salted = dealt.join(parts, ["dim", "pivot"]).withColumn("salt", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    shard_schema = "dim int, pivot int, salt int, reach double, shard binary"
    shard_out = arrow_schema(shard_schema)

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, pivot, salt = (x.as_py() for x in key)
        x = _unpacked(table, dim)
        centre = pivots.value.get(dim, np.zeros((1, dim)))[pivot]
        shard = Shard.build(x, np.asarray(table.column("vec_id")), k)
        return pa.Table.from_arrays([pa.array([v]) for v in (dim, pivot, salt, float(apart(x, centre).max()), shard.pack())], schema=shard_out)

    shards = saved(salted.select("dim", "pivot", "salt", "vec_id", "vector").groupBy("dim", "pivot", "salt").applyInArrow(build, shard_schema), "shards")

    asked = dealt.where(F.col("vec_id") % every == 0).groupBy("dim", "pivot", "vec_id", "vector").agg(F.min("row").alias("row"))
    blocks = saved(asked.join(F.broadcast(_parts(asked, BLOCK)), ["dim", "pivot"]).withColumn("block", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts", "row"), "queries")
    block_schema = "dim int, pivot int, block int, own binary, q binary"
    block_out = arrow_schema(block_schema)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        return pa.Table.from_arrays([pa.array([v]) for v in (*(x.as_py() for x in key), ids.tobytes(), _unpacked(table, key[0].as_py()).tobytes())], schema=block_out)

    packed = blocks.groupBy("dim", "pivot", "block").applyInArrow(pack, block_schema).withColumn("number", F.monotonically_increasing_id())
    packed = saved(packed, "blocks", blocks)

    beat_schema = "dim int, number long, own binary, q binary, beat binary"
    beat_out = arrow_schema(beat_schema)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        """What each block's queries find in one shard of their own pivot: the k-th of these scores is the least that counts."""
        got = []
        shard = Shard.unpack(left.column("shard")[0].as_py()) if left.num_rows and right.num_rows else None
        for r in right.to_pylist():
            own = np.frombuffer(r["own"], dtype=np.int64)
            q = np.frombuffer(r["q"], dtype=np.float64).reshape(len(own), r["dim"])
            best = shard.search(q, own, np.full(len(own), LOW), k)[0]
            got.append((r["dim"], r["number"], r["own"], r["q"], best[:, -1].tobytes()))
        return pa.Table.from_arrays([pa.array([g[i] for g in got], f.type) for i, f in enumerate(beat_out)], schema=beat_out)

    home = packed.join(parts, ["dim", "pivot"]).withColumn("salt", F.pmod("block", "parts").cast("int")).drop("parts")
    asked = saved(shards.groupBy("dim", "pivot", "salt").cogroup(home.groupBy("dim", "pivot", "salt")).applyInArrow(first, beat_schema), "asked", packed)

    reaches = {(r["dim"], r["pivot"]): (r["reach"], r["parts"]) for r in shards.groupBy("dim", "pivot").agg(F.max("reach").alias("reach"), F.count("*").alias("parts")).collect()}
    reached = sc.broadcast(reaches)  # one entry for each pivot that has rows
    need_schema = "dim int, number long, pivot int, salt int"
    need_out = arrow_schema(need_schema)

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards that some query of a block may gain from, by the reach of all vectors of a pivot."""
        for batch in batches:
            for r in batch.to_pylist():
                dim, beat = r["dim"], np.frombuffer(r["beat"], dtype=np.int64).astype(np.float64)
                q = np.frombuffer(r["q"], dtype=np.float64).reshape(len(beat), dim)
                which = np.array(sorted(p for d, p in reached.value if d == dim), dtype=np.int64)
                centres, length = pivots.value.get(dim, np.zeros((1, dim)))[which], norms(q)
                far = np.array([reached.value[dim, p][0] for p in which.tolist()])
                with np.errstate(over="ignore", invalid="ignore"):
                    slack = 1e-9 * length[:, None] * (1 + norms(centres) + far)
                    most = np.nan_to_num(q @ centres.T + np.multiply.outer(length, far) + slack, nan=np.inf, neginf=LOW)
                for p in which[(most >= beat[:, None]).any(axis=0)].tolist():
                    salts = reached.value[dim, p][1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(salts, v), f.type) for v, f in zip((dim, r["number"], p), need_out)] + [pa.array(np.arange(salts), pa.int32())], schema=need_out)

    needs = saved(asked.select("dim", "number", "q", "beat").mapInArrow(needed, need_schema), "needs")
    keys = ["dim", "pivot", "salt"]
    groups = needs.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCKS).cast("int").alias("groups"))
    meant = needs.join(groups, keys).withColumn("part", F.pmod(F.xxhash64("number"), "groups").cast("int")).join(asked.drop("dim"), "number")
    sent = shards.drop("reach").join(groups, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    found_schema = "block long, query long, query_id long, vec_id long, score long, products long, pairs long"
    found_out = arrow_schema(found_schema)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        shard, tables = Shard.unpack(left.column("shard")[0].as_py()) if right.num_rows else None, []
        for r in right.to_pylist():
            own = np.frombuffer(r["own"], dtype=np.int64)
            q = np.frombuffer(r["q"], dtype=np.float64).reshape(len(own), r["dim"])
            best, rows, products = shard.search(q, own, np.frombuffer(r["beat"], dtype=np.int64), k)
            columns = _found(shard, k, r["number"], own, best, rows)
            counts = [np.zeros(len(columns[0]) + 1, dtype=np.int64) for _ in range(2)]  # one row more, without an id, tells the work
            counts[0][-1], counts[1][-1] = products, len(own) * len(shard.vectors)
            told_row = [r["number"], 0, None, None, None]
            tables.append(pa.Table.from_arrays([pa.concat_arrays([pa.array(c, pa.int64()), pa.array([t], pa.int64())]) for c, t in zip(columns, told_row)] + [pa.array(c) for c in counts], schema=found_out))
        return pa.concat_tables(tables) if tables else found_out.empty_table()

    keys = [*keys, "part"]
    found = sent.groupBy(*keys).cogroup(meant.select(*keys, "number", "own", "q", "beat").groupBy(*keys)).applyInArrow(search, found_schema)
    if told is not None:
        found = saved(found, "found")
        told(found.agg(F.sum("products").alias("products"), F.sum("pairs").alias("pairs")).first().asDict())
    # an id may come from several shards, if its row is repeated
    each = found.where("query_id is not null").select("block", "query", "query_id", "vec_id", "score").distinct()
    place = F.row_number().over(Window.partitionBy("block", "query").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
