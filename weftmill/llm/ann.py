"""Approximate nearest neighbours by largest inner product: an NN-descent graph and greedy graph search, both by Spark joins.

Equal vectors are one node, with the smallest ids of its rows. Nodes of one band of norms, the largest at most 16 times
the least, make a graph; bands are searched from the largest norms down, each by the queries that may still gain there, as
no inner product exceeds the product of the norms. In a band vectors get one more component that makes all norms equal, so
that the graph's nearness is that of the inner product. A band of few nodes beside a larger one needs no graph. First lists come from small groups around shared pivots. In a
round of NN-descent each node brings its neighbours together, those in its list and some of those that list it, and each
pair of them of which one is new there is compared: they are neighbours of a neighbour to each other. What enters a list
is new in the next round; rounds end when little does. A search starts at the query's own node and keeps a pool of the
best nodes that it has met; in a step the best ones not yet visited bring in their neighbours, until all are visited. A
query whose node is in another band starts at the pivots of highest inner product. What STEPS cut off is compared with all.

A row of the graph is a node with its packed list, so that Spark handles rows of nodes and numpy the entries. Nodes are
worked on in blocks of bounded size near one pivot: a vector that several nodes of a block need is sent there once, but
only the pairs named above are compared, at most (DEGREE + REVERSE)² / 2 for each node and round, however many nodes there
are. Nothing is broadcast but the pivots and the nodes of a small band.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, discard, hashed_share, new_path, saved

#: Neighbours in a list, of those that list a node so many join it in a round, most rounds, pool of a search, nodes that a pool visits in a step, most steps.
DEGREE, REVERSE, ROUNDS, POOL, VISITS, STEPS = 40, 24, 16, 128, 96, 16
#: About so many nodes for a pivot, at most so many pivots (the bound of what is broadcast), pivots that a node starts from, about so many nodes compared at the start, nodes of a block.
PER_PIVOT, PIVOTS, NEAR_PIVOTS, START, BLOCK = 100, 4096, 3, 200, 512
#: Nodes of a part that searches ask, about.
ASKED = 4096
#: Bands of norms: at most so many octaves, told apart by so many bins an octave; a band of at most SMALL nodes, and SMALL_BYTES, beside a larger one is compared with all its queries. Pivots that a query of another band starts from.
OCTAVES, BINS, SMALL, SMALL_BYTES, ENTRIES = 4, 8, 2048, 16 << 20, 8
#: Rounds end when at most this share of the lists is new.
SETTLED = 0.07
#: Rows that a task gathers before it keeps the best of each node alone, queries compared with all rows at once.
GATHERED, EXACT = 1 << 20, 512
#: least: the sim that a new neighbour has to beat; packed: ENTRY records.
GRAPH = "node long, home long, least float, packed binary"
ENTRY = np.dtype([("nbr", "<i8"), ("home", "<i8"), ("sim", "<f4"), ("fresh", "<i4")])
#: A search's pool: ENTRY records with states for fresh, and the query's vector without its completing component.
POOLS = "node long, packed binary, vec binary"
WAITING, NEXT, VISITED = 0, 1, 2


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, and finite components that are not all zero."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"
    return x.where(ok).withColumn("embedding", F.expr("transform(embedding, x -> if(x = 0, 0D, x))"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _vectors(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a binary column of 32-bit floats."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one block each, from batches that are sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = np.asarray(batch.column("block"))
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and b > a and held[0].column("block")[0].as_py() != block[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


Rows = tuple[np.ndarray, ...]  # node, home, nbr, the home of nbr, sim, fresh


def _unpacked(batch: pa.RecordBatch | pa.Table) -> Rows:
    """The entries of a batch of GRAPH rows, in the same order."""
    packed = batch.column("packed").to_pylist()
    n = np.array([len(x) for x in packed], dtype=np.int64) // ENTRY.itemsize
    entries = np.frombuffer(b"".join(packed), dtype=ENTRY)
    return np.repeat(_column(batch, "node"), n), np.repeat(_column(batch, "home"), n), entries["nbr"], entries["home"], entries["sim"], entries["fresh"]


def _blobs(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary value of the items of data from each start to the next one."""
    stops = np.append(starts, len(data)).astype(np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(stops.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _packed(rows: Rows, size: int, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """GRAPH batches of rows that _best() has sorted."""
    node, home, *rest = rows
    if not len(node):
        return
    entries = np.empty(len(node), dtype=ENTRY)
    for name, x in zip(ENTRY.names, rest):
        entries[name] = x
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    ends = np.append(first[1:], len(node))
    least = np.where(ends - first < size, -np.inf, entries["sim"][ends - 1]).astype(np.float32)
    for at in range(0, len(first), most):
        own = slice(at, at + most)
        a, b = first[own][0], ends[own][-1]
        yield pa.RecordBatch.from_arrays([pa.array(node[first[own]]), pa.array(home[first[own]]), pa.array(least[own]), _blobs(entries[a:b], first[own] - a)], names=["node", "home", "least", "packed"])


def _best(rows: Rows, size: int) -> Rows:
    """The best `size` different neighbours of each node, by node; of rows of one pair the oldest."""
    node, _, nbr, _, sim, fresh = rows
    order = np.lexsort((fresh, nbr, node))
    node, nbr = node[order], nbr[order]
    order = order[np.concatenate([[True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])])] if len(order) else order
    order = order[np.lexsort((rows[2][order], -sim[order], rows[0][order]))]
    node = rows[0][order]
    first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else order
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    order = order[rank < size]
    return tuple(x[order] for x in rows)


def _joined(parts: list[Rows]) -> Rows:
    return tuple(np.concatenate(x) for x in zip(*parts))


class Gathered:
    """Rows of a task; a node keeps its best `size` alone, so a node that very many rows name reaches the shuffle as few."""

    def __init__(self, size: int):
        self.size, self.parts, self.n, self.kept = size, [], 0, 0

    def add(self, rows: Rows) -> None:
        self.parts.append(rows)
        self.n += len(rows[0])
        if self.n > GATHERED + 2 * self.kept:
            self.parts = [_best(_joined(self.parts), self.size)]
            self.n = self.kept = len(self.parts[0][0])

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from _packed(_best(_joined(self.parts), self.size), self.size)


def best_of(rows: DataFrame, size: int) -> DataFrame:
    """The best `size` entries of each node, of GRAPH rows; in a task one node's entries are never more than a batch's and `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: Rows | None = None
        for whole in batches:  # sorted by node; the last node's rows wait for the next batch
            for at in range(0, whole.num_rows, 5000):
                now = _unpacked(whole.slice(at, 5000))
                now = _best(now if left is None else _joined([left, now]), size)
                cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
                yield from _packed(tuple(x[:cut] for x in now), size)
                left = tuple(x[cut:] for x in now)
        if left is not None:
            yield from _packed(left, size)

    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, GRAPH)


def assign(nodes: DataFrame, count: int, dim: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """(nodes (node, vec) with home, its block, starts, the groups in which its first list is found, and part, that which searches ask for it; the pivots' nodes and vectors)."""
    spark = nodes.sparkSession
    want = max(1, min(PIVOTS, count // PER_PIVOT))
    picked = nodes.where(hashed_share(F.col("node"), 1.2 * want / count)).orderBy("node").limit(2 * want).collect() if want > 1 else []
    pivots = np.array([r["vec"] for r in picked] or [[0.0] * dim], dtype=np.float32)
    shared = spark.sparkContext.broadcast(pivots)
    coarse = np.linspace(0, len(pivots) - 1, max(1, min(len(pivots), round(count / BLOCK)))).astype(int)
    schema = "node long, vec binary, near array<int>, mid int, part long"
    out, parts_asked = arrow_schema(schema), asked_parts(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = min(NEAR_PIVOTS, len(shared.value))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch.column("vec"), dim)
                sims = x @ shared.value.T
                near = np.argsort(-sims, axis=1, kind="stable")[:, :k].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(near.ravel())).cast(out.field(2).type)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in x], pa.binary()), lists, pa.array(sims[:, coarse].argmax(axis=1), pa.int32()), pa.array(_part(_column(batch, "node"), parts_asked))], schema=out)

    found = saved(nodes.select("node", "vec").mapInArrow(run, schema), "near")

    def block(pivots: DataFrame, most: int):
        """A pivot's nodes in parts of at most about this many."""
        sizes = pivots.groupBy("p").count().collect()  # one row for each pivot
        parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["p"], max(1, -(-r["count"] // most)))])
        return lambda p: p.cast("long") * (1 << 32) + F.pmod(F.xxhash64("node", p), parts[p])

    start = block(found.select(F.explode("near").alias("p")), START)
    home = block(found.select(F.col("mid").alias("p")), BLOCK)
    entries = np.array([r["node"] for r in picked], dtype=np.int64), pivots[: len(picked)]
    return found.select("node", "vec", home(F.col("mid")).alias("home"), F.transform("near", start).alias("starts"), "part"), entries


def asked_parts(count: int) -> int:
    return -(-count // ASKED)


def _part(node: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(node, np.zeros_like(node), 0) * parts).astype(np.int64)


def _offers(a: np.ndarray, b: np.ndarray, sims: np.ndarray, least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of compared pairs (places a, b of at most 65,536) what each place is offered: the best `size` others that beat the least that its list still takes.

    A pair and its sim are one whole number, so plain sorts do: by both places to leave one row of each, then by sim.
    """
    parts = []
    bits = sims.view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # in the order of the floats
    for own, other in ((a, b), (b, a)):
        good = sims > least[own]
        parts.append(own[good].astype(np.uint64) << np.uint64(48) | other[good].astype(np.uint64) << np.uint64(32) | bits[good])
    pairs = np.sort(np.concatenate(parts))
    pairs = pairs[np.append(pairs[1:] >> np.uint64(32) != pairs[:-1] >> np.uint64(32), True)] if len(pairs) else pairs
    low = np.uint64(0xFFFFFFFF)
    own, other, bits = pairs >> np.uint64(48), pairs >> np.uint64(32) & np.uint64(0xFFFF), pairs & low
    ranked = np.sort(own << np.uint64(48) | (low - bits) << np.uint64(16) | other)
    own = (ranked >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    ranked = ranked[np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) < size]
    own, other = (ranked >> np.uint64(48)).astype(np.int64), (ranked & np.uint64(0xFFFF)).astype(np.int64)
    bits = (low - (ranked >> np.uint64(16) & low)).astype(np.uint32)
    return own, other, np.where(bits >> np.uint32(31), bits & np.uint32(0x7FFFFFFF), ~bits).view(np.float32)


def first_lists(nodes: DataFrame, dim: int, compared) -> DataFrame:
    """GRAPH rows: the best DEGREE nodes of each node's starting groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(DEGREE)
        for group in _by_block(batches):
            ids, homes, x = _column(group, "node"), _column(group, "home"), _vectors(group.column("vec"), dim)
            compared.add(len(ids) * (len(ids) - 1) // 2)
            for at in range(0, len(ids), 512):
                sims = x[at : at + 512] @ x.T
                own = np.arange(len(sims))
                sims[own, at + own] = -np.inf
                k = min(DEGREE, len(ids) - 1)
                best = np.argpartition(-sims, max(0, k - 1), axis=1)[:, :k].ravel()
                own = np.repeat(own, k)
                found.add((ids[at + own], homes[at + own], ids[best], homes[best], sims[own, best], np.ones(len(own), dtype=np.int32)))
        yield from found.batches()

    dealt = nodes.select("node", "home", "vec", F.explode("starts").alias("block")).repartition("block").sortWithinPartitions("block", "node")
    return best_of(dealt.mapInArrow(run, GRAPH), DEGREE)


def listed_by(graph: DataFrame, size: int, seed: int) -> DataFrame:
    """GRAPH rows the other way round: of the nodes that list a node up to `size`, new ones first, then by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(size)
        for batch in batches:
            node, home, nbr, nbr_home, _, fresh = _unpacked(batch)
            found.add((nbr, nbr_home, node, home, (fresh + _mixed(node, nbr, seed)).astype(np.float32), fresh))
        yield from found.batches()

    return best_of(graph.mapInArrow(run, GRAPH), size)


def _mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Numbers from 0 to below 1 that follow from the values alone."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64((seed + 1) * 0x632BE59BD9B4E019 % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x * np.uint64(0x94D049BB133111EB) >> np.uint64(41)).astype(np.float64) / (1 << 23)


def _wanted(rows: DataFrame, unpack: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(block, node): the different nodes that rows (block, ...) name, of which unpack gives the (block, node) of a batch."""
    out = arrow_schema("block long, node long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, node = unpack(batch)
            order = np.lexsort((node, block))
            block, node = block[order], node[order]
            once = np.concatenate([[True], (block[1:] != block[:-1]) | (node[1:] != node[:-1])]) if len(block) else order
            yield pa.RecordBatch.from_arrays([pa.array(block[once]), pa.array(node[once])], schema=out)

    return rows.mapInArrow(run, "block long, node long").distinct()


def _sent(needed: DataFrame, nodes: DataFrame, graph: DataFrame) -> DataFrame:
    """block, node, home, least, vec of needed (block, node). A node meets its list once, before it is sent to its blocks."""
    least = F.coalesce("least", F.lit(float("-inf"))).cast("float").alias("least")
    known = nodes.select("node", "home", "vec").join(graph.select("node", "least"), "node", "left").select("node", "home", "vec", least)
    return needed.join(known, "node").select("block", "node", "home", "least", "vec")


def descend(graph: DataFrame, nodes: DataFrame, dim: int, seed: int, compared) -> DataFrame:
    """The graph after a round: each node's neighbours are compared with each other where one of the two is new there."""
    both = saved(graph.union(listed_by(graph, REVERSE, seed)), "lists")
    needed = _wanted(both, lambda batch: _unpacked(batch)[1:3])
    empty = F.lit(None).cast("binary")
    rows = _sent(needed, nodes, graph).select("block", F.lit(0).alias("kind"), "node", "home", "least", "vec", empty.alias("packed"))
    rows = rows.union(both.select("home", F.lit(1), "node", "home", "least", empty, "packed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Gathered(DEGREE)
        for block in _by_block(batches):
            split = int(np.searchsorted(_column(block, "kind"), 1))
            known, (node, _, nbr, _, _, fresh) = block.slice(0, split), _unpacked(block.slice(split))
            ids, homes, x, least = _column(known, "node"), _column(known, "home"), _vectors(known.column("vec"), dim), _column(known, "least")
            place, fresh = np.searchsorted(ids, nbr), fresh > 0
            # one row of places for each node; a neighbour both ways stands there once, new if it is so either way
            order = np.lexsort((~fresh, place, node))
            node, place, fresh = node[order], place[order], fresh[order]
            once = np.concatenate([[True], (node[1:] != node[:-1]) | (place[1:] != place[:-1])])
            node, place, fresh = node[once], place[once], fresh[once]
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            wide = np.diff(np.append(start, len(node)))
            at, new = np.full((len(start), wide.max()), -1), np.zeros((len(start), wide.max()), dtype=bool)
            row, column = np.repeat(np.arange(len(start)), wide), np.arange(len(node)) - np.repeat(start, wide)
            at[row, column], new[row, column] = place, fresh
            upper = np.triu(np.ones((wide.max(), wide.max()), dtype=bool), 1)
            pairs = []
            for a in range(0, len(at), 128):
                own, own_new = at[a : a + 128], new[a : a + 128]
                wanted = upper & (own >= 0)[:, :, None] & (own >= 0)[:, None, :] & (own_new[:, :, None] | own_new[:, None, :])
                compared.add(int(np.count_nonzero(wanted)))
                sims, worst = np.matmul(x[own], x[own].transpose(0, 2, 1)), least[own]
                v, i, j = np.nonzero(wanted & (sims > np.minimum(worst[:, :, None], worst[:, None, :])))
                pairs.append((own[v, i], own[v, j], sims[v, i, j]))
            a, b, sims = _offers(*_joined(pairs), least, DEGREE)
            found.add((ids[a], homes[a], ids[b], homes[b], sims, np.ones(len(a), dtype=np.int32)))
        yield from found.batches()

    def old(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, fresh = _unpacked(batch)
            yield from _packed((*rest, np.zeros_like(fresh)), DEGREE)

    better = rows.repartition("block").sortWithinPartitions("block", "kind", "node").mapInArrow(run, GRAPH)
    after = saved(best_of(better.union(graph.mapInArrow(old, GRAPH)), DEGREE), "graph")
    discard(both)
    return after


def _marked(rows: DataFrame, value: int | None) -> DataFrame:
    """(node, member) of the entries whose fresh is this value, or of all."""
    out = arrow_schema("node long, member long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("packed").to_pylist()
            node, entries = np.repeat(_column(batch, "node"), [len(x) // ENTRY.itemsize for x in packed]), np.frombuffer(b"".join(packed), dtype=ENTRY)
            at = np.flatnonzero(np.full(len(node), True) if value is None else entries["fresh"] == value)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(entries["nbr"][at])], schema=out)

    return rows.select("node", "packed").mapInArrow(run, "node long, member long")


def build_graph(nodes: DataFrame, count: int, dim: int) -> tuple[DataFrame, int]:
    """(the graph, number of compared pairs) of nodes (node, home, vec, starts)."""
    compared = nodes.sparkSession.sparkContext.accumulator(0)
    graph = saved(first_lists(nodes, dim, compared), "graph")
    for k in range(ROUNDS):
        before, graph = graph, descend(graph, nodes, dim, k, compared)
        discard(before)
        if _marked(graph, 1).count() <= SETTLED * DEGREE * count:
            break
    return graph, compared.value


def link_lists(graph: DataFrame) -> DataFrame:
    """(node, nbrs): whole numbers of 64 bits: a node's list and up to DEGREE nodes that list it."""
    out = arrow_schema("node long, nbrs binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = np.cumsum([0, *(len(x) // ENTRY.itemsize for x in batch.column("packed").to_pylist())])[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _blobs(np.ascontiguousarray(_unpacked(batch)[2]), starts)], schema=out)

    return best_of(graph.union(listed_by(graph, DEGREE, -1)), 2 * DEGREE).mapInArrow(run, "node long, nbrs binary")


def pools_of(asked: DataFrame, entries: tuple[np.ndarray, np.ndarray], dim: int) -> DataFrame:
    """A pool for each of asked (node, vec, inside): that holds the node itself, where it is one of the graph's, with an infinite sim, else the ENTRIES pivots of highest sims; they are visited first.

    The query has no completing component, so a pool is ordered by the inner product alone.
    """
    out, shared = arrow_schema(POOLS), asked.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                node, inside = _column(batch, "node"), np.asarray(batch.column("inside"))
                pivots, vectors = shared.value
                sims = _vectors(batch.column("vec"), dim) @ vectors.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, :ENTRIES]
                pools = []
                for i, own in enumerate(inside.tolist()):
                    first = np.empty(1 if own else best.shape[1], dtype=ENTRY)
                    first["nbr"], first["sim"] = (node[i], np.inf) if own else (pivots[best[i]], sims[i, best[i]])
                    first["home"], first["fresh"] = 0, NEXT
                    pools.append(first.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(pools, pa.binary()), batch.column("vec")], schema=out)

    return asked.select("node", "vec", "inside").mapInArrow(run, POOLS)


def visit(pools: DataFrame, links: DataFrame, nodes: DataFrame, dim: int, parts: int) -> DataFrame:
    """pools after the members that are NEXT have brought in their neighbours.

    What a query asks for goes to the parts of the nodes, with the query's vector once for each part, and the sims come
    back: no vector of a node moves but to its own part. A task holds one part's vectors and a batch of what is asked.
    """
    next_ones = _marked(pools, NEXT).select(F.col("node").alias("query"), F.col("member").alias("node"))
    met, no_blob = next_ones.join(links, "node"), F.lit(None).cast("binary")
    each = pools.select(F.col("node").alias("block"), F.lit(0).alias("kind"), "vec", no_blob.alias("nbrs")).union(met.select("query", F.lit(1), no_blob, "nbrs"))
    asking = "part long, kind int, node long, vec binary, packed binary"
    ask_out, found_out = arrow_schema(asking), arrow_schema(POOLS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query in _by_block(batches):
            wanted = np.unique(np.frombuffer(b"".join(x for x in query.column("nbrs").to_pylist() if x), dtype="<i8"))
            if not len(wanted):
                continue
            part = _part(wanted, parts)
            order = np.argsort(part, kind="stable")
            wanted, part = wanted[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            n, node = len(first), query.column("block")[0].as_py()
            vec = pa.array([query.column("vec")[0].as_py()] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(np.ones(n, dtype=np.int32)), pa.array(np.full(n, node)), vec, _blobs(wanted, first)], schema=ask_out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, x, held = None, None, None, []
        for batch in batches:  # sorted by part, its nodes first
            of, kind = _column(batch, "part"), _column(batch, "kind")
            cuts = [0, *(np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if of[a] != now:
                    now, held, x = of[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if x is None:
                    own = pa.Table.from_batches(held)
                    ids, x, held = _column(own, "node"), _vectors(own.column("vec"), dim), []
                for at in range(a, b, 500):
                    asked = batch.slice(at, min(500, b - at))
                    lists = asked.column("packed").to_pylist()
                    n = np.array([len(v) // 8 for v in lists])
                    entries = np.empty(int(n.sum()), dtype=ENTRY)
                    entries["nbr"], entries["home"], entries["fresh"] = np.frombuffer(b"".join(lists), dtype="<i8"), 0, WAITING
                    q, place = np.repeat(np.arange(len(n)), n), np.searchsorted(ids, entries["nbr"])
                    entries["sim"] = np.einsum("ij,ij->i", _vectors(asked.column("vec"), dim)[q], x[place])
                    yield pa.RecordBatch.from_arrays([asked.column("node"), _blobs(entries, np.cumsum(n) - n), pa.nulls(len(n), pa.binary())], schema=found_out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query in _by_block(batches):
            e = np.frombuffer(b"".join(query.column("packed").to_pylist()), dtype=ENTRY)
            state, same = np.where(e["fresh"] == NEXT, VISITED, e["fresh"]), np.full(len(e), query.column("block")[0].as_py())
            # of entries of one pair the one that was there: _best() takes the lowest for the oldest
            _, _, nbr, _, sim, state = _best((same, same, e["nbr"], same, e["sim"], -state), POOL + 1)
            entries = np.empty(len(nbr), dtype=ENTRY)
            entries["nbr"], entries["home"], entries["sim"], entries["fresh"] = nbr, 0, sim, -state
            entries["fresh"][np.flatnonzero(state == -WAITING)[:VISITS]] = NEXT
            vec = next(x for x in query.column("vec").to_pylist() if x)
            yield pa.RecordBatch.from_arrays([pa.array(same[:1]), _blobs(entries, np.zeros(1, dtype=np.int64)), pa.array([vec], pa.binary())], schema=found_out)

    asked = each.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(ask, asking)
    held = nodes.select("part", F.lit(0).alias("kind"), "node", "vec", no_blob.alias("packed"))
    found = held.union(asked).repartition("part").sortWithinPartitions("part", "kind", "node").mapInArrow(score, POOLS)
    both = pools.union(found).withColumnRenamed("node", "block")
    return saved(both.repartition("block").sortWithinPartitions("block").mapInArrow(merge, POOLS), "pools")


def exact_pass(queries: DataFrame, nodes: DataFrame, dim: int, k: int) -> DataFrame:
    """(node, nbr) of the best k nodes for queries (node, vec) against all nodes: a job for each EXACT queries, all written to one folder."""
    spark, path = nodes.sparkSession, new_path(nodes.sparkSession, "exact")
    schema = "node long, nbr long, s float"
    out = arrow_schema(schema)

    def against(block: list) -> None:
        own = np.array([r["node"] for r in block])
        asked = np.frombuffer(b"".join(bytes(r["vec"]) for r in block), dtype=np.float32).reshape(-1, dim).copy()
        asked[:, -1] = 0
        shared = spark.sparkContext.broadcast((own, asked))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32))] * len(own)
            for batch in batches:
                ids, sims = _column(batch, "node"), q @ _vectors(batch.column("vec"), dim).T
                for i, (n, (held, s)) in enumerate(zip(own.tolist(), best)):
                    other = ids != n
                    held, s = np.concatenate([held, ids[other]]), np.concatenate([s, sims[i][other]])
                    order = np.lexsort((held, -s))[:k]
                    best[i] = held[order], s[order]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, [len(i) for i, _ in best])), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([s for _, s in best]).astype(np.float32))], schema=out)

        each = nodes.select("node", "vec").mapInArrow(run, schema)
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("s"), "nbr"))
        each.withColumn("r", rank).where(F.col("r") <= k).select("node", "nbr").write.mode("append").parquet(path)

    block = []
    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == EXACT:
            against(block)
            block = []
    if block:
        against(block)
    return spark.read.schema("node long, nbr long").parquet(path)


def search(vectors: DataFrame, k: int = 20, every: int = 20, told: Callable[[dict], None] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows that the search finds for each row whose vec_id is divisible by `every`.

    score is the inner product in double precision; equal scores go by smaller vec_id. Rows without an id or with a null,
    empty, zero or non-finite vector take no part. Norms may differ as they like. Vectors of different lengths have no inner product: those of one length
    are searched among themselves. Repeated rows count once; other columns are not looked at; an empty table gives an
    empty result. A query short of k found candidates, or whose search STEPS cut off, is compared with all nodes of the
    band. told, if given, is called for each band that is searched with the numbers of its nodes, compared pairs of the
    graph, steps of the search, and queries that asked.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = [r["dim"] for r in rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").collect()]
    result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in sizes:
        result = result.union(_search(rows.where(F.size("embedding") == dim), dim, k, every, told))
    return result


def bands(bins: dict[int, int]) -> list[tuple[int, int, int]]:
    """(lowest bin, highest bin, nodes) of each band, from the largest norms down, of the nodes in each bin: each reaches down OCTAVES from the largest norm that is left."""
    out = []
    for at in sorted(bins, reverse=True):
        if out and out[-1][1] - at < OCTAVES * BINS:
            out[-1] = at, out[-1][1], out[-1][2] + bins[at]
        else:
            out.append((at, at, bins[at]))
    return out


def compared_with_few(asked: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(node, nbr): the best k of a small band's classes (node, embedding) for each of asked (node, embedding), itself left out."""
    rows = classes.select("node", "embedding").orderBy("node").collect()
    shared = asked.sparkSession.sparkContext.broadcast((np.array([r["node"] for r in rows]), np.array([r["embedding"] for r in rows])))
    out = arrow_schema("node long, nbr long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                node, q = _column(part, "node"), np.asarray(part.column("embedding").flatten()).reshape(-1, x.shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    sims = np.nan_to_num(q @ x.T)
                sims[node[:, None] == ids[None, :]] = -np.inf
                best = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]  # of equal sims the smaller node; itself is last
                own = np.repeat(node, best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids[best.ravel()])], schema=out)

    return asked.select("node", "embedding").distinct().mapInArrow(run, "node long, nbr long")


def _by_graph(classes: DataFrame, asked: DataFrame, count: int, dim: int, top: float, k: int, tell) -> DataFrame:
    """(node, nbr) that the search of a band's graph finds for asked (node, embedding, norm); top: the log2 of a norm that none of classes exceeds."""
    # x / 2^top and the component that completes it to norm 1
    level = F.transform("embedding", lambda x: x / F.lit(2.0**top))
    rest = F.greatest(F.lit(0.0), 1 - F.aggregate(level, F.lit(0.0), lambda s, x: s + x * x))
    floats = lambda x: F.transform(x, lambda v: v.cast("float"))
    nodes, entries = assign(classes.select("node", floats(F.concat(level, F.array(F.sqrt(rest)))).alias("vec")), count, dim)
    nodes = saved(nodes, "nodes")
    graph, compared = build_graph(nodes, count, dim)
    links = saved(link_lists(graph), "links")
    discard(graph)
    own = asked.select("node", floats(F.concat(F.transform("embedding", lambda x: x / F.exp(F.col("norm") * F.log(F.lit(2.0)))), F.array(F.lit(0.0)))).alias("lists")).dropDuplicates(["node"])
    out = arrow_schema("node long, vec binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in _matrix(batch.column("lists"), dim)], pa.binary())], schema=out)

    own = own.mapInArrow(pack, "node long, vec binary").join(nodes.select("node", F.lit(True).alias("inside")), "node", "left").select("node", "vec", F.coalesce("inside", F.lit(False)).alias("inside"))
    own = saved(own, "own")
    pools, steps = saved(pools_of(own, entries, dim), "pools"), 0
    while steps < STEPS:
        before, pools = pools, visit(pools, links, nodes, dim, asked_parts(count))
        discard(before)
        steps += 1
        if _marked(pools, NEXT).isEmpty():
            break
    tell({"nodes": count, "compared": compared, "steps": steps, "queries": own})
    found = _marked(pools, None).select("node", F.col("member").alias("nbr"))
    short = found.groupBy("node").count().where(F.col("count") <= min(k, count - 1)).select("node").union(_marked(pools, NEXT).select("node")).distinct().join(own, "node").select("node", "vec")
    if not short.isEmpty():
        found = found.union(exact_pass(short, nodes, dim, k)).distinct()
    return found


def _search(rows: DataFrame, dim: int, k: int, every: int, told) -> DataFrame:
    rows = saved(rows.distinct(), "vectors")
    # equal vectors: the k + 1 smallest ids, first within salted parts
    least = lambda c: F.slice(F.array_sort(c), 1, k + 1)
    parts = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(least(F.collect_list("vec_id")).alias("ids"))
    classes = parts.groupBy("embedding").agg(least(F.flatten(F.collect_list("ids"))).alias("ids"))
    # the log2 of the norm; its largest component comes first, so that no square leaves the doubles
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x)))
    norm = F.log2(largest) + F.log2(F.aggregate(F.transform("embedding", lambda x: x / largest), F.lit(0.0), lambda s, x: s + x * x)) / 2
    classes = saved(classes.select(F.col("ids")[0].alias("node"), "embedding", "ids", norm.alias("norm")), "classes")
    at = F.floor(F.col("norm") * BINS).cast("int")
    found_bands = bands({r["bin"]: r["count"] for r in classes.groupBy(at.alias("bin")).count().collect()})
    asked = saved(rows.where(F.col("vec_id") % every == 0).join(classes.select("node", "embedding", "norm"), "embedding").select(F.col("vec_id").alias("query_id"), "node", "embedding", "norm"), "asked")
    most = max(n for *_, n in found_bands)

    def tell(figures: dict) -> None:
        if told:
            told(figures | {"queries": figures["queries"].count()})

    best, waiting = None, asked
    for low, high, count in found_bands:
        own, top = classes.where(at.between(low, high)), (high + 1) / BINS
        if best is not None:  # no product of this band exceeds that of the norms; a query with k better ones needs it not
            kth = best.groupBy("query_id", "node").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
            waiting = asked.join(kth, ["query_id", "node"], "left").where(F.coalesce(F.col("n") < k, F.lit(True)) | (F.log2(F.when(F.col("kth") > 0, F.col("kth"))) <= F.col("norm") + top + 1e-9) | (F.col("kth") <= 0)).select(asked.columns)
            if waiting.isEmpty():
                break
        if count <= min(SMALL, SMALL_BYTES // (8 * dim)) and count < most:
            pairs = compared_with_few(waiting, own, k)
        else:
            pairs = _by_graph(own, waiting, count, dim + 1, top, k, tell)
        pairs = pairs.join(waiting.select("query_id", "node", "embedding"), "node").join(own.select(F.col("node").alias("nbr"), F.col("embedding").alias("other"), "ids"), "nbr")
        score = F.aggregate(F.zip_with("embedding", "other", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        each = pairs.select("query_id", "node", score.alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.desc("score"), "vec_id"))
        each = each if best is None else each.union(best.select(each.columns))
        each = each.withColumn("rank", rank).where(F.col("rank") <= k)
        best = each if len(found_bands) == 1 else saved(each, "best", best)
    return best.select("query_id", "rank", "vec_id", "score")
