"""SimHash near-duplicates by anchor-point covering, and their connected components.

Fingerprints have 64 bits. The anchors are the codewords of the perfect Hamming code on the first 63 bits, whose covering
radius is 1: each point of that space is within 1 of exactly one anchor. Two fingerprints at 2 or fewer differing bits
have a midpoint within 1 of both, and that midpoint's anchor is within 2 of both. So each fingerprint goes to every
anchor within 2 of it (1 or 32 of them), and fingerprints are compared where they meet at an anchor. No pair is lost.
A ball of radius 2 holds at most 2,017 points, so at most 4,034 different fingerprints meet at an anchor, however
many documents there are: equal fingerprints are one row before they are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, discard, picked, saved, slices

SHINGLE, SEED, RADIUS = 3, 42, 2
PAIRS_AT_ONCE = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's shingles of `shingle` words, repeats included (fewer words: all of them; none: 0)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - shingle + 1)
    one = xxhash.xxh64_intdigest
    set_bits, spans = np.zeros(64, dtype=np.int64), zip(starts[:k].tolist(), ends[len(words) - k :].tolist())
    hashes = np.fromiter((one(flat[a:b], SEED) for a, b in spans), dtype=">u8", count=k)
    for at in range(0, k, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > k).tobytes(), "big")


def _fingerprinted(docs: DataFrame, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The columns `keep` of docs as k0, k1 and so on, with the fingerprint fp as a signed long."""
    rows, schema, text = carried(docs, keep)
    schema += ", fp long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                fp = np.array([fingerprint(t, shingle) for t in batch.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fp)], schema=out)

    return rows.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row of docs (doc_id, text)."""
    return _fingerprinted(docs, ["doc_id"], shingle).select(F.col("k0").alias("doc_id"), "fp")


def syndrome(fp: np.ndarray) -> np.ndarray:
    """Place (1 to 63) of the bit whose change makes the first 63 bits a codeword; 0 where they are one."""
    out = np.zeros(len(fp), dtype=np.uint64)
    for k in range(6):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, 64) if p >> k & 1))
        out |= (np.bitwise_count(fp & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which fingerprint, anchor) for every anchor within 2 of each fingerprint's first 63 bits."""
    one, low = np.uint64(1), np.uint64((1 << 63) - 1)
    x, s = fp & low, syndrome(fp)
    which, found = [np.arange(len(fp))], [np.where(s > 0, x ^ (one << (np.maximum(s, one) - one)), x)]
    off = np.flatnonzero(s)
    for i in range(1, 64):
        i = np.uint64(i)
        j = s[off] ^ i
        ok = j > i  # each pair of places once; a place of 0 is no bit
        at = off[ok]
        which.append(at)
        found.append(x[at] ^ (one << (i - one)) ^ (one << (j[ok] - one)))
    return np.concatenate(which), np.concatenate(found)


def local_links(anchor: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each run of equal anchors: (fingerprint, the smallest one that it reaches there)."""
    n = len(fp)
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if n else np.empty(0, dtype=np.int64)
    run = np.diff(np.append(starts, n))
    last = np.repeat(starts + run, run)  # the end of each row's run
    label, rows, d = np.arange(n), np.arange(n), 1
    pairs, held = [], 0
    while True:
        rows = rows[rows + d < last[rows]]
        if not len(rows) or held > PAIRS_AT_ONCE:
            label, pairs, held = _least_reached(label, pairs), [], 0
        if not len(rows):
            break
        apart = rows[label[rows] != label[rows + d]]
        hit = apart[np.bitwise_count(fp[apart] ^ fp[apart + d]) <= radius]
        pairs.append((hit, hit + d))
        held += len(hit)
        d += 1
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _least_reached(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row that each row reaches over the pairs and its link to its label."""
    a = np.concatenate([np.arange(len(label)), *(p[0] for p in pairs)])
    b = np.concatenate([label, *(p[1] for p in pairs)])
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (fp) that connect all those at `radius` or fewer differing bits."""
    if radius > RADIUS:
        raise ValueError("this covering serves 2 differing bits at most")
    spark = distinct.sparkSession
    dealt_schema, link_schema = arrow_schema("anchor long, fp long"), arrow_schema("a long, b long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            which, found = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(fp[which].view(np.int64))], schema=dealt_schema)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)

        def linked(anchor: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = local_links(anchor, fp, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=link_schema)

        for batch in batches:  # sorted by anchor; the last anchor's rows wait for the next batch
            anchor = np.concatenate([left[0], np.asarray(batch.column("anchor"))])
            fp = np.concatenate([left[1], np.asarray(batch.column("fp")).view(np.uint64)])
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            yield linked(anchor[:cut], fp[:cut])
            left = anchor[cut:], fp[cut:]
        yield linked(*left)

    dealt = distinct.select("fp").mapInArrow(deal, "anchor long, fp long")
    met = dealt.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) of every node that an edge (a, b) names; root: the smallest node of its component.

    Large-star and small-star steps in turn until no edge changes; each step's edges are written to the shared folder.
    A hub's edges are grouped by min() alone, which is partial before the shuffle.
    """
    edges = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        new = saved(small, label)
        count = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        same = new.agg(*count).first() == edges.agg(*count).first()
        discard(edges)
        edges = new
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def rooted(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """distinct (fp, any others) with root, the smallest fingerprint of its component."""
    roots = components(links(distinct, radius), "stars")
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links of at most `radius`
    differing bits) of each row of docs (doc_id, text).

    Words are runs of anything but ASCII white space, A-Z in lower case. Null text counts as empty: no words, fingerprint
    zero, linked like any other. Repeated rows give repeated results; a null doc_id takes part and a component without
    any doc_id has a null component_id; other columns are not looked at; an empty table gives an empty result.
    """
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = saved(rooted(distinct, radius), "roots", distinct)
    named = found.groupBy("root").agg(F.min("least").alias("component_id"))
    each = rows.join(found.join(named, "root").select("fp", "component_id"), "fp")
    return each.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate component: one of smallest doc_id (none counts as the largest).

    The rows are written once with a number each; what stays is decided on numbers, ids and fingerprints alone, and each
    task then picks its own rows by number, so no text is shuffled and no id or fingerprint makes a hot key.
    """
    columns, ids = docs.columns, f"k{docs.columns.index('doc_id')}"
    rows = saved(_fingerprinted(docs, columns).withColumn("row", F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col(ids).isNull().alias("nameless"), F.col(ids).alias("doc_id"), "row")).alias("first")
    distinct = saved(rows.groupBy("fp").agg(first), "distinct")
    kept = saved(rooted(distinct), "roots", distinct).groupBy("root").agg(F.min("first").alias("first"))
    return picked(rows, kept.select("first.row")).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])
