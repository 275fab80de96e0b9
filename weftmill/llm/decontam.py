"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted-shingle similarity.

Words are lower-cased letters and digits of white-space-separated pieces; shingles have five words (an item of fewer: all
of its words). Around each place where a text has a shingle of some item (a window without one has similarity 0), every
window of that item's number of words gets a SimHash of its shingles. The 64 bits are cut into 8 blocks: fingerprints
within RADIUS differ by at most RADIUS // 8 bits in one of them, so tables from each block's value to the items near it
miss nothing within the radius. Each candidate is verified on the shingles themselves: their shared number, counted with
multiplicity, over the geometric mean of both numbers, has to reach SIMILARITY. No radius holds all windows that reach it,
so windows further off are verified too where enough of their shingles are the item's: no window that reaches it is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, slices, split_words

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 8
#: Items are broadcast in groups of at most this much text; a larger benchmark takes a pass over the documents for each.
GROUP_BYTES = 4 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each text, hash of each word)."""
    import xxhash

    counts, pieces, codes = split_words(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\t\r\x0b\x0c\x{a0}]", " "))
    core = pc.utf8_lower(pc.replace_substring_regex(pieces, r"[^\p{L}\p{N}]+", "")).dictionary_encode()
    names = core.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w) if w else 0 for w in names], dtype=np.uint64)[np.asarray(core.indices)][codes]
    real = hashes != 0
    text = np.repeat(np.arange(len(counts)), counts)
    return np.bincount(text[real], minlength=len(counts)), hashes[real]


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    k = len(words) - n + 1
    if k <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:k].copy()
    for i in range(1, n):
        out = out * _FACTOR + words[i : i + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def bit_rows(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)


def simhashes(hashes: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash, as rows of 8 bytes, of the m shingles from each start on."""
    low = int(starts.min())
    sums = np.zeros((int(starts.max()) + m - low + 1, 64), dtype=np.int32)
    np.cumsum(bit_rows(hashes[low : low + len(sums) - 1]), axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts - low + m] - sums[starts - low]) > m, axis=1)


@dataclass
class Sized:
    """The items of one number of shingles of one length."""

    ids: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    prints: np.ndarray | None = None
    tables: np.ndarray | None = None


class Items:
    def __init__(self, rows: list[tuple[int, str]]):
        self.sizes: dict[tuple[int, int], Sized] = {}
        owners: dict[int, list[tuple[int, tuple[int, int], int]]] = {}
        counts, words = word_hashes(pa.array([t for _, t in rows], pa.string()))
        ends = np.cumsum(counts)
        for (item, _), end, n in zip(rows, ends.tolist(), counts.tolist()):
            if n == 0:
                continue
            k = min(n, SHINGLE)
            hashes = shingle_hashes(words[end - n : end], k)
            key = k, len(hashes)
            size = self.sizes.setdefault(key, Sized())
            owners.setdefault(k, []).extend((h, key, len(size.ids)) for h in set(hashes.tolist()))
            size.ids.append(item)
            size.shingles.append(hashes)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= RADIUS // BLOCKS
        for (_, m), size in self.sizes.items():
            size.prints = np.concatenate([simhashes(h, np.zeros(1, dtype=np.int64), m) for h in size.shingles])
            size.tables = np.stack([near[:, size.prints[:, j]] for j in range(BLOCKS)])  # [block, value, item]
        self.keys = {}
        for k, found in owners.items():
            found.sort()
            hashes = np.array([h for h, *_ in found], dtype=np.uint64)
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[hashes & np.uint64((1 << 20) - 1)] = True
            self.keys[k] = hashes, [o for _, *o in found], bitmap

    def find(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """Of one text's words: (item, similarity, first word of the window) of each item's best window that reaches SIMILARITY."""
        best: dict[int, tuple[float, int]] = {}
        for k, (keys, owners, bitmap) in self.keys.items():
            hashes = shingle_hashes(words, k)
            maybe = np.flatnonzero(bitmap[hashes & np.uint64((1 << 20) - 1)])
            if not len(maybe):
                continue
            left, right = np.searchsorted(keys, hashes[maybe]), np.searchsorted(keys, hashes[maybe], "right")
            at: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
            for place, a, b in zip(maybe.tolist(), left.tolist(), right.tolist()):
                for key, item in owners[a:b]:
                    places, items = at.setdefault(key, ([], []))
                    places.append(place)
                    items.append(item)
            for key, (places, items) in at.items():
                self._windows(hashes, key, np.array(places), np.array(items), best)
        return [(item, s, start) for item, (s, start) in sorted(best.items())]

    def _windows(self, hashes: np.ndarray, key: tuple[int, int], places: np.ndarray, items: np.ndarray, best: dict) -> None:
        """Verifies windows around places where hashes has a shingle of items, one of each for each such pair."""
        size, m = self.sizes[key], min(key[1], len(hashes))
        cuts = np.flatnonzero(np.diff(places) > m) + 1
        for run, held in zip(np.split(places, cuts), np.split(items, cuts)):
            some, owned = np.unique(held, return_counts=True)
            # an item of too few shared shingles reaches the similarity in no window of the run
            some = some[owned / (m * key[1]) ** 0.5 >= SIMILARITY]
            low, high = max(0, int(run[0]) - m + 1), min(int(run[-1]), len(hashes) - m)
            for first in range(low, high + 1 if len(some) else low, 4096):
                starts = np.arange(first, min(first + 4096, high + 1))
                prints, region = simhashes(hashes, starts, m), hashes[first : int(starts[-1]) + m]
                for i in some.tolist():
                    near = size.tables[0, :, i][prints[:, 0]]
                    for j in range(1, BLOCKS):
                        near = near | size.tables[j, :, i][prints[:, j]]
                    near[near] = np.bitwise_count(prints[near] ^ size.prints[i]).sum(axis=1) <= RADIUS
                    self._verify(size, i, region, m, first, near, best)

    def _verify(self, size: Sized, i: int, region: np.ndarray, m: int, first: int, near: np.ndarray, best: dict) -> None:
        """Exact similarity of item i and the windows of region: those near by fingerprint, then those further off that may reach it."""
        own, name = size.shingles[i], size.ids[i]
        shared = np.concatenate([[0], np.cumsum(np.isin(region, own))])
        most = (shared[m:] - shared[:-m]) / (m * len(own)) ** 0.5  # of each window, no less than its similarity
        counted = Counter(own.tolist())
        for group in (near, ~near):
            of = np.flatnonzero(group & (most >= SIMILARITY))
            for w in of[np.argsort(-most[of], kind="stable")].tolist():
                s, start = best.get(name, (0.0, 0))
                if most[w] < s:
                    break
                common = (Counter(region[w : w + m].tolist()) & counted).total() / (m * len(own)) ** 0.5
                if common >= SIMILARITY and (common > s or common == s and first + w < start):
                    best[name] = (common, first + w)


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows, size = [], 0
    for r in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size >= GROUP_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _flagged(docs: DataFrame, items: list[tuple[int, str]], keep: list[str]) -> DataFrame:
    """The columns `keep` of docs as k0, k1 and so on, with found: array of (item_id, similarity, start_word)."""
    spark = docs.sparkSession
    rows, schema, text = carried(docs, keep)
    schema += ", found array<struct<item_id:bigint,similarity:double,start_word:bigint>>"
    out, shared = arrow_schema(schema), spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items(shared.value)
        for whole in batches:
            for batch in slices(whole, text, 8 << 20):
                counts, words = word_hashes(batch.column(text))
                ends = np.cumsum(counts)
                found = [known.find(words[b - n : b]) for n, b in zip(counts.tolist(), ends.tolist())]
                found = pa.array([[{"item_id": i, "similarity": s, "start_word": w} for i, s, w in f] for f in found], out.field(len(keep)).type)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], schema=out)

    return rows.mapInArrow(run, schema)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word: each row of docs (doc_id, text) with each benchmark item (item_id, text) of which it has a window that reaches SIMILARITY.

    Null and empty texts and items match nothing, null item ids are left out; repeated rows give repeated results, equal
    windows give the first; other columns are not looked at; empty tables give an empty result.
    """
    result = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word long")
    for items in _groups(benchmark):
        found = _flagged(docs, items, ["doc_id"]).where(F.size("found") > 0).select(F.col("k0").cast("long").alias("doc_id"), F.inline("found"))
        result = result.union(found)
    return result


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a window like any benchmark item, with the columns of docs."""
    columns = docs.columns
    for items in _groups(benchmark):
        docs = _flagged(docs, items, columns).where(F.size("found") == 0).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(columns)])
    return docs
