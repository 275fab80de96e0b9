"""Best-fit packing of token pieces into sequences of a fixed size, in bulk.

Pieces of equal length are interchangeable, and so are sequences with equal gaps. So lengths are held as sorted runs
(length, count), one for each length up to the capacity, and gaps as runs of sequences, however many documents there are.
A sweep goes through the length runs from the longest; the successor of a run, a gap run of least size that holds it,
takes as many pieces as fit, the r-th piece going where rank r falls, and its gaps shrink to what is left; then the next
gap run follows, or new sequences are opened. That is best-fit-decreasing, carried out for whole runs at once. A match
uses up a length or a gap run and leaves three gap runs at most, so matches follow the number of lengths, not of pieces.

The sweep runs on the driver: it sees 4,096 numbers and would gain nothing from more machines. What grows with the
documents stays in Spark: the range sort of the pieces by length, their ranks within a length (place in the partition plus
what earlier partitions hold of that length, so one length may have any share of the rows), and the placing of each rank
by binary search in the table of matches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, saved, slices
from .tokens import word_encoder

CAPACITY = 4096


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of the encoded docs (doc_id, text): doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    Each document's ids end with the end id; only a longer one is cut, into pieces of the capacity, the last one shorter.
    Null text counts as empty: one piece, the end id. ids: little-endian unsigned 32-bit integers.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                offsets, ids = encoder.encode_ended(batch.column("text"))
                n = np.diff(offsets)
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[of] - start, capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (offsets[:-1][of] + start) * 4
                spans = list(zip(at.tolist(), (at + length * 4).tolist()))
                columns = [batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (length, first rank, number of pieces, first sequence, pieces in each sequence, offset of the first) of runs of pieces and gaps."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # of each size: runs (first sequence, number)
    matches, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        gap = length
        while n:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                new = -(-n // (capacity // length))
                gaps[capacity].append((opened, new))
                opened += new
                gap = capacity
            first, k = gaps[gap].pop()
            fit = gap // length
            full, rest = divmod(min(n, k * fit), fit)
            took = full * fit + rest
            matches.append((length, rank, took, first, fit, capacity - gap))
            left = gap - fit * length
            if full and left:
                gaps[left].append((first, full))
            if rest:
                gaps[gap - rest * length].append((first + full, 1))
            if k > full + bool(rest):
                gaps[gap].append((first + full + bool(rest), k - full - bool(rest)))
            rank, n = rank + took, n - took
    return matches


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces (doc_id, piece, length from 1 to capacity, any others) with sequence_id and offset.

    Offsets are gapless from 0 in each sequence. Equal lengths are ranked by doc_id (null first) and piece, repeated rows
    in any order; each row has a place of its own. An empty table gives an empty result.
    """
    ranged = pieces.repartitionByRange(F.desc("length"), F.col("doc_id").asc_nulls_first(), "piece")
    ranged = ranged.sortWithinPartitions(F.desc("length"), F.col("doc_id").asc_nulls_first(), "piece")
    ranged = saved(ranged.withColumn("__at", F.monotonically_increasing_id()), "pieces")
    # one row for each length and partition that has it: in sorted order, so at most lengths plus partitions
    runs = ranged.groupBy("length", F.shiftright("__at", 33).alias("part")).agg(F.min("__at").alias("first"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    keys, firsts, ranks = [], [], []
    for r in sorted(runs, key=lambda r: r["first"]):
        keys.append(r["first"])
        ranks.append(counts.get(r["length"], 0))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    matches = np.array(sorted(sweep(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    starts, before = np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int64)
    found_at = matches[:, 0] * (1 << 40) + matches[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((starts, before, matches, found_at))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    out = arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, before, matches, found_at = shared.value
        for batch in batches:
            at, length = np.asarray(batch.column("__at")), np.asarray(batch.column("length"))
            run = np.searchsorted(starts, at, "right") - 1
            rank = before[run] + at - starts[run]
            m = matches[np.searchsorted(found_at, length * (1 << 40) + rank, "right") - 1]
            nth, inside = np.divmod(rank - m[:, 1], m[:, 4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(m[:, 3] + nth), pa.array(m[:, 5] + inside * length)], schema=out)

    return ranged.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """cut_pieces() of docs, each once, and their places: see pack()."""
    return pack(saved(cut_pieces(docs, tokenizer_path, capacity, with_ids), "cut"), capacity)
