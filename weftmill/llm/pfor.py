"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A shard file holds the ids of a run of documents in ascending doc_id order:

    magic "WFPFOR01"
    blocks, each of BLOCK ids (the shard's last one may be shorter):
        u32 minimum, u8 width, u16 number of exceptions, u16 number of ids
        the low `width` bits of (id - minimum), packed, most significant bit first, padded to a byte
        u16 positions of the exceptions, then u32 whole (id - minimum) of each
    index: u64 start of each block; per document i64 doc_id, u8 "doc_id is null", u64 number of ids
    trailer: u64 start of the index, u64 number of blocks, u64 number of documents, magic

The width is the least that holds PERCENTILE of a block's differences; the rest are exceptions. Shards are numbered in
doc_id order and their names and totals form a manifest of one row for each shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, new_path, saved, slices
from .tokens import word_encoder

MAGIC = b"WFPFOR01"
BLOCK = 1024
PERCENTILE = 95
HEAD = struct.Struct("<IBHH")
TRAILER = struct.Struct("<QQQ8s")
BLOCKS_AT_ONCE = 2048


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each packed at this width, as rows of bytes."""
    rows, n = values.shape
    if width == 0 or n == 0:
        return np.zeros((rows, 0), dtype=np.uint8)
    as_bits = np.unpackbits(np.ascontiguousarray(values.astype(">u4")).view(np.uint8).reshape(rows, n, 4), axis=2)
    return np.packbits(as_bits[:, :, 32 - width :].reshape(rows, n * width), axis=1)


def unpack_bits(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 0 or n == 0:
        return np.zeros((len(rows), n), dtype=np.uint32)
    out = np.zeros((len(rows), n, 32), dtype=np.uint8)
    out[:, :, 32 - width :] = np.unpackbits(rows, axis=1, count=n * width).reshape(len(rows), n, width)
    return np.packbits(out, axis=2).reshape(len(rows), n * 4).view(">u4").astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of whole rows of ids: an array [blocks, ids of each]."""
    rows, n = ids.shape
    least = ids.min(axis=1).astype(np.uint32)
    rest = ids - least[:, None]
    k = min(n - 1, -(-n * PERCENTILE // 100) - 1)
    # the k-th least difference has the k-th least bit length
    widths = np.frexp(np.partition(rest, k, axis=1)[:, k].astype(np.float64))[1]
    out: list[bytes] = [b""] * rows
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        part = rest[which]
        mask = np.uint32((1 << width) - 1) if width < 32 else np.uint32(0xFFFFFFFF)
        packed, over = pack_bits(part & mask, width), part > mask
        for i, at in enumerate(which.tolist()):
            odd = np.flatnonzero(over[i])
            out[at] = HEAD.pack(least[at], width, len(odd), n) + packed[i].tobytes() + odd.astype("<u2").tobytes() + part[i, odd].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray, base: int) -> np.ndarray:
    """The ids of the blocks that start at these places of the file, of which data holds the part from base on."""
    heads = [HEAD.unpack_from(data, int(s) - base) for s in starts]
    out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(heads)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (_, width, _, n) in enumerate(heads):
        groups.setdefault((width, n), []).append(i)
    raw = np.frombuffer(data, dtype=np.uint8)
    for (width, n), which in groups.items():
        size = -(-n * width // 8)
        at = np.array([int(starts[i]) - base + HEAD.size for i in which])
        values = unpack_bits(raw[at[:, None] + np.arange(size)], width, n)
        for row, i, p in zip(values, which, at.tolist()):
            least, _, odd, _ = heads[i]
            p += size
            row[np.frombuffer(data, "<u2", odd, p)] = np.frombuffer(data, "<u4", odd, p + 2 * odd)
            out[i] = row + np.uint32(least)
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.at, self.starts, self.left = sink, 0, [], np.empty(0, dtype=np.uint32)
        self.doc_ids, self.nulls, self.counts = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _blocks(self, ids: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCKS_AT_ONCE):
            for block in encode_blocks(ids[at : at + BLOCKS_AT_ONCE]):
                self.starts.append(self.at)
                self._put(block)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype("u1"))
        self.counts.append(counts.astype("<u8"))
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole].reshape(-1, BLOCK))
        self.left = ids[whole:].copy()

    def close(self) -> None:
        if len(self.left):
            self._blocks(self.left[None, :])
        index = self.at
        self._put(np.array(self.starts, dtype="<u8").tobytes())
        for part in (self.doc_ids, self.nulls, self.counts):
            for x in part:
                self._put(x.tobytes())
        self._put(TRAILER.pack(index, len(self.starts), sum(map(len, self.doc_ids)), MAGIC))


def read_shard(source, size: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, number of ids, the ids) of each document of a shard file, a bounded run of blocks in memory at a time."""

    def part(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    index, blocks, docs, magic = TRAILER.unpack(part(size - TRAILER.size, TRAILER.size))
    if magic != MAGIC or part(0, len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id shard")
    rest = part(index, size - TRAILER.size - index)
    starts = np.frombuffer(rest, "<u8", blocks).astype(np.int64)
    doc_ids = np.frombuffer(rest, "<i8", docs, 8 * blocks)
    nulls = np.frombuffer(rest, "u1", docs, 8 * (blocks + docs))
    counts = np.frombuffer(rest, "<u8", docs, 8 * (blocks + docs) + docs).astype(np.int64)
    stops = np.append(starts, index)
    held, have, at = [], 0, 0
    for d, null, n in zip(doc_ids.tolist(), nulls.tolist(), counts.tolist()):
        while have < n:
            to = min(at + 512, blocks)
            data = part(int(stops[at]), int(stops[to] - stops[at]))
            held.append(decode_blocks(data, starts[at:to], int(stops[at])))
            have, at = have + len(held[-1]), to
        ids = held[0] if len(held) == 1 else np.concatenate(held) if held else np.empty(0, dtype=np.uint32)
        yield None if null else d, n, ids[:n]
        held, have = [ids[n:]], have - n


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> DataFrame:
    """Encodes docs (doc_id, text) and writes shard files under path; returns the manifest: shard, file, size, n_docs, n_tokens.

    Documents are range-partitioned by doc_id (null first; rows with equal ids by a hash of the text, repeated rows by place), so shard numbers follow doc_id and
    no task holds more than its range. Each task writes under a name of its own and renames, so a repeated task is harmless.
    Null text: empty. An empty table gives an empty manifest.
    """
    manifest = "shard int, file string, size long, n_docs long, n_tokens long"
    out_schema = arrow_schema(manifest)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context = TaskContext.get()
        encoder, out, n_docs, n_tokens = word_encoder(tokenizer_path), None, 0, 0
        where, root = fs.FileSystem.from_uri(path)
        name = f"shard-{context.partitionId():06d}.pfor"
        own = f"{root}/{name}.{context.taskAttemptId()}"
        for whole in batches:
            for batch in slices(whole, "text", 6 << 20):
                if out is None:
                    where.create_dir(root, recursive=True)
                    stream = where.open_output_stream(own)
                    out = ShardWriter(stream)
                offsets, ids = encoder.encode_ended(batch.column("text"))
                keys = batch.column("doc_id")
                out.add(np.asarray(keys.fill_null(0)), np.asarray(keys.is_null()), np.diff(offsets), ids)
                n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(ids)
        if out is not None:
            out.close()
            stream.close()
            where.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([{"shard": context.partitionId(), "file": name, "size": out.at, "n_docs": n_docs, "n_tokens": n_tokens}], schema=out_schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    # ties by a hash of the text: the range sample that reaches the driver then holds no texts; repeated rows by their place, so that they may fill many shards
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(rows.select("doc_id", "text").mapInArrow(write, manifest), "manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """Documents of the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, one row each.

    The manifest (one row per shard) is the only thing the driver sees; the files are read by the executors.
    """
    spark = manifest.sparkSession
    shards, start = [], 0
    for r in manifest.orderBy("shard").toLocalIterator():
        shards.append((r["file"], r["size"], start))
        start += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    out_schema = arrow_schema(schema)
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for r in batch.to_pylist():
                at, rows = r["start"], []
                with where.open_input_file(f"{root}/{r['file']}") as source:
                    for doc_id, n, ids in read_shard(source, r["size"]):
                        rows.append((doc_id, at, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        at += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out_schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=out_schema)

    found = spark.createDataFrame(shards, "file string, size long, start long").repartition(len(shards))
    return found.mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs as token-id files in the shared folder and returns what is read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, path, tokenizer_path), path)
