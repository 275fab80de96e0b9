"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, a calibrated temperature.

A word's symbols are its lower-cased letters and digits, and its shape (runs of capitals, small letters and digits
shortened, other characters as they are). Each symbol has a sparse random index vector, from its hash; its context vector
is the sum of the index vectors of the symbols up to WINDOW words before and after it over all texts. A document is the
means of its words' vectors, with a few counts: lengths, different words, and how often a word repeats its neighbour.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, hashed_share, slices, split_words

#: The network sees at most about this many labelled documents (a fixed hashed share of all), in FIT_PARTS parts; one in HOLD of them sets the temperature alone.
FIT_DOCS, FIT_PARTS, HOLD = 6000, 6, 5
BUCKETS, DIM, ONES, WINDOW = 8192, 32, 4, 2
HIDDEN, EPOCHS, RATE = 32, 60, 0.01
THRESHOLD = 0.3


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :ONES]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], dtype=np.float32), (BUCKETS, ONES)), axis=1)
    return out


def _buckets(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    return np.array([zlib.crc32(w.encode()) % BUCKETS for w in coded.dictionary.to_pylist()], dtype=np.int64)[np.asarray(coded.indices)]


def symbols(texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of words of each text, [bucket of each word's letters, bucket of its shape])."""
    counts, words, codes = split_words(texts)
    core = pc.utf8_lower(pc.replace_substring_regex(words, r"[^\p{L}\p{N}]+", ""))
    shape = words
    for pattern, sign in ((r"\p{Lu}\p{Lu}+", "XX"), (r"[\p{Ll}\p{Lo}]+", "x"), (r"\p{N}+", "9")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    return counts, [_buckets(core)[codes], _buckets(pc.binary_join_element_wise("shape", shape, ":"))[codes]]


def contexts(counts: np.ndarray, of: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Adds to out the index vectors of each symbol's neighbours in its own text, by their few entries that are not zero."""
    at = np.argsort(index == 0, axis=1, kind="stable")[:, :ONES]
    sign = np.take_along_axis(index, at, axis=1)
    text = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    for d in range(1, WINDOW + 1):
        near = text[:-d] == text[d:]
        a, b = of[:-d][near], of[d:][near]
        for own, other in ((a, b), (b, a)):
            for k in range(ONES):
                out += np.bincount(own * DIM + at[other, k], weights=sign[other, k], minlength=out.size).reshape(out.shape)


def pooled(texts: pa.Array, vectors: list[np.ndarray]) -> np.ndarray:
    """Of each text: the mean vector of its letters and of its shapes, the norms of the mean index vectors, the share of repeated neighbours, and its length."""
    counts, both = symbols(texts)
    ends = np.cumsum(counts)
    parts = []
    for of, v in zip(both, vectors):
        # each text's distinct buckets, counted, then a sum over them
        key, n = np.unique(np.repeat(np.arange(len(counts)), counts) * BUCKETS + of, return_counts=True)
        text, at = key // BUCKETS, key % BUCKETS
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
        total = np.add.reduceat(v[at] * n[:, None].astype(np.float32), first, axis=0)
        mean = np.zeros((len(counts), v.shape[1]), dtype=np.float32)
        mean[text[first]] = total / counts[text[first]][:, None]
        # how often a word repeats the one before it: the share of neighbours with equal index vectors
        text = np.repeat(np.arange(len(counts)), counts)
        again = (text[:-1] == text[1:]) & (of[:-1] == of[1:])
        parts.append((np.bincount(text[1:][again], minlength=len(counts)) / np.maximum(counts - 1, 1))[:, None])
        parts += [mean, np.linalg.norm(mean[:, :DIM], axis=1, keepdims=True), np.log1p(np.bincount(key // BUCKETS, minlength=len(counts)))[:, None]]
    return np.concatenate([*parts, np.log1p(np.diff(ends, prepend=0))[:, None]], axis=1).astype(np.float32)


@dataclass
class QualityModel:
    vectors: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum(((x - self.shift) / self.scale) @ w + b, 0) @ v + c

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)).astype(np.float64) / self.temperature, -40, 40)))


def train_network(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Adam on the cross-entropy of a ReLU layer and a sigmoid."""
    rng = np.random.default_rng(7)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), np.zeros(())]
    m, s, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            i = order[at : at + 64]
            h = x[i] @ p[0] + p[1]
            a = np.maximum(h, 0)
            e = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -40, 40))) - y[i]) / len(i)
            back = np.outer(e, p[2]) * (h > 0)
            grads = [x[i].T @ back + 1e-3 * p[0], back.sum(axis=0), a.T @ e + 1e-3 * p[2], e.sum()]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, from 0.25 to 8, of least cross-entropy."""
    grid = np.geomspace(0.25, 8, 60)
    if len(y) == 0:
        return 1.0
    loss = [np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def gathered(rows: DataFrame, index: np.ndarray) -> list[np.ndarray]:
    """Context sums of letters and shapes over all rows (text): whole numbers, so their order does not matter.

    A task's sums, exact in 32 bits up to 16 million neighbours of a symbol, are one row for each kind; they are added up in FIT_PARTS parts, whose sums are all that the driver gets.
    """
    out = arrow_schema("sums binary, k int")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((BUCKETS, DIM)) for _ in range(2)]
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, both = symbols(batch.column("text"))
                for of, x in zip(both, sums):
                    contexts(counts, of, index, x)
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes() for x in sums], pa.binary()), pa.array([0, 1], pa.int32())], schema=out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(BUCKETS * DIM) for _ in range(2)]
        for batch in batches:
            for k, x in zip(batch.column("k").to_pylist(), batch.column("sums")):
                sums[k] += np.frombuffer(x.as_buffer(), dtype=np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sums], pa.binary()), pa.array([0, 1], pa.int32())], schema=out)

    total = [np.zeros(BUCKETS * DIM) for _ in range(2)]
    for r in rows.select("text").mapInArrow(gather, "sums binary, k int").repartition(FIT_PARTS).mapInArrow(add, "sums binary, k int").toLocalIterator():
        total[r["k"]] += np.frombuffer(r["sums"])
    return [x.reshape(BUCKETS, DIM) for x in total]


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> QualityModel | None:
    """Learns labels.quality (0 or 1) from the texts of docs where learn (on docs) holds; None without labelled texts.

    Word vectors come from the texts of all of docs. Of several labels of a document the largest counts; null labels and
    ids are left out. The labelled documents are a fixed hashed share of their ids, FIT_DOCS on average at most, each with
    one text, the least where it has several. The driver gets bounded sums and one vector for each of them.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    n = known.count()
    if n == 0:
        return None
    # at most about FIT_DOCS rows of two numbers: small enough to broadcast at any size of the tables
    known = F.broadcast(known.where(hashed_share(F.col("doc_id"), FIT_DOCS / n)))
    rows = docs.where(learn & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")
    # one text of each document: copies meet in their tasks first, so one of them may be any share of the rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).select("text", "quality")
    index = index_vectors()
    sums = gathered(docs.select(F.col("text").cast("string").alias("text")), index)
    vectors = [np.concatenate([index, (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-6)).astype(np.float32)], axis=1) for c in sums]
    shared, x_schema = spark.sparkContext.broadcast(vectors), arrow_schema("x binary, y int")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = pooled(batch.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("quality")], schema=x_schema)

    # the vectors are sorted, so the order of rows does not matter
    got = sorted(((bytes(r["x"]), r["y"]) for r in rows.repartition(FIT_PARTS).mapInArrow(pool, "x binary, y int").collect()))
    if not got:
        return None
    x, y = np.stack([np.frombuffer(a, dtype=np.float32) for a, _ in got]).astype(np.float64), np.array([b for _, b in got], dtype=np.float64)
    order = np.random.default_rng(3).permutation(len(y))
    x, y = x[order], y[order]
    shift, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    cut = len(y) // HOLD
    model = QualityModel(vectors, shift, scale, train_network((x[cut:] - shift) / scale, y[cut:]), 1.0)
    model.temperature = calibrated(model.logits(x[:cut]), y[:cut])
    return model


def _scored(docs: DataFrame, model: QualityModel | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs as k0, k1 and so on, with score."""
    spark = docs.sparkSession
    rows, schema, text = carried(docs, keep)
    schema += ", score double"
    out, shared = arrow_schema(schema), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                s = np.full(batch.num_rows, 0.5) if m is None else m.score(batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s, pa.float64())], schema=out)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id with score (0 to 1) and predicted (1 where score >= THRESHOLD), from text alone.

    Null counts as empty text, which has a score too; without a model every score is 0.5. Rows are independent, repeated
    rows give repeated results, an empty table gives an empty result, other columns are not looked at.
    """
    found = _scored(docs, model, ["doc_id"])
    return found.select(F.col("k0").alias("doc_id"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of docs that score() predicts as 1, with the columns of docs, whatever their names."""
    found = _scored(docs, model, docs.columns).where(F.col("score") >= THRESHOLD)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
