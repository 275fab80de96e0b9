"""Runs of words that repeat with a period, found for all places at once by bit-parallel lags.

A text's words get ids, and each bit of the ids makes a big integer, a plane with one bit for each word. For a lag q a
plane XOR itself shifted by q has a one where that bit differs from the word q on; OR over the planes marks all places
that don't match. ANDs with shifts that double leave the places where enough matches follow one another, and the ends of
their stretches are the runs of period q. A few planes come first: where they leave no long stretch the others can't.
A text of n words takes n/4 lags of n/64 machine words a plane, one after the other: long texts cost time, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, id_crc32, slices

#: Least words of a run, and least times that its period fits in it.
LEAST, TIMES = 6, 4
#: Planes compared before the first look for long stretches.
FIRST_PLANES = 4
#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def _ones(x: int, n: int) -> np.ndarray:
    """Places of the ones among the first n bits."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little"))


def _stretches(matches: int, need: int) -> int:
    """Places from which `need` ones follow one another."""
    have = 1
    while matches and have < need:
        step = min(have, need - have)
        matches &= matches >> step
        have += step
    return matches


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the ids 0, 1, ..., by start, then period.

    A run is a stretch of smallest period q and length of at least max(least, times * q) that neither neighbour extends
    with that period. A stretch that lasts twice its lag or more has no smallest period but a divisor of the lag, at
    which it was found before with the same ends; so times must be 2 at least.
    """
    if times < 2 or least < 2:
        raise ValueError("a run holds its period twice and two words, at least")
    n = len(ids)
    if n < least:
        return []
    planes = [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(max(1, int(ids.max()).bit_length()))]
    all_places, found = (1 << n) - 1, {}
    for q in range(1, n // times + 1):
        need = max(least, times * q) - q
        if need + q > n:
            break
        places, differ, stretches = all_places >> q, 0, 0
        for part in (planes[:FIRST_PLANES], planes[FIRST_PLANES:]):
            for plane in part:
                differ |= plane ^ (plane >> q)
            if part:
                stretches = _stretches(places & ~differ, need)
            if not stretches:
                break
        if stretches:
            firsts, lasts = _ones(stretches & ~(stretches << 1), n), _ones(stretches & ~(stretches >> 1), n)
            for start, length in zip(firsts.tolist(), (lasts - firsts + need + q).tolist()):
                found.setdefault((start, length), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    start, length, period = np.array(runs, dtype=np.int64).T
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    keep = np.cumsum(change)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


def collapse_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The columns `keep` of docs, the runs of its text, array<struct<start, length, period>> by start, then period, and the
    text `collapsed`, where each run is cut to its first period and words are joined by one space.

    Words are runs of anything but ASCII white space, numbered from 0. Null and empty texts have no words and no runs and
    collapse to the empty text. Rows are independent: repeated rows give repeated results, columns that are not kept are
    not looked at, an empty table gives an empty result. Whole texts are read, however long.
    """
    rows, schema, text = carried(docs, list(keep))
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                offsets, spans, texts = [0], [], []
                for value in batch.column(text).to_pylist():
                    words = (value or "").encode().split()
                    numbers: dict[bytes, int] = {}
                    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
                    found = find_runs(ids, least, times)
                    spans += found
                    offsets.append(len(spans))
                    texts.append(b" ".join(collapsed(words, found)).decode())
                flat = np.array(spans, dtype=np.int64).reshape(-1, 3)
                fields = out.field("runs").type.value_type
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(fields)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], runs.cast(out.field("runs").type), pa.array(texts, pa.string())], schema=out)

    found = rows.mapInArrow(run, schema)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "runs", "collapsed")


def with_planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where the texts of one in ten documents, by the hash of the id, repeat with a period from some word on.

    h is the crc32 of doc_id (of the empty text, if null) and g = h div 10; where h is divisible by 10, each of the n words
    from a = g mod n on is word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Texts without words stay as they are.
    """
    h = id_crc32("doc_id")
    g = F.floor(h / 10)
    words = F.filter(F.split("text", SPACE), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % F.greatest(n, F.lit(1))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        times = F.ceil((n - a) / p)
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), times.cast("int"))), 1, (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a.cast("int")), tail), " "))

    made = F.transform(F.array(words), repeated)[0]  # the words are made once, as the lambda's variable
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(made, "text")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period) and digests of the output of collapse_runs()."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return each.selectExpr("doc_id", "n_runs", "-longest.start AS start", "longest.length AS length", "-longest.period AS period", "1000 * longest.length div -longest.period AS exponent_milli", "runs_sha256", "collapsed_sha256")
