"""Language identification: nearest clustered centroid of normalised TF-IDF character n-grams, with distance-based rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, carried, discard, saved, slices

DIM = 4096
#: Centroids and limits come from about this many different texts of each language; for the limits, those of each of FOLDS folds are held against centroids of the others.
FIT_PER_LANGUAGE, FOLDS = 500, 4
CENTROIDS, LEAST_SHARE = 4, 0.05
#: So many bytes of a text are counted at once.
PART = 1 << 20
#: A text is rejected where its cosine is below REJECT_SHARE of the REJECT_QUANTILE that held-out texts of its length and language have.
REJECT_SHARE, REJECT_QUANTILE = 0.65, 0.02
#: Lengths are classes of the binary logarithm of the number of n-grams; a class with fewer such texts takes the limit of a shorter one.
LENGTHS, LENGTH_TEXTS = 24, 20
#: The fit looks at the first so many characters of its documents too, as most are long.
STARTS = (4, 8, 16, 32, 64, 128, 256, 512)
UNKNOWN = "und"

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _hashed(code: np.ndarray) -> np.ndarray:
    return ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)


def ngram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed counts [texts, DIM] of the 1- to 3-byte n-grams of lower-cased letters; other characters are spaces, and one stands before each text.

    A longer text than PART is counted in parts, each with the two bytes that follow it, so memory does not follow its length.
    """
    rows = [f" {t}".encode() if t else b"" for t in pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()]
    out = np.zeros((len(rows), DIM), dtype=np.float32)
    parts = [(i, r[at : at + PART + 2]) for i, r in enumerate(rows) for at in range(0, len(r), PART)]
    at = 0
    while at < len(parts):
        stop, size = at, 0
        while stop < len(parts) and (stop == at or size + len(parts[stop][1]) <= PART):
            size += len(parts[stop][1]) + 2
            stop += 1
        group, at = parts[at:stop], stop
        x = _LETTER[np.frombuffer(b"  ".join(p for _, p in group) + b"  ", dtype=np.uint8)]
        long = [len(p) + 2 for _, p in group]
        of = np.repeat(np.arange(len(group)), long) * DIM
        gap, code = x == 32, x.astype(np.uint32)
        two = (code[:-1] << np.uint32(8)) | code[1:]
        three = (two[:-1] << np.uint32(8)) | code[2:]
        no2 = gap[:-1] & gap[1:]
        no3 = no2[:-1] | no2[1:]
        # what begins in the bytes that follow a part is the next part's, or between two texts
        ends = np.cumsum(long)
        after = np.concatenate([ends - 1, ends - 2, *(np.arange(e - n + PART, e - 2) for e, n in zip(ends.tolist(), long) if n > PART + 2)])
        gap[after] = True
        no2[after[after < len(no2)]] = True
        no3[after[after < len(no3)]] = True
        keys = np.concatenate([of[~gap] + _hashed(code[~gap]), of[:-1][~no2] + _hashed(two[~no2]), of[:-2][~no3] + _hashed(three[~no3])])
        counts = np.bincount(keys, minlength=len(group) * DIM).reshape(len(group), DIM)
        np.add.at(out, [i for i, _ in group], counts)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of (1 + ln count) times idf; zero where a text has no n-gram."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int).clip(0, LENGTHS - 1)


def limits(cos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The cosine below which a text is rejected, of each length class, from the cosines of one language's fitted texts."""
    out, last = np.zeros(LENGTHS), 0.0
    for j in range(LENGTHS):
        own = cos[length == j]
        if len(own) >= LENGTH_TEXTS:
            last = REJECT_SHARE * np.quantile(own, REJECT_QUANTILE)
        out[j] = last
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each centroid
    least: np.ndarray  # [language, length class]: cosines below are rejected

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest centroid's language, cosine, rejected) of each text."""
        counts = ngram_counts(texts)
        cos = weighted(counts, self.idf) @ self.centroids.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return self.owner[best], score, score < self.least[self.owner[best], length_class(counts)]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from rows at even ranks by their nearness to the mean; fewer centroids where rows are fewer or alike.

    The outermost rows start no centroid, and one of less than LEAST_SHARE of the rows goes, its rows to the others: such
    rows are often junk or of another language than their label says.
    """
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    c = x[order[((np.arange(k) + 1) * (len(x) - 1)) // k]] if len(x) > 1 else x
    c = c[[j for j in range(len(c)) if not (c[:j] @ c[j] > 0.999).any()]]
    for turn in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        if turn == rounds // 2:
            sizes = np.bincount(own, minlength=len(c))
            c = c[sizes >= min(LEAST_SHARE * len(x), sizes.max())]
            own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def frequencies(rows: DataFrame) -> np.ndarray | None:
    """Share of texts with each hashed n-gram, over all rows (lang, text) that have any: the mean of the languages' shares, so that none outweighs the others."""
    out = arrow_schema("lang string, gram int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}  # the last number counts texts

        def told() -> pa.RecordBatch:
            each = [(np.flatnonzero(n), n) for n in found.values()]
            langs = pa.array([k for k, (at, _) in zip(found, each) for _ in at], pa.string())
            return pa.RecordBatch.from_arrays([langs, pa.array(np.concatenate([at for at, _ in each]), pa.int32()), pa.array(np.concatenate([n[at] for at, n in each]))], schema=out)

        for whole in batches:
            for part in slices(whole, "text"):
                for at in range(0, part.num_rows, 128):
                    some = ngram_counts(part.column("text").slice(at, 128)) > 0
                    coded = part.column("lang").slice(at, 128).dictionary_encode()
                    which = np.asarray(coded.indices)
                    for k, lang in enumerate(coded.dictionary.to_pylist()):
                        n, own = found.setdefault(lang, np.zeros(DIM + 1, dtype=np.int64)), some[which == k]
                        n[:DIM] += np.count_nonzero(own, axis=0)
                        n[DIM] += np.count_nonzero(own.any(axis=1))
                if len(found) > 200:
                    yield told()
                    found.clear()
        if found:
            yield told()

    each = saved(rows.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "frequencies")
    texts = each.where(F.col("gram") == DIM).select("lang", F.col("n").alias("texts"))
    got = each.where(F.col("gram") < DIM).join(texts, "lang").groupBy("gram").agg(F.sum(F.col("n") / F.col("texts")).alias("share")).collect()
    languages = texts.count()
    discard(each)
    if not languages:
        return None
    share = np.zeros(DIM)
    for r in got:
        share[r["gram"]] = r["share"] / languages
    return share


def _learned(texts: pa.Array, fold: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(centroids, limits) of one language; None where its texts have no n-gram."""
    counts = ngram_counts(texts)
    some = counts.any(axis=1)
    if not some.any():
        return None
    texts, counts, fold = texts.filter(pa.array(some)), counts[some], fold[some]
    x, cos, length = weighted(counts, idf), [], []
    for k in np.unique(fold):
        own, others = fold == k, fold != k
        centroids = cluster(x[others if others.any() else own], CENTROIDS)
        for n in (None, *STARTS):
            short = counts[own] if n is None else ngram_counts(pc.utf8_slice_codeunits(texts.filter(pa.array(own)), 0, n))
            short = short[short.any(axis=1)]
            cos.append((weighted(short, idf) @ centroids.T).max(axis=1))
            length.append(length_class(short))
    return cluster(x, CENTROIDS), limits(np.concatenate(cos), np.concatenate(length))


def fit(docs: DataFrame, learn: Column) -> LanguageModel | None:
    """Learns from the rows of docs (doc_id, text, lang) where learn holds and lang is not null; None where there are none.

    Document frequencies are those of all such rows, each language counting the same. Centroids and limits come from a
    fixed hashed share of each language's different texts, FIT_PER_LANGUAGE on average at most and all of them where they
    are fewer, each language in one task; the limits from texts, and starts of texts, that the centroids they are held
    against have not seen. The driver gets the frequencies and each language's centroids and limits, 64 KB a language.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    share = frequencies(rows)
    if share is None:
        return None
    idf = np.round(1 - np.log(np.maximum(share, 1e-4)), 6).astype(np.float32)
    # different texts of each language: one row for each language, as in the model, which is broadcast too
    keyed = rows.withColumn("key", F.xxhash64("text"))
    sizes = keyed.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n long"))
    turn = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 30))
    chosen = keyed.join(sizes, "lang").where(turn < F.lit(float(FIT_PER_LANGUAGE << 30)) / F.col("n"))
    # copies meet in their tasks first, so one text may be any share of the rows
    chosen = chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", F.xxhash64("key").alias("turn"), "text")
    chosen = chosen.repartition("lang").sortWithinPartitions("lang", "turn", "text")
    schema = "lang string, centroids binary, least binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(lang: str, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).combine_chunks()
            texts = own.column("text").combine_chunks()
            found = _learned(texts, np.asarray(own.column("turn")) % FOLDS, idf)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found[0].astype(np.float32).tobytes()]), pa.array([found[1].tobytes()])], schema=out)

        now, held = None, []
        for batch in batches:  # sorted by language
            langs = batch.column("lang").to_pylist()
            cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and b > a and langs[a] != now:
                    yield from done(now, held)
                    held = []
                if b > a:
                    now = langs[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done(now, held)

    got = sorted(chosen.mapInArrow(run, schema).collect(), key=lambda r: r["lang"])
    if not got:
        return None
    parts = [np.frombuffer(r["centroids"], dtype=np.float32).reshape(-1, DIM) for r in got]
    least = np.stack([np.frombuffer(r["least"]) for r in got])
    return LanguageModel([r["lang"] for r in got], idf, np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), least)


def _identified(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs as k0, k1 and so on, with lang_pred, score and rejected."""
    spark = docs.sparkSession
    rows, schema, text = carried(docs, keep)
    schema += ", lang_pred string, score double, rejected boolean"
    out, shared = arrow_schema(schema), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in slices(whole, text):
                for at in range(0, part.num_rows, 128):
                    batch = part.slice(at, 128)
                    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(batch.column(text), r"\p{L}"), False))
                    if m is None:
                        which, score, far = np.zeros(batch.num_rows, dtype=int), np.zeros(batch.num_rows), np.ones(batch.num_rows, dtype=bool)
                        lettered = np.zeros(batch.num_rows, dtype=bool)
                    else:
                        which, score, far = m.predict(batch.column(text))
                    names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(which, lettered)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(far | ~lettered)], schema=out)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id with lang_pred, score (0 to 1, the cosine) and rejected, from text alone.

    Null text and text without a letter give `und`, 0 and rejected, as does every text where model is None. Rows are
    independent: repeated rows give repeated results, ties go to the first centroid, an empty table gives an empty
    result, other columns are not looked at and whole texts are read.
    """
    return _identified(docs, model, ["doc_id"]).select(F.col("k0").alias("doc_id"), "lang_pred", "score", "rejected")


def recognised(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs that identify() does not reject, with the columns of docs, whatever their names."""
    found = _identified(docs, model, docs.columns).where("NOT rejected")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
