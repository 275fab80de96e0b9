"""Importance resampling of documents towards a target distribution over hashed n-grams, in DataFrame expressions alone.

Higher-order functions make each document's array of buckets, once; the arrays are written to the shared folder. They are
counted by a partial aggregation, so of the features only totals of at most BUCKETS buckets a task are shuffled. Scoring
aggregates over each array with the buckets' gains as one literal array, so no feature becomes a row there. The draw
sorts ids and scores alone: Gumbel noise on the weights makes the highest scores a sample without replacement.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Buckets of the hashed features, words of the longest feature, least words of a drawn document, percent drawn, seed of the noise.
BUCKETS, GRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: What parts the words, after A-Z became lower case: all of ASCII but digits and letters.
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; null has none."""
    return F.filter(F.split(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), PARTS), lambda w: w != "")


def feature_buckets(words: Column, buckets: int = BUCKETS, gram: int = GRAM) -> Column:
    """The bucket of each run of 1 to `gram` words, joined by a space: crc32 of its bytes modulo `buckets`."""
    bucket = lambda gram: (F.crc32(gram) % buckets).cast("int")

    def of(w: Column) -> Column:
        def longer(grams: Column, k: int) -> Column:
            """Buckets of the grams of k words, and of those that one more word each makes of them."""
            own = F.transform(grams, bucket)
            if k == gram:
                return own
            n = F.greatest(F.size(w) - k, F.lit(0))
            joined = F.zip_with(F.slice(grams, F.lit(1), n), F.slice(w, F.lit(k + 1), n), lambda a, b: F.concat(a, F.lit(" "), b))
            return F.concat(own, bound(joined, lambda g: longer(g, k + 1)))

        return longer(w, 1)

    return bound(words, of)


def bound(value: Column, use) -> Column:
    """use(value), where the value is made once: as the variable of a lambda over an array of it alone."""
    return F.transform(F.array(value), use)[0]


def features(texts: DataFrame, keep: tuple[str, ...] = (), buckets: int = BUCKETS, gram: int = GRAM) -> DataFrame:
    """The columns `keep` of texts as k0, k1 and so on, n_words, and the buckets of its text."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    cut = words(F.col("text").cast("string"))
    both = bound(cut, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), feature_buckets(w, buckets, gram).alias("buckets")))
    found = texts.select(*kept, both.alias("found"))
    return found.select(*[f"k{i}" for i in range(len(keep))], "found.n_words", "found.buckets")


def bucket_counts(found: DataFrame) -> dict[int, int]:
    """How many features fell in each bucket: at most as many rows as there are buckets."""
    return {r["bucket"]: r["count"] for r in found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()}


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """1000 times the log ratio of the target's and the own share of each bucket, both smoothed by one, rounded down."""
    s_all, t_all = sum(own.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * float(s_all) / ((own.get(b, 0) + 1) * float(t_all)))) for b in range(buckets)]


def gain_literal(values: list[int]) -> Column:
    """The gains as an expression of constants, which becomes one literal array in the plan."""
    return F.split(F.lit(" ".join(map(str, values))), " ").cast("array<bigint>")


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variable, rounded down, from the first 32 bits of sha256(seed:key); a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of its features' gains) and score (weight plus noise) of each row of docs."""
    found = saved(features(docs, ("doc_id",)), "features")
    gain = gain_literal(gains(bucket_counts(found), bucket_counts(features(target))))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(gain, b + 1))
    scored = found.select(F.col("k0").alias("doc_id"), "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return saved(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights", found)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, any others) with rank: 1, 2, ... for floor(percent * N / 100) rows of highest score
    among the N with `least_words` words at least; null for the others.

    Ties go to the smaller doc_id, a null doc_id last; repeated rows take a rank each. A range sort deals rows out evenly,
    whatever ties there are, and a row's rank is its place there plus the rows of earlier partitions.
    """
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("__row")]
    numbered = scored.withColumn("__row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    ranged = saved(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranks")
    part, before, parts, drawn = F.shiftright("__at", 33), 0, [], 0
    for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if(able).alias("able")).orderBy("part").collect():
        parts.append((r["part"], before))
        before, drawn = before + r["n"], drawn + r["able"]
    drawn = percent * drawn // 100
    starts = F.broadcast(scored.sparkSession.createDataFrame(parts, "part long, before long"))  # one row for each partition
    rank = F.col("before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(starts, part == F.col("part")).select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text), drawn to look like target (text).

    Words are runs of digits, letters a-z (A-Z in lower case) and anything beyond ASCII; features all runs of 1 to 3 of
    them. Null and empty texts have no features, weight 0 and no rank. Repeated rows count each, and are drawn each.
    A null doc_id counts as an empty one for its noise and loses ties. Other columns are not looked at. An empty target
    has the same share in all buckets; empty docs give an empty result.
    """
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
