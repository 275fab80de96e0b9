"""Scores of a page's nodes, headings and results as Column expressions over tables of nodes, and their propagation and union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of element names and of the parts of a score.
TAG_WEIGHT = {"article": 1.6, "main": 1.6, "section": 1.05, "div": 1.0, "td": 0.85, "body": 0.75}
OTHER_WEIGHT = 0.6
CHROME_FACTOR = {"nav": 0.2, "footer": 0.2, "aside": 0.2, "header": 0.5}
HEADING_BONUS = {"h1": 25, "h2": 15, "h3": 8}
DENSE = ["div", "section", "article", "main", "td", "center", "body"]
LEAST_CHARS, LEAST_MARKED, MOST_LINKED = 60, 120, 0.35


def _by(tag: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, value in values.items():
        out = F.when(tag == name, F.lit(float(value))).otherwise(out)
    return out


def ratio(part: Column, whole: Column, none: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(none))


def link_density(link_chars: Column, chars: Column) -> Column:
    return F.least(F.lit(1.0), ratio(link_chars, chars, 1.0))


def density_score(chars: Column, tags: Column, p_chars: Column, paras: Column, brs: Column, long_chars: Column, link_chars: Column, texts: Column, short_texts: Column, tag: Column, hint: Column, parent_hint: Column, negative: Column) -> Column:
    """Text for each tag, weighted by length, paragraphs, long texts, links, short texts, name and marks; 0 below LEAST_CHARS."""
    p_ratio, long_ratio = F.least(ratio(p_chars, chars, 0.0), F.lit(1.0)), F.least(ratio(long_chars, chars, 0.0), F.lit(1.0))
    density, short, average = link_density(link_chars, chars), ratio(short_texts, texts, 0.0), ratio(p_chars, paras, 0.0)
    score = chars / tags * F.log10(chars + F.lit(10)) * (1 + 1.5 * p_ratio)
    score = score * F.when(average >= 80, 1.15).otherwise(1.0) * F.when(average >= 200, 1.15).otherwise(1.0)
    score = score * (1 + 0.02 * F.least(paras + F.floor(brs / 2), F.lit(30))) * (1 + 0.6 * long_ratio)
    score = score * F.when(density > 0, F.greatest(F.lit(0.05), (1 - density) * (1 - density))).otherwise(1.0)
    score = score * F.when(ratio(p_chars, chars, 0.0) < 0.4, F.greatest(F.lit(0.3), 1 - 0.7 * short)).otherwise(F.greatest(F.lit(0.6), 1 - 0.3 * short))
    score = score * _by(tag, TAG_WEIGHT, OTHER_WEIGHT) * F.when(hint, 1.5).otherwise(1.0) * F.when(parent_hint, 1.1).otherwise(1.0)
    score = score * F.when(negative, 0.25).otherwise(1.0) * _by(tag, CHROME_FACTOR, 1.0)
    return F.when(chars >= LEAST_CHARS, score).otherwise(0.0)


def leaf_score(chars: Column, marks: Column, link_chars: Column, negative: Column) -> Column:
    """What a text leaf hands up: 0 below 5 characters; more for length and punctuation, less for links, little text and marks."""
    rest = 1 - link_density(link_chars, chars)
    score = (1 + F.least(chars / 100, F.lit(6.0)) + F.least(marks / 5, F.lit(3.0))) * rest * rest
    score = score * F.when(chars < 20, 0.3).otherwise(1.0) * F.when(negative, 0.15).otherwise(1.0)
    return F.when(chars >= 5, score).otherwise(0.0)


def handed_up(leaves: DataFrame, nodes: DataFrame, page: str = "page_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """page, node, score and the columns `carry` of nodes: what leaves (page, score, parent, grandparent) hand to nodes (page, node, tag, hint, negative, main).

    The parent gets a leaf's score, the grandparent half of it; navigation, footers, headers and asides get none. Sums are
    partial before the shuffle, so a node may hold any share of the leaves.
    """
    shares = F.array(F.struct(F.col("parent").alias("node"), F.col("score").alias("part")), F.struct(F.col("grandparent").alias("node"), (F.col("score") * 0.5).alias("part")))
    each = leaves.where("score > 0").select(page, F.inline(shares)).where("node IS NOT NULL")
    sums = each.groupBy(page, "node").agg(F.sum("part").alias("sums"))
    factor = F.when(F.col("hint"), 1.4).otherwise(1.0) * F.when(F.col("negative"), 0.2).otherwise(1.0) * F.when((F.col("tag") == "article") | F.col("main"), 1.5).otherwise(1.0)
    kept = nodes.where(~F.col("tag").isin(*CHROME_FACTOR)).select(page, "node", *carry, factor.alias("factor"))
    return sums.join(kept, [page, "node"]).select(page, "node", *carry, (F.col("sums") * F.col("factor")).alias("score"))


def density_candidates(nodes: DataFrame) -> DataFrame:
    """The containers among nodes (tag, chars) that have enough text, and so a density score above 0: no filter has to work it out again."""
    return nodes.where(F.col("tag").isin(*DENSE) & (F.col("chars") >= LEAST_CHARS))


def marked_candidates(nodes: DataFrame) -> DataFrame:
    """The articles and main parts among nodes (tag, main, chars, link_density, negative) that look like content; their density score is above 0."""
    marked = F.col("tag").isin("article", "main") | F.col("main")
    return nodes.where(marked & (F.col("chars") >= LEAST_MARKED) & (F.col("link_density") <= MOST_LINKED) & ~F.col("negative"))


def first_of_each(nodes: DataFrame, up: DataFrame, page: str = "page_id") -> DataFrame:
    """page, node, chars, score and kind of the candidates among nodes (page, node, tag, main, chars, link_density, negative,
    score: the density score), one of each node: marked (0), else dense (1), else as up (page, node, chars, score) has it from its leaves (2).

    A row has one kind, so nodes are read once; what is first of each node is found before the shuffle as far as it can be.
    """
    c = F.col
    marked = (c("tag").isin("article", "main") | c("main")) & (c("chars") >= LEAST_MARKED) & (c("link_density") <= MOST_LINKED) & ~c("negative")
    kind = F.when(marked, 0).when(c("tag").isin(*DENSE), 1)
    own = nodes.where(c("chars") >= LEAST_CHARS).select(page, "node", "chars", "score", kind.alias("kind")).where("kind IS NOT NULL")
    rows = own.unionByName(up.where(c("chars") >= LEAST_CHARS).select(page, "node", "chars", "score", F.lit(2).alias("kind")))
    first = F.min_by(F.struct("chars", "score", "kind"), F.struct("kind", F.negative("score"))).alias("first")
    return rows.groupBy(page, "node").agg(first).select(page, "node", "first.*")


def chosen(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """page, node, margin: the best of each page's candidates (page, node, last, chars, score), and how far it stands above another.

    Equal scores go by node. Of the next eleven, the first one inside the best with 90 % of its score and 65 % of its text
    takes its place. The other is the best candidate that neither holds the chosen one nor lies in it, else the next one.
    A page's candidates are compared within its own group, sorted by score.
    """
    fields = F.struct(F.negative("score").alias("order"), "node", "last", "chars", "score")
    rows = candidates.groupBy(page).agg(F.array_sort(F.collect_list(fields)).alias("found"))
    first = F.col("found")[0]
    inside = lambda a, b: (a["node"] < b["node"]) & (b["node"] <= a["last"])
    finer = F.filter(F.slice("found", 2, 11), lambda c: inside(first, c) & (c["score"] >= 0.9 * first["score"]) & (c["chars"] >= 0.65 * first["chars"]))
    rows = rows.withColumn("best", F.coalesce(F.get(finer, F.lit(0)), first))
    best = F.col("best")
    rest = F.filter("found", lambda c: c["node"] != best["node"])
    apart = F.filter(rest, lambda c: ~inside(c, best) & ~inside(best, c))
    second = F.coalesce(F.get(apart, F.lit(0)), F.get(rest, F.lit(0)))["score"]
    margin = F.when(second.isNull() | (best["score"] <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (best["score"] - second) / best["score"])))
    return rows.select(page, best["node"].alias("node"), margin.alias("margin"))


def heading_score(chars: Column, tag: Column, hint: Column, negative: Column, chapter: Column, within_negative: Column) -> Column:
    """How well a heading would do as the title; -1 unless it has 2 to 150 characters."""
    bonus = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    score = chars + _by(tag, HEADING_BONUS, 0) + bonus(hint, 20) - bonus(negative, 30) + bonus(chapter, 40) - bonus(within_negative, 60)
    return F.when(chars.between(2, 150), score).otherwise(-1.0)


def confidence(total: Column, page_chars: Column, p_ratio: Column, long_ratio: Column, density: Column, margin: Column, merged: Column, negative: Column, hint: Column, final_chars: Column) -> Column:
    """Trust in a result, 0 to 0.95, from the chosen candidates' sums and what was left of them."""
    share = ratio(total, page_chars, 0.0)
    middle = F.least(F.lit(1.0), F.greatest(F.lit(0.3), 1 - F.abs(share - 0.35) / 0.65))
    page = F.when(page_chars <= 0, 0.8).when(share > 0.95, 0.3).otherwise(middle)
    text = 0.35 + 0.65 * F.least(F.lit(1.0), F.greatest(p_ratio, 0.8 * long_ratio))
    core = 0.3 * F.least(F.lit(1.0), total / 1200) + 0.35 * text + 0.2 * (0.55 + 0.45 * F.least(F.lit(1.0), 2 * margin)) + 0.15 * page
    core = core * F.greatest(F.lit(0.0), 1 - 1.5 * density) * F.when(merged, 0.75).otherwise(1.0) * F.when(negative, 0.7).otherwise(1.0) * F.when(hint, 1.05).otherwise(1.0)
    core = F.when(total > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.0), core))).otherwise(0.0)
    return core * F.least(F.lit(1.0), final_chars / 150)
