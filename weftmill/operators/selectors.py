"""CSS selectors as plans over the table of nodes: predicates on a node's tag and attributes, and intervals for what holds it.

A descendant lies in an earlier match where any match before it lasts to it: a running maximum over the page. A child's
parent is joined. All selectors of a list are columns of one pass, so looking for many costs one sort of the table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .nodes import element, inside, is_text, left, with_texts

_STEP = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[#.][\w-]+|\[[^\]]+\])*)$")
_PART = re.compile(r"[#.][\w-]+|\[[^\]]+\]")
_ATTRIBUTE = re.compile(r"\[([\w-]+)(?:([*^$~]?=)\s*[\"']?(.*?)[\"']?)?\]")
_COMMA, _GAP = re.compile(r",(?![^\[]*\])"), re.compile(r"\s*>\s*(?![^\[]*\])")


def steps(selector: str) -> list[list[tuple[bool, str]]]:
    """The alternatives of a selector list, each as (whether it is a child, simple selector) from the outermost on."""
    out = []
    for one in _COMMA.split(selector):
        chain, child = [], False
        for step in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", _GAP.sub(" > ", one.strip())):
            if step == ">":
                child = True
            else:
                chain.append((child, step))
                child = False
        if not chain or child or chain[0][0]:
            raise ValueError(f"selector not understood: {one}")
        out.append(chain)
    return out


def predicate(step: str) -> Column:
    """Whether a node is what a simple selector names: tag, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], [a~=v]."""
    m = _STEP.match(step)
    if not m:
        raise ValueError(f"selector not understood: {step}")
    attrs, out = F.col("attrs"), element()
    if m["tag"] and m["tag"] != "*":
        out = out & (F.col("tag") == m["tag"].lower())
    words = lambda name: F.split(F.coalesce(attrs[name], F.lit("")), r"\s+")
    for part in _PART.findall(m["rest"]):
        if part[0] == "#":
            out = out & (attrs["id"] == part[1:])
        elif part[0] == ".":
            out = out & F.array_contains(words("class"), part[1:])
        else:
            name, op, value = _ATTRIBUTE.match(part).groups()
            a = attrs[name]
            if op is not None and op != "=" and not value:
                return F.lit(False)  # an empty part is in nothing
            out = out & {None: a.isNotNull(), "=": a == value, "*=": F.contains(a, F.lit(value)), "^=": F.startswith(a, F.lit(value)), "$=": F.endswith(a, F.lit(value)), "~=": F.array_contains(words(name), value or "")}[op]
    return F.coalesce(out, F.lit(False))


def matched(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """nodes (page, node, last, parent, tag, attrs, any others) with a boolean column for each of selectors {name: selector list}."""
    before = Window.partitionBy("page").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    rows, flags, k = nodes, {}, 0
    for name, selector in selectors.items():
        flags[name] = F.lit(False)
        for chain in steps(selector):
            now = None
            for child, step in chain:
                own = predicate(step)
                if now is not None and child:
                    up = rows.where(now).select("page", F.col("node").alias("parent"), F.lit(True).alias(f"__{k}"))
                    rows = rows.join(up, ["page", "parent"], "left")
                    own = own & F.coalesce(F.col(f"__{k}"), F.lit(False))
                elif now is not None:
                    rows = rows.withColumn(f"__{k}", F.max(F.when(now, F.col("last"))).over(before))
                    own = own & F.coalesce(F.col(f"__{k}") >= F.col("node"), F.lit(False))
                k += 1
                rows = rows.withColumn(f"__{k}", own)
                now = F.col(f"__{k}")
                k += 1
            flags[name] = flags[name] | now
    return rows.select(*nodes.columns, *[f.alias(name) for name, f in flags.items()])


def first_of(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """page, node, last of the first node that the first of the selectors with any match in the page finds."""
    names = {f"__s{k}": x for k, x in enumerate(selectors)}
    rows = matched(nodes, names)
    firsts = [F.min(F.when(F.col(name), F.struct("node", "last"))).alias(name) for name in names]
    found = rows.groupBy("page").agg(*firsts).select("page", F.coalesce(*names).alias("found")).where("found IS NOT NULL")
    return found.select("page", "found.node", "found.last")


# Where a chapter's title and text stand, in order, and the most characters of a text.
TITLE = "h1, h2, .chapter-title, .title, .page-d-name"
CONTENT = [".chapter-content", "#chapter-content", ".content", "#content", ".article-content", "#article-content", ".read-content", ".page-content section", "[class*='chapter']", "[id*='chapter']"]
MOST, TRUST = 10_000, 0.5


def plain_chapters(nodes: DataFrame) -> DataFrame:
    """page, page_id, title, content, confidence by selectors alone, for each page of parsed(): the fall-back of the extraction.

    The content is that of the first of CONTENT that the page has, or all of it: its texts, trimmed, one to a line, up to
    MOST characters. Scripts, styles and comments have no text. Pages without nodes get empty texts.
    """
    c = F.col
    rows = left(nodes, c("tag").isin("!", "script", "style", "template"))
    root = first_of(rows, CONTENT).select("page", c("node").alias("root"), c("last").alias("root_last"))
    head = first_of(rows, [TITLE]).select("page", c("node").alias("head"))
    placed = rows.join(root, "page", "left").join(head, "page", "left")
    within = is_text() & (c("root").isNull() | (c("node") > c("root")) & (c("node") <= c("root_last")))
    trimmed = F.regexp_replace(c("text"), r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")
    shown = F.collect_list(F.when(within & (trimmed != ""), F.struct("node", trimmed.alias("text"))))
    texts = placed.groupBy("page").agg(F.first("page_id").alias("page_id"), F.array_join(F.transform(F.array_sort(shown), lambda t: t["text"]), "\n").alias("content"))
    titles = with_texts(placed.select("page", "node", "last", "tag", "text", "head"), c("node") == c("head")).where(c("node") == c("head")).select("page", c("said").alias("title"))
    found = texts.join(titles, "page", "left")
    return found.select("page", "page_id", F.coalesce("title", F.lit("")).alias("title"), F.substring("content", 1, MOST).alias("content"), F.lit(TRUST).alias("confidence"))
