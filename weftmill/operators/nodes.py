"""Page extraction over a table of nodes: features, candidates, choice, title, cleaning, text and confidence as DataFrame plans.

A parsed page is rows of a table in document order; `last` is the last node of a row's subtree. Two running sums give the
sum over every subtree without a join: over the nodes that close up to a node's end, less over those that open before it.
What both leave out or count twice are the node's ancestors, which hold no text of their own. A deletion is an interval
too: a node goes if any node at or before it that is to be dropped lasts to it, which is a running maximum. So the passes
of the cleaning are windows over one partitioning by page: the table is shuffled once, whatever passes follow.

`page` is a key of each row of pages, so that repeated page_ids do not meet. Rows of node -1 stand for the pages themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from . import extract as E
from .batches import slices
from .dom import Page
from .storage import saved

#: Ancestors that a row names, nearest first: as many as a heading's surroundings are looked at.
UPS = 6
RAW = f"page long, page_id long, url string, node int, last int, parent int, depth int, line int, tag string, attrs map<string,string>, text string, links int, paras int, ups array<struct<node: int, tag: string, names: string>>"
LEAVES = ["p", "pre", "blockquote"]


def _in_page(*order: str | Column):
    return Window.partitionBy("page").orderBy(*(order or ("node",)))


def _before():
    return _in_page().rowsBetween(Window.unboundedPreceding, -1)


def _to_here():
    return _in_page().rowsBetween(Window.unboundedPreceding, 0)


def _from_here():
    return _in_page().rowsBetween(0, Window.unboundedFollowing)


def _closed():
    return _in_page("last", F.desc("node")).rowsBetween(Window.unboundedPreceding, 0)


def _whole():
    return Window.partitionBy("page")


def element() -> Column:
    return ~F.col("tag").isin("", "!", "#")


def is_text() -> Column:
    return F.col("tag") == ""


def _java(pattern) -> str:
    """A pattern of the extraction for rlike: letters, digits and white space of all scripts."""
    return "(?iuU)" + pattern.pattern


def names(attrs: Column) -> Column:
    """What an element's attributes call it, in lower case."""
    return F.lower(F.array_join(F.filter(F.array(*[attrs[k] for k in E.NAMES]), lambda x: x.isNotNull() & (x != "")), " "))


def parsed(pages: DataFrame) -> DataFrame:
    """The nodes of each row of pages (page_id, url, html), RAW: elements, texts (tag ''), comments (tag '!') and a row '#' for the page itself.

    links and paras count the a and p elements around a node, itself included. Null html gives the page's row alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(RAW))

    def ragged(lists: list[list], values: pa.Array, kind: pa.DataType) -> pa.Array:
        ends = [0]
        for x in lists:
            ends.append(ends[-1] + len(x))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values).cast(kind)

    def table(key: int, page_id: int | None, url: str | None, html: str) -> pa.RecordBatch:
        p = Page(html)
        n = len(p.tag)
        called = [" ".join(a[k] for k in E.NAMES if a.get(k)).lower() if a else "" for a in p.attrs]
        ups: list[list[int]] = [[]]
        links, paras = [0], [0]
        for i in range(n):
            up = p.parent[i]
            ups.append([up, *ups[up + 1]][:UPS] if up >= 0 else [])
            links.append((links[up + 1] if up >= 0 else 0) + (p.tag[i] == "a"))
            paras.append((paras[up + 1] if up >= 0 else 0) + (p.tag[i] == "p"))
        flat = [u for x in ups for u in x]
        kinds = {f.name: f.type for f in out}
        struct = kinds["ups"].value_type
        around = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array([p.tag[u] for u in flat], pa.string()), pa.array([called[u] for u in flat], pa.string())], fields=list(struct))
        attrs = [{}, *p.attrs]
        ends = [0]
        for a in attrs:
            ends.append(ends[-1] + len(a))
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
        columns = [
            pa.array([key] * (n + 1), pa.int64()), pa.array([page_id] * (n + 1), pa.int64()), pa.array([url] + [None] * n, pa.string()), pa.array(range(-1, n), pa.int32()), pa.array([n - 1, *p.last], pa.int32()),
            pa.array([None, *(u if u >= 0 else None for u in p.parent)], pa.int32()), pa.array([0, *p.depth], pa.int32()), pa.array([0, *p.line], pa.int32()), pa.array(["#", *p.tag], pa.string()), maps.cast(kinds["attrs"]),
            pa.array([None, *(x if t == "" else None for t, x in zip(p.tag, p.text))], pa.string()), pa.array(links, pa.int32()), pa.array(paras, pa.int32()), ragged(ups, around, kinds["ups"]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            for key, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page", "page_id", "url", "html"))):
                yield table(key, page_id, url, html or "")

    rows = pages.select(F.monotonically_increasing_id().alias("page"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, RAW)


def left(rows: DataFrame, dropped: Column) -> DataFrame:
    """rows without the subtrees of those that are `dropped`."""
    return rows.withColumn("__to", F.max(F.when(dropped, F.col("last"))).over(_to_here())).where(F.col("__to").isNull() | (F.col("__to") < F.col("node"))).drop("__to")


def inside(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with the sums of values over each subtree, itself included; only where all ancestors of a row have the value 0 are they that."""
    rows = rows.withColumns({f"__{k}": v for k, v in values.items()})
    sums = {k: F.sum(f"__{k}").over(_closed()) - F.coalesce(F.sum(f"__{k}").over(_before()), F.lit(0)) for k in values}
    return rows.withColumns(sums).drop(*[f"__{k}" for k in values])


def hidden(attrs: Column) -> Column:
    style = F.coalesce(attrs["style"], F.lit(""))
    return F.map_contains_key(attrs, "hidden") | (F.lower(F.coalesce(attrs["aria-hidden"], F.lit(""))) == "true") | style.rlike(_java(E.HIDDEN_STYLE)) | names(attrs).rlike(_java(E.HIDDEN_NAME))


def pre_cleaned(nodes: DataFrame) -> DataFrame:
    """nodes without comments, elements that show no text, hidden ones and those of navigating roles; a head stays for its metadata."""
    attrs = F.col("attrs")
    silent = F.col("tag").isin("!", "title", *sorted(E.SILENT))
    role = F.lower(F.coalesce(attrs["role"], F.lit(""))).isin(*sorted(E.ROLES))
    return left(nodes, silent | element() & (F.col("tag") != "head") & (hidden(attrs) | role))


def _counted(rows: DataFrame) -> DataFrame:
    """rows with the sums that lengths and densities are made of: chars, p_chars, link_chars."""
    n = F.when(is_text(), T.scoring_length(F.col("text"))).otherwise(0)
    rows = rows.withColumn("__n", n)
    rows = inside(rows, chars=F.col("__n"), link_chars=F.col("__n") * F.col("links"), p_chars=F.col("__n") * F.col("paras"))
    return rows.withColumns({"link_chars": F.col("link_chars") - F.col("links") * F.col("chars"), "p_chars": F.col("p_chars") - F.col("paras") * F.col("chars")})


def featured(nodes: DataFrame) -> DataFrame:
    """The nodes with what their scores are made of: chars, tags, p_chars, paras, brs, long_chars, link_chars, texts, short_texts, content, marks, link_content, hint, parent_hint, negative, main."""
    n, text = F.col("__n"), F.col("text")
    is_p, shown = F.col("tag") == "p", is_text() & (T.norm(text) != "")
    rows = _counted(nodes).withColumn("__c", F.when(is_text(), T.content_chars(text)).otherwise(0))
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = inside(
        rows, tags=one(element()), paras_in=one(is_p), brs=one(F.col("tag") == "br"), long_chars=F.when(n >= 60, n).otherwise(0), texts=one(shown), short_texts=one(shown & n.between(1, 30)),
        content=F.col("__c"), marks=F.when(is_text(), T.punctuation_count(text)).otherwise(0), link_content=F.col("__c") * F.col("links"),
    )
    called = names(F.col("attrs"))
    up = F.get("ups", F.lit(0))["names"]
    return rows.withColumns(
        {
            # elements and paragraphs are their own kind's ancestors: those were counted before the node and not after it
            "tags": F.col("tags") + F.col("depth"), "paras": F.col("paras_in") + F.col("paras") - 2 * one(is_p), "link_content": F.col("link_content") - F.col("links") * F.col("content"),
            "hint": called.rlike(_java(E.HINT)), "negative": called.rlike(_java(E.NEGATIVE)), "parent_hint": F.coalesce(up.rlike(_java(E.HINT)), F.lit(False)), "main": F.coalesce(F.col("attrs")["role"] == "main", F.lit(False)),
            "within": F.col("paras"),
        }
    ).drop("paras_in", "__n", "__c")


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where(element())


def leaves(featured: DataFrame) -> DataFrame:
    """page, node, score, parent, grandparent of the elements whose text speaks for itself: paragraphs, and divisions and spans with text of their own."""
    own = featured.where(is_text() & F.get("ups", F.lit(0))["tag"].isin("div", "span")).groupBy("page", F.col("parent").alias("node")).agg(F.sum("content").alias("own"))
    own = own.where(F.col("own") >= E.LEAST_OWN)
    rows = elements(featured).where(F.col("tag").isin(*LEAVES, "div", "span") & (F.col("content") >= E.LEAST_LEAF)).join(own, ["page", "node"], "left")
    rows = rows.where(F.col("tag").isin(*LEAVES) | F.col("own").isNotNull())
    score = S.leaf_score(F.col("content"), F.col("marks"), F.col("link_content"), F.col("negative"))
    return rows.select("page", "page_id", "node", score.alias("score"), "parent", F.get("ups", F.lit(1))["node"].alias("grandparent"))


CANDIDATE = ["page", "page_id", "node", "last", "parent", "grandparent", "line", "chars", "p_ratio", "long_ratio", "link_density", "hint", "negative"]


def candidates(featured: DataFrame) -> DataFrame:
    """CANDIDATE, kind (0 marked, 1 dense, 2 by what leaves hand up) and score of the candidates of each page, one of each node: that of the first kind.

    The body counts as dense, or else the html element or the first one that nothing holds.
    """
    c = F.col
    first = lambda cond: F.min(F.when(cond, c("node"))).over(_whole())
    top = F.coalesce(first(c("tag") == "body"), first(c("tag") == "html"), first(c("parent").isNull()))
    score = S.density_score(*map(c, "chars tags p_chars paras brs long_chars link_chars texts short_texts tag hint parent_hint negative".split()))
    rows = elements(featured).withColumn("whole", c("node") == top).where(c("chars") >= S.LEAST_CHARS)
    rows = rows.withColumns(
        {"density": score, "link_density": S.link_density(c("link_chars"), c("chars")), "p_ratio": S.ratio(c("p_chars"), c("chars"), 0.0), "long_ratio": S.ratio(c("long_chars"), c("chars"), 0.0), "grandparent": F.get("ups", F.lit(1))["node"]}
    )
    up = S.handed_up(leaves(featured), elements(featured), "page").select("page", "node", c("score").alias("handed"))
    rows = rows.join(up, ["page", "node"], "left")
    marked = (c("tag").isin("article", "main") | c("main")) & (c("chars") >= S.LEAST_MARKED) & (c("link_density") <= S.MOST_LINKED) & ~c("negative")
    kind = F.when(marked, 0).when(c("tag").isin(*S.DENSE) | c("whole"), 1).when(c("handed").isNotNull(), 2)
    rows = rows.withColumn("kind", kind).withColumn("score", F.when(c("kind") == 2, c("handed")).otherwise(c("density")))
    return rows.where(c("kind").isNotNull() & (c("score") > 0)).select(*CANDIDATE, "kind", "score")


def chosen(candidates: DataFrame) -> DataFrame:
    """page, page_id, margin and roots of each page that has candidates: the chosen one, or those that are merged, in the order of their lines.

    Candidates go by score, kind and node. Of the next eleven the first one inside the best with 90 % of its score and
    65 % of its text takes its place. The margin is what it has over the best one that neither holds it nor lies in it,
    else over the next one. Where it has little text or little margin, the ten best are folded into a group without any
    that holds another, and take its place if they have a quarter more text and one parent or grandparent.
    """
    fields = F.struct(F.negative("score").alias("order"), "kind", "node", "score", *[x for x in CANDIDATE if x not in ("page", "page_id", "node")])
    rows = candidates.groupBy("page").agg(F.first("page_id").alias("page_id"), F.array_sort(F.collect_list(fields)).alias("found"))
    holds = lambda a, b: (a["node"] <= b["node"]) & (b["node"] <= a["last"])
    apart = lambda a, b: ~holds(a, b) & ~holds(b, a)
    first = F.col("found")[0]
    finer = F.filter(F.slice("found", 2, 11), lambda c: holds(first, c) & (c["score"] >= 0.9 * first["score"]) & (c["chars"] >= 0.65 * first["chars"]))
    rows = rows.withColumn("best", F.coalesce(F.get(finer, F.lit(0)), first))
    best = F.col("best")
    rest = F.filter("found", lambda c: c["node"] != best["node"])
    second = F.coalesce(F.get(F.filter(rest, lambda c: apart(c, best)), F.lit(0)), F.get(rest, F.lit(0)))["score"]
    rows = rows.withColumn("margin", F.when(second.isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (best["score"] - second) / best["score"]))))
    enough = F.filter(F.slice("found", 1, 10), lambda c: (c["score"] >= 0.35 * best["score"]) & (c["chars"] >= 80))
    rows = rows.withColumn("group", F.aggregate(enough, F.slice("found", 1, 0), lambda held, c: F.when(F.forall(held, lambda g: apart(c, g)), F.concat(held, F.array(c))).otherwise(held)))
    group = F.col("group")
    of = lambda name: F.size(F.array_distinct(F.transform(group, lambda c: F.coalesce(c[name], F.lit(-1))))) == 1
    text = F.aggregate(group, F.lit(0).cast("long"), lambda n, c: n + c["chars"])
    merged = ((best["chars"] < 300) | (F.col("margin") < 0.25)) & (F.size(group) >= 2) & (text > 1.25 * best["chars"]) & (of("parent") | of("grandparent"))
    by_line = F.transform(F.array_sort(F.transform(group, lambda c, i: F.struct(c["line"].alias("line"), i.alias("at"), c.alias("c")))), lambda x: x["c"])
    return rows.select("page", "page_id", "margin", F.when(merged, by_line).otherwise(F.array(best)).alias("roots"))


def with_texts(rows: DataFrame, of: Column, name: str = "said") -> DataFrame:
    """rows with the text of each of those that `of` names, white space as single spaces; null for the others.

    The texts of a page are one array there, and a node's are a slice of it, by how many come before and how many are inside.
    """
    shown = is_text() & (F.trim("text") != "")
    rows = inside(rows, __in=F.when(shown, 1).otherwise(0)).withColumns({"__before": F.coalesce(F.sum(F.when(shown, 1).otherwise(0)).over(_before()), F.lit(0)), "__of": of})
    columns = [x for x in rows.columns if x != "page"]
    packed = rows.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.when(shown, F.struct("node", "text")))), lambda t: t["text"]).alias("__texts"), F.collect_list(F.struct(*columns)).alias("__rows"))
    said = lambda r: F.when(r["__of"], T.norm(F.array_join(F.slice(F.col("__texts"), (r["__before"] + 1).cast("int"), r["__in"].cast("int")), " ")))
    back = F.transform("__rows", lambda r: F.struct(*[r[x].alias(x) for x in columns if not x.startswith("__")], said(r).alias(name)))
    return packed.select("page", F.inline(back))


# titles
def siteish(part: Column, url: Column) -> Column:
    """A part of a title that names a site: by the host's own words or by an ending that sites have."""
    low, chars = F.lower(F.trim(part)), T.scoring_length(part)
    own = F.exists(T.host_tokens(url), lambda t: (F.length(t) >= 4) & F.rlike(low, F.concat(F.lit(r"(?U)\b"), t, F.lit(r"\b"))) | F.contains(F.replace(low, F.lit(" "), F.lit("")), t) & (chars <= 12))
    return F.coalesce(own, F.lit(False)) | (chars <= 25) & low.rlike(_java(E.SITE_END)) | (chars <= 12) & low.rlike(_java(E.SITE_END_ZH))


def clean_title(raw: Column, url: Column) -> Column:
    """A title without the parts at its ends that name the site; where all do, the longest one."""
    raw = T.norm(raw)
    parts = F.filter(F.transform(F.split(raw, "(?U)" + E.SEPARATORS.pattern), lambda x: T.norm(x)), lambda x: x != "")
    marked = F.transform(parts, lambda x: F.struct(x.alias("part"), siteish(x, url).alias("site"), T.scoring_length(x).alias("chars")))

    def trimmed(own: Column) -> Column:
        kept = F.transform(own, lambda x: x["part"])
        longest = F.element_at(F.array_sort(F.transform(own, lambda x, i: F.struct(-x["chars"], i, x["part"].alias("part")))), 1)["part"]
        heads = F.aggregate(own, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x["site"], 1).otherwise(0)).alias("n"), (s["go"] & x["site"]).alias("go")), lambda s: s["n"])
        tails = F.aggregate(F.reverse(own), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + F.when(s["go"] & x["site"], 1).otherwise(0)).alias("n"), (s["go"] & x["site"]).alias("go")), lambda s: s["n"])
        some = F.array_join(F.slice(kept, heads + 1, F.greatest(F.size(own) - heads - tails, F.lit(0))), " - ")
        return F.when(F.size(own) < 2, raw).when(F.forall(own, lambda x: x["site"]), longest).when(heads + tails == 0, raw).otherwise(some)

    return F.transform(F.array(marked), trimmed)[0]  # the parts are made once, as the lambda's variable


def headings(featured: DataFrame) -> DataFrame:
    """page, page_id, node, last, parent, tag, said, chars and score of the headings of the first three levels."""
    rows = with_texts(featured.select("page", "page_id", "node", "last", "parent", "tag", "text", "ups", "hint", "negative"), F.col("tag").isin("h1", "h2", "h3"))
    rows = rows.where(F.col("tag").isin("h1", "h2", "h3")).withColumn("chars", T.scoring_length(F.col("said")))
    body = F.array_position(F.transform("ups", lambda u: u["tag"]), "body").cast("int")
    near = F.when(body > 0, F.slice("ups", F.lit(1), F.greatest(body - 1, F.lit(0)))).otherwise(F.col("ups"))
    poor = F.exists(near, lambda u: u["tag"].isin("nav", "footer", "aside") | u["names"].rlike(_java(E.NEGATIVE)) & ~u["names"].rlike(_java(E.HINT)))
    score = S.heading_score(F.col("chars"), F.col("tag"), F.col("hint"), F.col("negative"), F.col("said").rlike(_java(E.CHAPTER)), poor)
    return rows.select("page", "page_id", "node", "last", "parent", "tag", "said", "chars", score.alias("score"))


def titles(nodes: DataFrame, featured: DataFrame, choice: DataFrame) -> DataFrame:
    """page, page_id, title of every page: from headings near the chosen one, else metadata, else the best heading, else the title element."""
    c = F.col
    heads = headings(featured).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("node", "last", "parent", "tag", "said", "chars", "score"))).alias("heads"))
    first_title = F.min(F.when(c("tag") == "title", c("node"))).over(_whole())
    marked = nodes.withColumn("__t", first_title).withColumn("__t_last", F.max(F.when(c("node") == c("__t"), c("last"))).over(_whole()))
    meta = F.when(c("tag") == "meta", F.struct("node", F.col("attrs")["property"].alias("property"), F.col("attrs")["name"].alias("name"), F.coalesce(F.col("attrs")["content"], F.lit("")).alias("content")))
    in_title = F.when(is_text() & (c("node") > c("__t")) & (c("node") <= c("__t_last")), F.struct("node", "text"))
    per_page = marked.groupBy("page").agg(
        F.first("page_id").alias("page_id"), F.max("url").alias("url"), F.array_sort(F.collect_list(meta)).alias("metas"), F.array_join(F.transform(F.array_sort(F.collect_list(in_title)), lambda t: t["text"]), " ").alias("page_title")
    )
    root = choice.select("page", F.col("roots")[0]["node"].alias("root"), F.col("roots")[0]["last"].alias("root_last"))
    ups = featured.select("page", F.col("node").alias("root"), F.slice("ups", 1, 3).alias("root_ups"))
    rows = per_page.join(heads, "page", "left").join(root.join(ups, ["page", "root"], "left"), "page", "left").withColumn("heads", F.coalesce("heads", F.slice("heads", 1, 0), F.array().cast("array<struct<node:int,last:int,parent:int,tag:string,said:string,chars:int,score:double>>")))
    best = lambda among, least: F.get(F.array_sort(F.transform(F.filter(among, lambda h: h["score"] > least), lambda h, i: F.struct((-h["score"]).alias("s"), i.alias("i"), h["said"].alias("said"), h["chars"].alias("chars")))), F.lit(0))
    at, end = c("root"), c("root_last")
    within = F.filter("heads", lambda h: (h["node"] >= at) & (h["node"] <= end))
    earlier = F.filter("heads", lambda h: (h["node"] < at) & (h["last"] < at))
    earlier = F.slice(earlier, F.greatest(F.size(earlier) - 4, F.lit(1)), F.lit(5))
    around = F.flatten(F.transform(F.coalesce("root_ups", F.slice("root_ups", 1, 0), F.array().cast("array<struct<node:int,tag:string,names:string>>")), lambda u: F.filter("heads", lambda h: (h["parent"] == u["node"]) & h["tag"].isin("h1", "h2"))))
    near = F.get(F.array_sort(F.filter(F.transform(F.array(best(within, 0), best(earlier, 0), best(around, 0)), lambda b, k: F.struct(b["s"].alias("s"), k.alias("k"), b["said"].alias("said"), b["chars"].alias("chars"))), lambda b: b["s"].isNotNull())), F.lit(0))
    og = lambda name: F.get(F.filter("metas", lambda m: ((m["property"] == name) | (m["name"] == name)) & (T.scoring_length(m["content"]) >= 3)), F.lit(0))["content"]
    high = best(F.filter("heads", lambda h: h["tag"] != "h3"), 10)
    raw = F.coalesce(
        F.when(at.isNotNull() & (near["s"] < -15) & (near["chars"] >= 2), near["said"]), og("og:title"), og("twitter:title"), F.when(high["chars"] >= 2, high["said"]), F.when(T.scoring_length(T.norm("page_title")) >= 2, c("page_title"))
    )
    return rows.select("page", "page_id", F.coalesce(clean_title(raw, c("url")), F.lit("")).alias("title"))


# cleaning and text
def rooted(featured: DataFrame, choice: DataFrame) -> DataFrame:
    """The chosen nodes and what lies in them, each with its root; pages without a choice give their whole element."""
    c = F.col
    first = lambda cond: F.min(F.when(cond & element(), c("node"))).over(_whole())
    top = F.coalesce(first(c("tag") == "body"), first(c("tag") == "html"), first(c("parent").isNull()))
    rows = featured.withColumn("__top", top).join(choice.select("page", F.transform("roots", lambda r: F.struct(r["node"], r["last"])).alias("__roots")), "page", "left")
    own = F.get(F.filter("__roots", lambda r: (r["node"] <= c("node")) & (c("node") <= r["last"])), F.lit(0))["node"]
    rows = rows.withColumn("root", own)
    ends = F.max(F.when(c("node") == c("__top"), c("last"))).over(_whole())
    rows = rows.withColumn("__end", ends)
    alone = c("__roots").isNull() & (c("node") >= c("__top")) & (c("node") <= c("__end"))
    return rows.withColumn("root", F.coalesce("root", F.when(alone, c("__top")))).where(c("root").isNotNull()).drop("__roots", "__top", "__end")


def _measures(rows: DataFrame) -> DataFrame:
    """The rows that are left with their sums made anew."""
    return _counted(rows.drop("chars", "link_chars", "p_chars").withColumn("paras", F.col("within"))).drop("__n")


def author_note(said: Column, compat: bool = False) -> Column:
    low = F.lower(said)
    alone = low.contains("ps.") | low.contains("a/n") if compat else low.rlike("(?U)" + E.ALONE_NOTES.pattern)
    for note in E.AUTHOR_NOTES:
        alone = alone | low.contains(note)
    return alone


def cleaned(rooted: DataFrame, compat: bool = False) -> DataFrame:
    """What the cleaning leaves of the chosen nodes, in six passes, each of which sees what those before it left.

    Chrome and hidden elements; elements with bad names or a notice in front, unless they hold over 60 % of the root's
    first text or are large, of paragraphs and well named; empty ones and those of links; from the first author's note to
    the end of its parent; labels; short links.
    """
    c = F.col
    below = element() & (c("node") != c("root"))
    keep = ["page", "page_id", "node", "last", "parent", "root", "tag", "attrs", "text", "links", "within", "hint", "negative"]
    rows = rooted.withColumn("__whole", F.max(F.when(c("node") == c("root"), F.greatest("chars", F.lit(1)))).over(Window.partitionBy("page", "root"))).select(*keep, F.col("__whole").alias("whole"), "chars", "link_chars", "p_chars", F.col("within").alias("paras"))
    rows = left(rows, below & (c("tag").isin(*sorted(E.CHROME | E.SILENT)) | hidden(c("attrs"))))
    # a notice stands in front where the first text at or after the element's start is inside and starts with it
    shown = is_text() & (F.trim("text") != "")
    noticed = F.exists(F.array(*map(F.lit, E.NOTICES)), lambda n: F.startswith(T.norm("text"), n))
    rows = _measures(rows).withColumn("__next", F.first(F.when(shown, F.struct("node", noticed.alias("notice"))), ignorenulls=True).over(_from_here()))
    notice = c("tag").isin(*sorted(E.TEXT_BLOCKS)) & F.coalesce(c("__next.notice") & (c("__next.node") <= c("last")), F.lit(False))
    large = (c("chars") > 800) & (S.ratio(c("p_chars"), c("chars"), 0.0) > 0.6) & c("hint")
    rows = left(rows, below & (c("negative") | notice) & (c("chars") <= 0.6 * c("whole")) & ~large).drop("__next")
    rows = _measures(rows)
    density = S.link_density(c("link_chars"), c("chars"))
    rows = left(rows, below & c("tag").isin(*sorted(E.LINKED)) & ((c("chars") == 0) | (density > 0.8) | (density > 0.5) & (c("chars") < 500)))
    # the first note of a root, and the end of what holds it: the parent's last node
    rows = with_texts(rows, below & (c("tag") == "p"))
    noted = F.min(F.when(author_note(c("said"), compat), F.struct("node", "parent"))).over(Window.partitionBy("page", "root"))
    rows = rows.withColumn("__note", noted)
    end = F.max(F.when(c("node") == c("__note.parent"), c("last"))).over(Window.partitionBy("page", "root"))
    rows = rows.withColumn("__end", end).where(c("__note").isNull() | (c("node") < c("__note.node")) | (c("node") > c("__end"))).drop("__note", "__end", "said")
    rows = with_texts(_measures(rows), below & c("chars").between(1, 80))
    rows = left(rows, below & c("chars").between(1, 80) & c("said").rlike(_java(E.LABEL))).drop("said")
    rows = with_texts(_measures(rows), below & (c("tag") == "a"))
    return left(rows, below & (c("tag") == "a") & ((c("chars") < 40) | c("said").rlike(_java(E.LABEL)))).drop("said")


def lines(cleaned: DataFrame, titles: DataFrame) -> DataFrame:
    """page, page_id, root, position, line: the text of what is left, cut at line breaks and where blocks begin.

    Headings that say the title are left out, as are labels, repeats of the line before and lines that are the title; a
    title in front of the first line is cut off.
    """
    c = F.col
    heads = F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6")
    rows = with_texts(cleaned.select("page", "page_id", "node", "last", "root", "tag", "text"), heads).join(titles.select("page", "title"), "page")
    own, title = F.lower("said"), F.lower("title")
    similar = (own == title) | (title.contains(own) | (title != "") & own.contains(title)) & (F.abs(F.length(own) - F.length(title)) <= 20)
    rows = rows.withColumn("__skip", F.coalesce(heads & (own != "") & similar, F.lit(False)))
    rows = rows.withColumn("__to", F.max(F.when(c("__skip"), c("last"))).over(_to_here())).withColumn("__over", F.coalesce(c("__to") >= c("node"), F.lit(False)))
    # what a skipped heading holds breaks nothing, the heading itself does
    held = F.coalesce(F.max(F.when(c("__skip"), c("last"))).over(_before()) >= c("node"), F.lit(False))
    rows = rows.withColumn("__held", held)
    breaks = ~c("__held") & (c("__skip") | c("tag").isin("br", *sorted(E.TEXT_BLOCKS)) | (c("node") == c("root")))
    rows = rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(_to_here())).where(is_text() & ~c("__over"))
    text = T.norm(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda t: t["text"]), ""))
    blocks = rows.groupBy("page", "root", "island").agg(F.first("page_id").alias("page_id"), F.first("title").alias("title"), text.alias("line"))
    blocks = blocks.where((c("line") != "") & ~c("line").rlike(_java(E.LABEL)))
    order = Window.partitionBy("page", "root").orderBy("island")
    blocks = blocks.withColumn("__last", F.lag("line").over(order)).where(c("__last").isNull() | (c("__last") != c("line"))).withColumn("position", F.row_number().over(order))
    blocks = blocks.withColumn("line", F.when(c("position") == 1, T.strip_leading_title(c("line"), c("title"))).otherwise(c("line"))).where((c("line") != "") & (c("line") != c("title")))
    return blocks.select("page", "page_id", "root", "position", "line")


class Stages:
    """The stages of the extraction of pages (page_id, url, html), each made once: what several of the later ones read is written to the shared folder."""

    def __init__(self, pages: DataFrame, compat: bool = False):
        self.pages, self.compat = pages, compat

    @cached_property
    def nodes(self) -> DataFrame:
        return saved(parsed(self.pages), "nodes")

    @cached_property
    def found(self) -> DataFrame:
        return saved(featured(pre_cleaned(self.nodes)), "features")

    @cached_property
    def choice(self) -> DataFrame:
        return saved(chosen(candidates(self.found)), "choice")

    @cached_property
    def named(self) -> DataFrame:
        return saved(titles(self.nodes, self.found, self.choice), "titles")

    @cached_property
    def cleaned(self) -> DataFrame:
        return cleaned(rooted(self.found, self.choice), self.compat)

    @cached_property
    def lines(self) -> DataFrame:
        return lines(saved(self.cleaned, "cleaned"), self.named)


def chapters(pages: DataFrame, compat: bool = False) -> DataFrame:
    """page_id, url, title, content, confidence, mode of each row of pages (page_id, url, html), as extract_chapters() gives them, by plans over the pages' nodes."""
    c, made = F.col, Stages(pages, compat)
    nodes, choice, named, said = made.nodes, made.choice, made.named, made.lines
    # merged roots stand in the order of their lines, not of their nodes
    place = choice.select("page", F.posexplode(F.transform("roots", lambda r: r["node"])).alias("at", "root"))
    content = said.join(place, ["page", "root"], "left").groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "position", "line"))), lambda x: x["line"]), "\n\n").alias("content"))
    raw = F.when(is_text() & ~F.coalesce(F.get("ups", F.lit(0))["tag"].isin(*sorted(E.RAW)), F.lit(False)), T.scoring_length(c("text"))).otherwise(0)
    size = nodes.groupBy("page").agg(F.max("url").alias("url"), F.sum(raw).alias("raw"), F.bool_or(c("tag") == "body").alias("body"))
    rows = named.join(size, "page").join(choice.drop("page_id"), "page", "left").join(content, "page", "left")
    rows = rows.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("final", T.scoring_length(c("content")))
    sums = lambda f: F.aggregate("roots", F.lit(0.0), lambda n, r: n + f(r))
    total = sums(lambda r: r["chars"].cast("double"))
    mean = lambda name: sums(lambda r: r[name] * r["chars"]) / total
    some = lambda name: F.exists("roots", lambda r: r[name])
    merged = F.size("roots") > 1
    trust = S.confidence(total, F.when(c("body"), c("raw")).otherwise(0), mean("p_ratio"), mean("long_ratio"), mean("link_density"), c("margin"), merged, some("negative"), some("hint"), c("final"))
    confidence = F.when(c("roots").isNotNull(), trust).otherwise(F.least(F.lit(0.2), c("final") / 1000))
    mode = F.when(c("roots").isNull(), "none").when(merged, "merged").otherwise("single")
    return rows.select("page_id", "url", "title", "content", (F.round(confidence * 1000) / 1000).alias("confidence"), mode.alias("mode"))
