"""Title, content and confidence of a page: candidates scored by density and by propagation, chosen or merged, cleaned, serialised.

One Arrow-batched pass per page: every step is local to a page, so nothing is shuffled and html is read once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .batches import slices
from .dom import Nodes, Page, scoring_length

# Marks in class, id and other names, in labels, titles and notices.
HINT = re.compile(r"chapter|content|article|entry|post|text|body|read|story|fiction|novel|book|txt|main|bq|内容|章节|正文|小说|阅读", re.I)
NEGATIVE = re.compile(
    r"comment|reply|replies|recommend|related|popular|hot|rank|nav|menu|footer|sidebar|widget|share|social|advert|adsense|banner|promo|sponsor|disqus|breadcrumb|pagination|pager|\bprev(?:ious)?\b|\bnext\b|author|note|copyright|toc|directory|catalog|bookmark|vote|donate|reward|tip|login|register|search|subscribe|popup|modal|overlay|signup|newsletter|(?<![A-Za-z0-9_])ad[s_.-]?|"
    r"评论|回复|推荐|相关|热门|排行|导航|菜单|页脚|页眉|侧边|分享|广告|版权|声明|目录|书架|加入书签|打赏|投票|上一章|下一章|作者有话说|作者说|书友|互动|登录|注册|搜索|订阅|評論|推薦|相關|導航|廣告|贊助|側邊|登入|註冊|聯絡我們",
    re.I,
)
NOTICES = ("温馨提示", "溫馨提示", "提示：", "提示:　", "免费小说", "免費小說", "本站提示", "本章未完结", "本章未完結", "最新网址", "最新網址")
LABEL = re.compile(
    r"^\s*[«»<>\[\]【】「」『』\s]*(上一章|下一章|前一章|后一章|目录|书架|加入书签|推荐本书|推荐|相关推荐|推荐阅读|评论|打赏|投票|分享|广告|作者有话说|作者说|版权声明|免责声明|目錄|書架|推薦|評論|prev(?:ious)?\s*chapter|next\s*chapter|table\s*of\s*contents|recommended(?:\s*(?:novels?|books?|chapters?|reading))?|related\s*(?:novels?|books?|chapters?)?|comments?(?:\s*\(\d+\))?|share(?:\s*(?:this|on|to))?|donate|bookmark|advertisement)[»<>\[\]【】「」『』\s\d.:：,，!！?？_-]*$",
    re.I,
)
CHAPTER = re.compile(r"\b(?:chapter|chap|episode|part|section|book|volume|prologue|epilogue)\s*[\dIVXLCDM]+|第\s*[0-9〇零一二三四五六七八九十百千两]+\s*[章节卷回部集篇]|^\s*\d+\s*[\.、]\s*|^\s*[IVXLCDM]+\s*[:.、]?\s*$", re.I)
AUTHOR_NOTES = ("author's note", "author note", "author:", "作者的话", "作者说", "作者有话说", "译者的话", "p.s.", "note:", "notes:")
ALONE_NOTES = re.compile(r"(?<!\w)(?:ps\.|a/n)")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HIDDEN_NAME = re.compile(r"(?<![\w-])(hidden|sr-only|visually-hidden|display-none)(?![\w-])", re.I)
SEPARATORS = re.compile(r"\s*[\|｜]\s*|\s*[-–—]\s*|\s*[:：]\s*|\s*_+\s*")
SITE_END = re.compile(r"(novels?|read(?:ing|er)?|books?|fictions?|stor(?:y|ies)|web|site|home|online|free|latest|txt|download|app|official|portal|hub|zone|space|club|net|org)$", re.I)
SITE_END_ZH = re.compile(r"(小说|阅读|阅读器|章节|正文|网|书屋|书城|文学|在线|免费|最新|书网|书斋|小说网|读书网|中文网|阅读网|文学网|全文|最新章节)$")
SILENT = frozenset("script style noscript template iframe svg math canvas audio video object embed form button input select textarea label option datalist dialog img picture source hr track map area frame frameset applet".split())
RAW = frozenset("script style template".split())
CHROME = frozenset("nav footer header aside".split())
DENSE = frozenset("div section article main td center body".split())
TEXT_BLOCKS = frozenset("p div section article main blockquote pre li h1 h2 h3 h4 h5 h6 td th figure figcaption dd dt".split())
LINKED = frozenset("div section ul ol table td p li span dl nav aside".split())
NAMES = ("id", "class", "role", "aria-label", "title", "itemprop", "data-type", "data-module", "data-component", "data-name")
ROLES = frozenset("navigation banner complementary contentinfo".split())
GENERIC_HOST = frozenset(T.GENERIC_HOST)
#: Characters of a div's or span's own text that make it a leaf, and of a leaf that has a score; marks that speak for prose.
LEAST_OWN, LEAST_LEAF, LEAF_MARKS = 20, 5, ",，.。;；"
#: Characters of any candidate.
LEAST_CHARS = 60
CONTENT = re.compile("[0-9A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in T.CONTENT) + "]")
TAG_WEIGHT = {"article": 1.6, "main": 1.6, "section": 1.05, "div": 1.0, "td": 0.85, "body": 0.75}


def content_length(text: str) -> int:
    """ASCII letters and digits, kana, Han and hangul."""
    return len(CONTENT.findall(text))


def rounded(x: float) -> float:
    """x, not negative, to three places as SQL's round() has it: its thousandfold to the next whole number, halves up."""
    y = x * 1000
    n = math.floor(y)
    return (n + (y - n >= 0.5)) / 1000


@dataclass
class Candidate:
    node: int
    score: float
    chars: int
    p_ratio: float
    long_ratio: float
    link_density: float
    hint: bool
    negative: bool


class Extraction:
    def __init__(self, html: str, url: str = "", compat: bool = False):
        self.page, self.url, self.compat = Page(html), url, compat
        self.n = Nodes(self.page)
        p = self.page
        self.names = [" ".join(a[k] for k in NAMES if a.get(k)).lower() if a else "" for a in p.attrs]
        self.head = [i for i, t in enumerate(p.tag) if t == "title"]
        self.page_title = self.n.get_text(self.head[0]) if self.head else ""
        raw = (self.n.runs[i] for i, t in enumerate(p.tag) if t == "" and (p.parent[i] < 0 or p.tag[p.parent[i]] not in RAW))
        self.page_chars = sum(raw) if "body" in p.tag else 0
        self.pre_clean()
        self.n.refresh()

    def hint(self, i: int) -> bool:
        return bool(self.names[i] and HINT.search(self.names[i]))

    def negative(self, i: int) -> bool:
        return bool(self.names[i] and NEGATIVE.search(self.names[i]))

    def hidden(self, i: int) -> bool:
        a = self.page.attrs[i]
        return bool(a) and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(HIDDEN_STYLE.search(a.get("style", ""))) or bool(HIDDEN_NAME.search(self.names[i])))

    def pre_clean(self) -> None:
        p = self.page
        for i, tag in enumerate(p.tag):
            if self.n.alive[i] and (tag == "!" or tag in SILENT or tag in ("title", "head") or tag and (self.hidden(i) or p.attrs[i].get("role", "").lower() in ROLES)):
                if tag == "head":  # the metadata stay readable for titles; only its text is dropped
                    continue
                self.n.drop(i)

    # scoring
    def measured(self, i: int, score: float | None = None) -> Candidate:
        n, p = self.n, self.page
        chars = n.chars(i)
        tags = n.inner(n.tags_to, i) + 1
        p_chars, paras = n.inner(n.para_to, i), n.inner(n.paras_to, i)
        p_ratio = p_chars / chars if chars else 0.0
        density = min(1.0, n.inner(n.link_to, i) / chars) if chars else 1.0
        texts = n.span(n.texts_to, i)
        short = n.span(n.short_to, i) / texts if texts else 0.0
        long_ratio = n.span(n.long_to, i) / chars if chars else 0.0
        hint, negative = self.hint(i), self.negative(i)
        if score is None:
            score = 0.0
            if chars >= 60:
                average, effective = p_chars / paras if paras else 0.0, paras + n.span(n.br_to, i) // 2
                score = chars / tags * math.log10(chars + 10) * (1 + 1.5 * min(p_ratio, 1))
                score *= (1.15 if average >= 80 else 1) * (1.15 if average >= 200 else 1)
                score *= (1 + 0.02 * min(effective, 30)) * (1 + 0.6 * min(long_ratio, 1))
                score *= max(0.05, (1 - density) ** 2) if density > 0 else 1
                score *= max(0.3, 1 - 0.7 * short) if p_ratio < 0.4 else max(0.6, 1 - 0.3 * short)
                score *= TAG_WEIGHT.get(p.tag[i], 0.6) * (1.5 if hint else 1)
                score *= (1.1 if p.parent[i] >= 0 and self.hint(p.parent[i]) else 1) * (0.25 if negative else 1)
                score *= {"nav": 0.2, "footer": 0.2, "aside": 0.2, "header": 0.5}.get(p.tag[i], 1)
        return Candidate(i, score, chars, p_ratio, long_ratio, density, hint, negative)

    def leaf_scores(self) -> dict[int, float]:
        """Scores that text leaves hand up: whole to the parent, half to the grandparent."""
        n, p, out = self.n, self.page, {}
        for i in n.elements():
            own = sum(content_length(p.text[c]) for c in n.children(i) if p.tag[c] == "") if p.tag[i] in ("div", "span") else 0
            if p.tag[i] not in ("p", "pre", "blockquote") and own < LEAST_OWN:
                continue
            text = "".join(n.parts(i))
            chars = content_length(text)
            if chars < LEAST_LEAF:
                continue
            marks = sum(map(text.count, LEAF_MARKS))
            linked = sum(content_length("".join(n.parts(k))) for k in n.elements(i) if p.tag[k] == "a")
            score = (1 + min(chars / 100, 6) + min(marks / 5, 3)) * (1 - min(1.0, linked / chars)) ** 2
            score *= (0.3 if chars < LEAST_OWN else 1) * (0.15 if self.negative(i) else 1)
            for up, share in zip(n.ancestors(i), (1.0, 0.5)):
                if p.tag[up] not in CHROME:
                    out[up] = out.get(up, 0.0) + score * share
        for i in out:
            out[i] *= (1.4 if self.hint(i) else 1) * (0.2 if self.negative(i) else 1) * (1.5 if p.tag[i] == "article" or p.attrs[i].get("role") == "main" else 1)
        return out

    def candidates(self) -> list[Candidate]:
        n, p = self.n, self.page
        whole = self.whole()
        dense = [self.measured(i) for i in n.elements() if n.chars(i) >= LEAST_CHARS and (p.tag[i] in DENSE or i == whole)]
        marked = [c for c in (self.measured(i) for i in n.elements() if p.tag[i] in ("article", "main") or p.attrs[i].get("role") == "main") if c.chars >= 120 and c.link_density <= 0.35 and not c.negative]
        order = sorted(marked, key=lambda c: -c.score) + sorted(dense, key=lambda c: -c.score)
        handed = sorted(((s, i) for i, s in self.leaf_scores().items()), key=lambda x: (-x[0], x[1]))
        order += [self.measured(i, s) for s, i in handed if n.chars(i) >= LEAST_CHARS]
        first: dict[int, Candidate] = {}
        for c in order:
            first.setdefault(c.node, c)
        return sorted((c for c in first.values() if c.score > 0), key=lambda c: -c.score)

    def whole(self) -> int | None:
        """The body, else the html element, else the first element that nothing holds."""
        n, p = self.n, self.page
        for tag in ("body", "html"):
            found = next((i for i in n.elements() if p.tag[i] == tag), None)
            if found is not None:
                return found
        return next((i for i in n.elements() if p.parent[i] < 0), None)

    # choice
    def choose(self, found: list[Candidate]) -> tuple[list[Candidate], float]:
        n = self.n
        best = found[0]
        for c in found[1:12]:
            if c.node != best.node and n.within(best.node, c.node) and c.score >= 0.9 * best.score and c.chars >= 0.65 * best.chars:
                best = c
                break
        apart = lambda a, b: not n.within(a.node, b.node) and not n.within(b.node, a.node)
        rest = [c for c in found if c is not best]
        second = next((c for c in rest if apart(best, c)), rest[0] if rest else None)
        margin = 1.0 if second is None or best.score <= 0 else min(1.0, max(0.0, (best.score - second.score) / best.score))
        if best.chars < 300 or margin < 0.25:
            group: list[Candidate] = []
            for c in found[:10]:
                if c.score >= 0.35 * best.score and c.chars >= 80 and all(apart(c, g) for g in group):
                    group.append(c)
            if len(group) >= 2 and sum(c.chars for c in group) > 1.25 * best.chars and self.adjacent(group):
                return sorted(group, key=lambda c: self.page.line[c.node]), margin
        return [best], margin

    def adjacent(self, group: list[Candidate]) -> bool:
        up = [[*self.n.ancestors(c.node), -1, -1][:2] for c in group]
        return len({u[0] for u in up}) == 1 or len({u[1] for u in up}) == 1

    # title
    def heading_score(self, i: int) -> float:
        text = self.n.get_text(i)
        chars = scoring_length(text)
        if not 2 <= chars <= 150:
            return -1
        score = chars + {"h1": 25, "h2": 15, "h3": 8}.get(self.page.tag[i], 0) + 20 * self.hint(i) - 30 * self.negative(i) + 40 * bool(CHAPTER.search(text))
        for k, up in enumerate(self.n.ancestors(i)):
            if k >= 6 or self.page.tag[up] == "body":
                break
            if self.page.tag[up] in ("nav", "footer", "aside") or self.negative(up) and not self.hint(up):
                return score - 60
        return score

    def best_heading(self, among: list[int], least: float) -> tuple[float, str]:
        scored = [(self.heading_score(i), -k, i) for k, i in enumerate(among)]
        top = max(scored, default=(-1, 0, -1))
        return (top[0], self.n.get_text(top[2])) if top[0] > least else (-1, "")

    def title(self, chosen: list[Candidate]) -> str:
        n, p = self.n, self.page
        heads = [i for i in n.elements() if p.tag[i] in ("h1", "h2", "h3")]
        if chosen:
            root = chosen[0].node
            near = [self.best_heading([i for i in heads if n.within(root, i)], 0), self.best_heading([i for i in heads if i < root and not n.within(i, root)][-5:], 0)]
            ups = [up for _, up in zip(range(3), n.ancestors(root))]
            near.append(self.best_heading([c for up in ups for c in n.children(up) if p.tag[c] in ("h1", "h2")], 0))
            score, text = max(near, key=lambda x: x[0])
            if score > 15 and scoring_length(text) >= 2:
                return self.clean_title(text)
        for name in ("og:title", "twitter:title"):
            for a in (p.attrs[i] for i, t in enumerate(p.tag) if t == "meta"):
                if name in (a.get("property"), a.get("name")) and scoring_length(a.get("content", "")) >= 3:
                    return self.clean_title(" ".join(a["content"].split()))
        score, text = self.best_heading([i for i in heads if p.tag[i] != "h3"], 10)
        if scoring_length(text) >= 2:
            return self.clean_title(text)
        return self.clean_title(self.page_title) if scoring_length(self.page_title) >= 2 else ""

    def siteish(self, part: str) -> bool:
        host = re.match(r"[A-Za-z][\w+.-]*://([^/?#]*)", self.url or "")
        low, chars = part.lower().strip(), scoring_length(part)
        for token in re.split(r"[^a-z0-9]+", host[1].lower()) if host else []:
            if len(token) > 2 and token not in GENERIC_HOST and (len(token) >= 4 and re.search(rf"\b{token}\b", low) or token in low.replace(" ", "") and chars <= 12):
                return True
        return bool(chars <= 25 and SITE_END.search(low) or chars <= 12 and SITE_END_ZH.search(low))

    def clean_title(self, raw: str) -> str:
        raw = " ".join(raw.split())
        parts = [x.strip() for x in SEPARATORS.split(raw) if x.strip()]
        marks = [self.siteish(x) for x in parts]
        if len(parts) < 2 or all(marks):
            return max(parts, key=scoring_length) if len(parts) > 1 else raw
        first, last = marks.index(False), len(marks) - marks[::-1].index(False)
        return raw if (first, last) == (0, len(parts)) else " - ".join(parts[first:last])

    # cleaning and text
    def clean(self, root: int) -> None:
        n, p = self.n, self.page

        def sweep(rule) -> None:
            for i in n.elements(root):
                if n.alive[i] and rule(i):
                    n.drop(i)
            n.refresh()

        whole = max(1, n.chars(root))
        sweep(lambda i: p.tag[i] in CHROME or p.tag[i] in SILENT or self.hidden(i))

        def noise(i: int) -> bool:
            if not (self.negative(i) or p.tag[i] in TEXT_BLOCKS and n.get_text(i).startswith(NOTICES)):
                return False
            c = self.measured(i, 0.0)
            return c.chars <= 0.6 * whole and not (c.chars > 800 and c.p_ratio > 0.6 and c.hint)

        sweep(noise)
        sweep(lambda i: p.tag[i] in LINKED and (n.chars(i) == 0 or (d := min(1.0, n.inner(n.link_to, i) / n.chars(i))) > 0.8 or d > 0.5 and n.chars(i) < 500))
        for i in n.elements(root):
            low = n.get_text(i).lower() if p.tag[i] == "p" else ""
            if any(x in low for x in AUTHOR_NOTES) or (("ps." in low or "a/n" in low) if self.compat else ALONE_NOTES.search(low)):
                up = p.parent[i]
                for k in range(i, p.last[up] + 1):
                    n.alive[k] = False
                break
        n.refresh()
        sweep(lambda i: 0 < n.chars(i) <= 80 and bool(LABEL.match(n.get_text(i))))
        sweep(lambda i: p.tag[i] == "a" and (n.chars(i) < 40 or bool(LABEL.match(n.get_text(i)))))

    def lines(self, root: int, title: str) -> list[str]:
        n, p, out, buffer = self.n, self.page, [], []
        head = title.lower()

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text and not LABEL.match(text) and (not out or out[-1] != text):
                out.append(text)

        skip = -1
        for i in range(root, p.last[root] + 1):
            if i <= skip or not n.alive[i]:
                continue
            if p.tag[i] == "":
                buffer.append(p.text[i])
                continue
            if p.tag[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                own = n.get_text(i).lower()
                if own and (own == head or (own in head or head and head in own) and abs(len(own) - len(head)) <= 20):
                    flush()
                    skip = p.last[i]
                    continue
            if p.tag[i] == "br" or p.tag[i] in TEXT_BLOCKS:
                flush()
        flush()
        if out and title and out[0].startswith(title):
            out[0] = out[0][len(title) :].lstrip(" :：-–—|.、")
        return [x for x in out if x and x != title]

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        total = sum(c.chars for c in chosen)
        if not total:
            return 0.0
        mean = lambda f: sum(f(c) * c.chars for c in chosen) / total
        p_ratio, long_ratio, density = mean(lambda c: c.p_ratio), mean(lambda c: c.long_ratio), mean(lambda c: c.link_density)
        share = total / self.page_chars if self.page_chars else 0
        ratio = 0.8 if not self.page_chars else 0.3 if share > 0.95 else min(1.0, max(0.3, 1 - abs(share - 0.35) / 0.65))
        core = 0.3 * min(1, total / 1200) + 0.35 * (0.35 + 0.65 * min(1, max(p_ratio, 0.8 * long_ratio))) + 0.2 * (0.55 + 0.45 * min(1, 2 * margin)) + 0.15 * ratio
        # one factor after the other, as the plans and the SQL take them: halves of the last place must not depend on the order
        for factor in (max(0.0, 1 - 1.5 * density), 1 if len(chosen) == 1 else 0.75, 0.7 if any(c.negative for c in chosen) else 1, 1.05 if any(c.hint for c in chosen) else 1):
            core *= factor
        return min(0.95, max(0.0, core)) * min(1, chars / 150)

    def result(self) -> tuple[str, str, float, str]:
        found = self.candidates()
        if not found:
            title, root = self.title([]), self.whole()
            if root is None:
                text = ""
            else:
                self.clean(root)
                text = "\n\n".join(self.lines(root, title)).strip()
            return title, text, rounded(min(0.2, scoring_length(text) / 1000)), "none"
        chosen, margin = self.choose(found)
        title = self.title(chosen)
        lines: list[str] = []
        for c in chosen:
            if self.n.alive[c.node]:  # the cleaning of an earlier one may have taken it
                self.clean(c.node)
                lines += self.lines(c.node, title)
        text = "\n\n".join(lines)
        return title, text, rounded(self.confidence(chosen, margin, scoring_length(text))), "single" if len(chosen) == 1 else "merged"


NODES = "page_id long, node int, last int, parent int, tag string, chars int, tags int, p_chars int, paras int, brs int, long_chars int, link_chars int, texts int, short_texts int, hint boolean, parent_hint boolean, negative boolean, main boolean"


def page_nodes(pages: DataFrame) -> DataFrame:
    """The elements of each page that pre-cleaning leaves, with the sums over their subtrees that scores are made of.

    node is the place in document order, last that of the last node of the subtree, parent is null at the top. Null html
    gives no rows; repeated rows give repeated results. functions.scores turns them into scores.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(NODES))

    def features(e: Extraction, page_id: int | None) -> Iterator[tuple]:
        n, p = e.n, e.page
        for i in n.elements():
            up = p.parent[i]
            sums = n.chars(i), n.inner(n.tags_to, i) + 1, n.inner(n.para_to, i), n.inner(n.paras_to, i), n.span(n.br_to, i), n.span(n.long_to, i), n.inner(n.link_to, i), n.span(n.texts_to, i), n.span(n.short_to, i)
            yield page_id, i, p.last[i], up if up >= 0 else None, p.tag[i], *sums, e.hint(i), up >= 0 and e.hint(up), e.negative(i), p.attrs[i].get("role") == "main"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            rows = [r for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()) for r in features(Extraction(h or ""), i)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, NODES)


def _profile(name: str) -> type[Extraction]:
    from .profiles import PROFILES

    return PROFILES[name]


def extract_chapter(html: str, url: str = "", compat: bool = False, profile: str = "standard") -> dict:
    """title, content, confidence and mode of one page."""
    title, content, confidence, mode = _profile(profile)(html or "", url or "", compat).result()
    return {"title": title, "content": content, "confidence": confidence, "mode": mode}


def extract_chapters(pages: DataFrame, compat: bool = False, profile: str = "standard") -> DataFrame:
    """page_id, url, title, content, confidence, mode of each row of pages (page_id, url, html), by a profile of PROFILES; null html gives empty text."""
    make = _profile(profile)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("content", pa.string()), ("confidence", pa.float64()), ("mode", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "html")):
            rows = [make(h or "", u or "", compat).result() for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())]
            columns = [pa.array([r[k] for r in rows], schema.field(k + 2).type) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *columns], schema=schema)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, title string, content string, confidence double, mode string")
