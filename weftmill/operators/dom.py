"""Pages as node arrays: document order, each node's subtree an interval of positions.

Sums over any subtree are differences of prefix sums, so no stage walks a tree again. Repair rules: block start tags and a
new p close an open p; list items, table cells and rows close their like; void elements hold nothing; script and style
hold raw text; an end tag closes up to its start tag and is ignored without one; the page's end closes everything.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from itertools import accumulate

# Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot select".split())
_UNSCORED = re.compile(r"[\W_]+")


def scoring_length(text: str) -> int:
    return len(_UNSCORED.sub("", text))


class LenientParser(HTMLParser):
    """The standard parser, for any input: a marked section of an unknown kind or without an end is a comment up to the next '>'."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i, report=1):
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:
            end = -1
        return end if end >= 0 else self.parse_bogus_comment(i, report)

    def unknown_decl(self, data):
        """A marked section's content is no text."""


class Page(LenientParser):
    """Node arrays of one page: tag ('' for text, '!' for comments), attrs, text, parent, last (end of the subtree), depth, line."""

    def __init__(self, html: str):
        super().__init__()
        self.tag, self.attrs, self.text, self.parent, self.last, self.depth, self.line = [], [], [], [], [], [], []
        self._open: list[int] = []
        self.feed(html)
        self.close()
        while self._open:
            self._pop()

    def _add(self, tag: str, attrs: dict[str, str], text: str) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.parent.append(self._open[-1] if self._open else -1)
        self.depth.append(len(self._open))
        self.line.append(self.getpos()[0])
        self.last.append(i)
        return i

    def _pop(self) -> str:
        i = self._open.pop()
        self.last[i] = len(self.tag) - 1
        return self.tag[i]

    def _close(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            t = self.tag[self._open[k]]
            if t in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if t in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), HOLDERS | {"td", "th", "div", "body"})
        if tag in CLOSES_LIKE:
            self._close(CLOSES_LIKE[tag], HOLDERS)
        i = self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in VOID:
            self._open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._pop()

    def handle_endtag(self, tag):
        if any(self.tag[i] == tag for i in self._open):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        self._add("", {}, data)

    def handle_comment(self, data):
        self._add("!", {}, data)


class Nodes:
    """The nodes of a page that are still there, with prefix sums over document order."""

    def __init__(self, page: Page, alive: list[bool] | None = None):
        self.page, self.alive = page, alive or [True] * len(page.tag)
        self.refresh()

    def refresh(self) -> None:
        p = self.page
        self.runs = [scoring_length(p.text[i]) if a and p.tag[i] == "" else 0 for i, a in enumerate(self.alive)]
        self.chars_to = [0, *accumulate(self.runs)]
        live = [a and t not in ("", "!") for a, t in zip(self.alive, p.tag)]
        self.tags_to = [0, *accumulate(map(int, live))]
        of = lambda tag: [a and t == tag for a, t in zip(live, p.tag)]
        links, paras = of("a"), of("p")
        self.link_to = [0, *accumulate(self.chars(i) if x else 0 for i, x in enumerate(links))]
        self.para_to = [0, *accumulate(self.chars(i) if x else 0 for i, x in enumerate(paras))]
        self.paras_to = [0, *accumulate(map(int, paras))]
        self.br_to = [0, *accumulate(map(int, of("br")))]
        texts = [a and t == "" and bool(x.strip()) for a, t, x in zip(self.alive, p.tag, p.text)]
        self.texts_to = [0, *accumulate(map(int, texts))]
        self.short_to = [0, *accumulate(int(x and 0 < n <= 30) for x, n in zip(texts, self.runs))]
        self.long_to = [0, *accumulate(n if n >= 60 else 0 for n in self.runs)]

    def drop(self, i: int) -> None:
        for k in range(i, self.page.last[i] + 1):
            self.alive[k] = False

    def span(self, sums: list[int], i: int) -> int:
        return sums[self.page.last[i] + 1] - sums[i]

    def chars(self, i: int) -> int:
        return self.span(self.chars_to, i)

    def inner(self, sums: list[int], i: int) -> int:
        """Over the descendants alone."""
        return sums[self.page.last[i] + 1] - sums[i + 1]

    def elements(self, root: int | None = None):
        p = self.page
        first, last = (0, len(p.tag) - 1) if root is None else (root + 1, p.last[root])
        return (i for i in range(first, last + 1) if self.alive[i] and p.tag[i] not in ("", "!"))

    def within(self, a: int, i: int) -> bool:
        """Whether i lies in a's subtree."""
        return a <= i <= self.page.last[a]

    def parts(self, i: int) -> list[str]:
        p = self.page
        return [p.text[k] for k in range(i, p.last[i] + 1) if self.alive[k] and p.tag[k] == ""]

    def get_text(self, i: int) -> str:
        return " ".join(" ".join(self.parts(i)).split())

    def children(self, i: int):
        p, k = self.page, i + 1
        while k <= p.last[i]:
            if self.alive[k]:
                yield k
            k = p.last[k] + 1

    def ancestors(self, i: int):
        i = self.page.parent[i]
        while i >= 0:
            yield i
            i = self.page.parent[i]


_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)?(?P<rest>(?:[#.][\w-]+|\[[^\]]+\])*)$")


def select(nodes: Nodes, selector: str, root: int | None = None) -> list[int]:
    """Nodes that a selector list matches, in document order: tags, #id, .class, [a], [a=v], [a*=v], [a^=v], [a$=v], :last-child, descendants and children."""
    found: set[int] = set()
    for one in selector.split(","):
        steps = one.replace(">", " > ").split()
        now, direct = None, False
        for step in steps:
            if step == ">":
                direct = True
                continue
            last = step.endswith(":last-child")
            match = _matcher(step.removesuffix(":last-child"))
            if now is None:
                now = {i for i in nodes.elements(root) if match(nodes.page.tag[i], nodes.page.attrs[i])}
            elif direct:
                now = {c for i in now for c in nodes.children(i) if nodes.page.tag[c] not in ("", "!") and match(nodes.page.tag[c], nodes.page.attrs[c])}
            else:
                now = {c for i in now for c in nodes.elements(i) if match(nodes.page.tag[c], nodes.page.attrs[c])}
            if last:
                now = {i for i in now if not _followed(nodes, i)}
            direct = False
        found |= now or set()
    return sorted(found)


def _followed(nodes: Nodes, i: int) -> bool:
    """Whether an element with the same parent comes after i."""
    up = nodes.page.parent[i]
    return any(c > i and nodes.page.tag[c] not in ("", "!") for c in (nodes.children(up) if up >= 0 else nodes.elements()) if up >= 0 or nodes.page.parent[c] < 0)


def _matcher(step: str):
    m = _SIMPLE.match(step)
    if not m:
        raise ValueError(f"selector not understood: {step}")
    tests = []
    if m["tag"] and m["tag"] != "*":
        tests.append(lambda t, a, tag=m["tag"].lower(): t == tag)
    for part in re.findall(r"[#.][\w-]+|\[[^\]]+\]", m["rest"]):
        if part[0] == "#":
            tests.append(lambda t, a, v=part[1:]: a.get("id") == v)
        elif part[0] == ".":
            tests.append(lambda t, a, v=part[1:]: v in a.get("class", "").split())
        else:
            name, op, value = re.match(r"\[([\w-]+)(?:([*^$]?=)\s*[\"']?(.*?)[\"']?)?\]", part).groups()
            how = {None: lambda x, v: True, "=": lambda x, v: x == v, "*=": lambda x, v: v in x, "^=": lambda x, v: x.startswith(v), "$=": lambda x, v: x.endswith(v)}[op]
            tests.append(lambda t, a, n=name, v=value, h=how: n in a and h(a[n], v))
    return lambda t, a: all(x(t, a) for x in tests)
