"""Other ways to score and to trust candidates, by name. Parsing, cleaning, titles and the length of a text are those of the standard extraction."""

from __future__ import annotations

from .dom import scoring_length
from .extract import DENSE, Candidate, Extraction

CONTAINERS = frozenset("div section article main td body li dd".split())


class Profile(Extraction):
    """Candidates are the containers of at least `least` characters, by points()."""

    least = 50

    def points(self, c: Candidate) -> float:
        raise NotImplementedError

    def tags(self, i: int) -> int:
        return self.n.inner(self.n.tags_to, i)

    def inside(self, i: int, tag: str) -> list[int]:
        return [k for k in self.n.elements(i) if self.page.tag[k] == tag]

    def runs(self, i: int) -> list[int]:
        """Lengths of the texts in a subtree, empty ones left out."""
        p, n = self.page, self.n
        return [n.runs[k] for k in range(i, p.last[i] + 1) if n.alive[k] and p.tag[k] == "" and p.text[k].strip()]

    def candidates(self) -> list[Candidate]:
        n, p = self.n, self.page
        found = [self.measured(i, 0.0) for i in n.elements() if p.tag[i] in CONTAINERS and n.chars(i) >= self.least]
        for c in found:
            c.score = self.points(c)
        self.found = sorted((c for c in found if c.score > 0), key=lambda c: -c.score)
        return self.found


class Density(Extraction):
    """The standard density score by whole paragraphs alone; nothing is handed up; confidence is a product."""

    def candidates(self) -> list[Candidate]:
        n, p, out = self.n, self.page, []
        for i in n.elements():
            if p.tag[i] in DENSE and n.chars(i) >= 60:
                c = self.measured(i)
                paras = n.inner(n.paras_to, i)
                c.score *= (1 + 0.02 * min(paras, 30)) / (1 + 0.02 * min(paras + n.span(n.br_to, i) // 2, 30))
                out.append(c)
        return sorted((c for c in out if c.score > 0), key=lambda c: -c.score)

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        total = sum(c.chars for c in chosen)
        if not total:
            return 0.0
        share = lambda f: min(1.0, sum(f(c) * c.chars for c in chosen) / total)
        text = 0.35 + 0.65 * min(1.0, max(share(lambda c: c.p_ratio), 0.8 * share(lambda c: c.long_ratio)))
        trust = min(1.0, total / 1200) * text * max(0.0, 1 - 1.5 * share(lambda c: c.link_density)) * (0.55 + 0.45 * min(1.0, 2 * margin))
        trust *= (1 if len(chosen) == 1 else 0.75) * (0.7 if any(c.negative for c in chosen) else 1) * (1.05 if any(c.hint for c in chosen) else 1)
        return min(1.0, max(0.0, trust))


class Additive(Profile):
    """A sum of bonuses less penalties; confidence from the mean and the least of six signals."""

    least = 1

    def links(self, c: Candidate) -> float:
        return self.n.inner(self.n.link_to, c.node) / max(c.chars, 1)

    def points(self, c: Candidate) -> float:
        p, tags, runs, link = self.page, max(self.tags(c.node), 1), self.runs(c.node), self.links(c)
        depth = sum(p.tag[up] != "body" and p.tag[up] != "html" for up in self.n.ancestors(c.node))
        penalty = 3 * link if link > 0.3 else 1.5 * link if link > 0.15 else 0
        sums = 2 * c.chars / tags + 0.01 * c.chars + 2 * self.n.inner(self.n.paras_to, c.node) + 1.5 * sum(r >= 80 for r in runs)
        sums += 3 * c.hint - 2.5 * c.negative - 10 * penalty - 10 * sum(r < 20 for r in runs) / tags - 0.3 * max(0, depth - 8)
        return sums + 15 * (p.tag[c.node] == "article") + 20 * (p.tag[c.node] == "main" or p.attrs[c.node].get("role") == "main")

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        best, long = chosen[0], sum(r >= 80 for c in chosen for r in self.runs(c.node))
        others = [c.score for c in self.found if c.node != best.node]
        signals = [
            next((s for least, s in ((3000, 1.0), (1000, 0.85), (500, 0.7), (200, 0.5)) if chars >= least), 0.2),
            min(1.0, 5 * self.n.inner(self.n.paras_to, best.node) / max(self.tags(best.node), 1)),
            max(0.0, 1 - 3 * self.links(best)),
            min(1.0, best.score / others[0] / 3) if others else 0.7,
            0.2 if best.hint else 0.5,
            1.0 if long >= 5 else 0.8 if long >= 2 else 0.4,
        ]
        return 0.7 * sum(signals) / len(signals) + 0.3 * min(signals)


class Propagation(Extraction):
    """Only what text leaves hand up; confidence from dominance, share of the page, links and hints."""

    def candidates(self) -> list[Candidate]:
        found = [self.measured(i, s) for i, s in self.leaf_scores().items()]
        return sorted((c for c in found if c.score > 0), key=lambda c: (-c.score, c.node))

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        if chars < 50:
            return 0.05
        share, total = chars / max(self.page_chars, 1), max(1, sum(c.chars for c in chosen))
        ratio = 0.3 if share > 0.95 else min(1.0, max(0.0, 1 - abs(share - 0.35) / 0.65))
        link = sum(c.link_density * c.chars for c in chosen) / total
        return 0.35 * margin + 0.25 * ratio + 0.25 * (1 - link) + 0.15 * (1.0 if any(c.hint for c in chosen) else 0.6)


class Threshold(Profile):
    """Density, good paragraphs and hints, cut down in steps; marked main parts go before all others."""

    least = 20

    def points(self, c: Candidate) -> float:
        if not (tags := self.tags(c.node)):
            return 0.0
        good = sum(self.n.chars(k) > 30 for k in self.inside(c.node, "p"))
        runs = self.runs(c.node)
        short = sum(r < 5 for r in runs) / max(1, len(runs))
        steps = (0.3 if c.link_density > 0.5 else 0.6 if c.link_density > 0.3 else 1) * (0.4 if short > 0.5 else 0.7 if short > 0.3 else 1)
        return (0.4 * c.chars / tags + 5 * good + 15 * c.hint) * steps

    def candidates(self) -> list[Candidate]:
        found, p = super().candidates(), self.page
        marked = lambda c: p.tag[c.node] in ("article", "main") or p.attrs[c.node].get("role") == "main"
        first = min((c for c in found if marked(c)), key=lambda c: (p.tag[c.node] != "article", p.tag[c.node] != "main", c.node), default=None)
        return [first] if first else found

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        return min(1.0, min(1.0, chosen[0].score / 100) + 0.2 * chosen[0].hint) * (0.5 if chars < 100 else 1)


class Capped(Profile):
    """A sum whose length and paragraph parts are capped; a hinted candidate wins from 70 % of the best score."""

    def points(self, c: Candidate) -> float:
        n, link = self.n, c.link_density
        paras = n.inner(n.paras_to, c.node) + n.inner(n.br_to, c.node) // 2
        own = sum(0 < scoring_length(self.page.text[k]) < 30 for k in n.children(c.node) if self.page.tag[k] == "")
        return max(0.0, c.chars / max(1, self.tags(c.node)) * (max(0.05, 1 - link) if link > MOST_LINKS else 1 - 0.5 * link) + min(200, 5 * paras) + 0.1 * min(5000, c.chars) - 2 * own)

    def candidates(self) -> list[Candidate]:
        found = super().candidates()
        hinted = next((c for c in found if c.hint and not c.negative and c.score >= 0.7 * found[0].score), None)
        return [hinted, *(c for c in found if c is not hinted)] if hinted else found

    def confidence(self, chosen: list[Candidate], margin: float, chars: int) -> float:
        n, total = self.n, max(1, sum(c.chars for c in chosen))
        paras = sum(n.inner(n.paras_to, c.node) + n.inner(n.br_to, c.node) // 2 for c in chosen)
        link = sum(c.link_density * c.chars for c in chosen) / total
        return min(0.95, (0.4 * margin + 0.3 * min(1.0, chars / FULL_LENGTH) + 0.3 * min(1.0, paras / 10)) * (1 - min(0.7, 1.5 * link)))


# Fixed values of the capped profile: the share of links that counts in full, and the length that earns full trust.
MOST_LINKS, FULL_LENGTH = 0.35, 3000
PROFILES: dict[str, type[Extraction]] = {"standard": Extraction, "density": Density, "additive": Additive, "propagation": Propagation, "threshold": Threshold, "capped": Capped}
