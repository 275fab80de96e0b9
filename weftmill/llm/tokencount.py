"""Token counts of a sentencepiece BPE model, by rank-synchronous merging of ragged symbol arrays.

No piece of the model holds its word mark after another character, so no merge crosses from a character to a following
word mark: texts fall apart into pre-tokens (marks, then characters) that merge on their own. Each batch's distinct
pre-tokens are held as one ragged array of symbols. In a step every pre-token merges its pair of lowest rank, at all its
places at once where that can't change what comes next, else at the leftmost only; the counts of surviving symbols are
the answer. Characters that the model lacks count one token for each of their UTF-8 bytes.

Long pre-tokens (lines without spaces, encoded data) would take a step over all symbols for each of their merges. They are
merged rank by rank instead, all long ones of a batch together: places wait in a bucket of their pair's rank, and a step
touches the places of the lowest rank and their neighbours alone. A merge that makes a pair of lower rank sets off others
before places to its right may go on, but only within the few characters that pieces around it can span: places there
wait for the next step, all others are merged at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices

MARK = "\u2581"
#: Pre-tokens of more symbols are long: merged rank by rank, about AT_ONCE symbols together, and not kept. So many others are kept.
LONG, AT_ONCE, CACHE_WORDS = 40, 1 << 20, 600_000
#: Odd multipliers of the two hash tables, and their size.
HASHES, SLOT_BITS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 20
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
NONE = np.int64(1 << 40)


class MergeCounter:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.base = n + 1
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        pairs = []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.base + b, rank[i], i))
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [-2], dtype=np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [NONE], dtype=np.int64)
        self.made = np.array([p[2] for p in pairs] + [0], dtype=np.int64)
        #: Further apart than this, merges and what they set off can't touch each other.
        self.reach = 4 * max(map(len, ids))
        self._build_slots()
        self.known: dict[str, int] = {"": 0}
        joined = {piece[k : k + 2] for piece in ids for k in range(len(piece) - 1)}
        odd = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
        letters = [c for c in map(chr, range(65, 256)) if c.isalpha() and c not in "ªµº"]
        #: Punctuation that follows a letter in no piece, so that no merge crosses from a letter to it.
        self.apart = "".join("\\" + c for c in odd if not any(a + c in joined for a in letters))
        self.points = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.chars.items():
            self.points[ord(c)] = i

    @staticmethod
    def _slot(key: np.ndarray, k: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(HASHES[k])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _build_slots(self) -> None:
        """Two hash tables of places in the merge table; each key stands in its slot of one of them."""
        empty = len(self.keys) - 1
        both = [self._slot(self.keys[:-1], k).tolist() for k in (0, 1)]
        slots = [np.full(1 << SLOT_BITS, empty, dtype=np.int64) for _ in both]
        for key in range(empty):
            k = 0
            for _ in range(500):
                at = both[k][key]
                slots[k][at], key = key, int(slots[k][at])
                if key == empty:
                    break
                k = 1 - k
            else:
                raise ValueError("the merge table does not fit its hash slots")
        self.slots = slots

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the merge table; the last place where it has none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = self.slots[0][self._slot(key, 0)]
        miss = np.flatnonzero(self.keys[at] != key)
        again = self.slots[1][self._slot(key[miss], 1)]
        at[miss] = np.where(self.keys[again] == key[miss], again, len(self.keys) - 1)
        return at

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Surviving symbols of each sequence; symbols: all sequences' one after the other, -1 where it can't merge."""
        left = counts.copy()
        which = np.flatnonzero(counts > 1)
        seq = np.repeat(np.arange(len(counts)), counts)
        keep = counts[seq] > 1
        symbols, seq = symbols[keep].astype(np.int64), seq[keep]
        while len(which):
            same = seq[:-1] == seq[1:]
            at = np.full(len(symbols), len(self.keys) - 1, dtype=np.int64)
            at[:-1][same] = self._look(symbols[:-1][same], symbols[1:][same])
            ranks = self.ranks[at]
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            low = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            hit = (ranks == np.repeat(low, lengths)) & (ranks < NONE)
            # of overlapping hits every second one counts, from the left
            place = np.flatnonzero(hit)
            run = np.cumsum(np.concatenate([[True], np.diff(place) != 1])) - 1 if len(place) else place
            first = np.flatnonzero(np.concatenate([[True], np.diff(run) != 0])) if len(place) else place
            place = place[(np.arange(len(place)) - first[run]) % 2 == 0] if len(place) else place
            if len(place):
                place = self._safe(symbols, seq, at, low, starts, place)
                symbols[place] = self.made[at[place]]
                gone = np.zeros(len(symbols), dtype=bool)
                gone[place + 1] = True
                left -= np.bincount(seq[place], minlength=len(left))
            else:
                gone = np.zeros(len(symbols), dtype=bool)
            done = np.repeat(low >= NONE, lengths)
            keep = ~(gone | done)
            symbols, seq = symbols[keep], seq[keep]
            single = left[seq] <= 1
            if single.any():
                symbols, seq = symbols[~single], seq[~single]
            which = seq
        return left

    def merge_ranked(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """As merge(), where each step costs what it changes."""
        n = len(symbols)
        seq, symbols = np.repeat(np.arange(len(counts)), counts), symbols.astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(counts)
        after[ends[counts > 0] - 1] = n  # no neighbour across sequences
        before[(ends - counts)[counts > 0]] = -1
        at = np.full(n, len(self.keys) - 1, dtype=np.int64)
        inner = np.flatnonzero(after < n)
        at[inner] = self._look(symbols[inner], symbols[inner + 1])
        ranks = self.ranks[at]
        buckets: dict[int, list[np.ndarray]] = {}

        def wait(places: np.ndarray) -> None:
            own = ranks[places]
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
                r = int(own[a])
                if r in buckets:
                    buckets[r].append(places[a:b])
                else:
                    buckets[r] = [places[a:b]]
                    heappush(heap, r)

        heap: list[int] = []
        start = np.flatnonzero(ranks < NONE)
        if len(start):
            wait(start)
        gone = np.zeros(n, dtype=bool)
        while heap:
            r = heappop(heap)
            held = buckets.pop(r)
            place = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            place = place[ranks[place] == r]
            if not len(place):
                continue
            if len(place) > 1:  # of overlapping places every second one counts, from the left
                run = np.concatenate([[True], after[place[:-1]] != place[1:]])
                first = np.flatnonzero(run)[np.cumsum(run) - 1]
                place = place[(np.arange(len(place)) - first) % 2 == 0]
            if len(place) > 1:
                wild = place[self._sets_off(symbols, at, after, before, place, r)]
                # the last such place before each one, itself left out
                last = np.searchsorted(wild, place) - 1
                later = (last >= 0) & (place - wild[np.maximum(last, 0)] <= self.reach) if len(wild) else np.zeros(len(place), dtype=bool)
                if later.any():
                    wait(place[later])
                    place = place[~later]
            right = after[place]
            beyond = after[right]
            symbols[place] = self.made[at[place]]
            gone[right], ranks[right] = True, NONE
            after[place] = beyond
            inside = beyond < n
            before[beyond[inside]] = place[inside]
            left = before[place]
            changed = np.unique(np.concatenate([left[left >= 0], place]))
            changed = changed[~gone[changed]]
            ranks[changed] = NONE
            changed = changed[after[changed] < n]
            at[changed] = self._look(symbols[changed], symbols[after[changed]])
            ranks[changed] = self.ranks[at[changed]]
            changed = changed[ranks[changed] < NONE]
            if len(changed):
                wait(changed)
        return counts - np.bincount(seq[gone], minlength=len(counts))

    def _sets_off(self, symbols, at, after, before, place, rank):
        """Whether the merge at each place, after those to its left, makes a pair of lower rank."""
        n, made = len(symbols), self.made[at[place]]
        beyond, left = after[after[place]], before[place]
        low = np.zeros(len(place), dtype=bool)
        ok = np.flatnonzero(beyond < n)
        low[ok] = self.ranks[self._look(made[ok], symbols[beyond[ok]])] < rank
        merged = np.concatenate([[False], beyond[:-1] == place[1:]])  # the neighbour to the left is such a place too
        ok = np.flatnonzero((left >= 0) & ~merged)
        low[ok] |= self.ranks[self._look(symbols[left[ok]], made[ok])] < rank
        ok = np.flatnonzero(merged)
        low[ok] |= self.ranks[self._look(made[ok - 1], made[ok])] < rank
        return low

    def _safe(self, symbols, seq, at, low, starts, place):
        """Of the places to merge at once, only the leftmost of each sequence where a merge makes a pair of lower rank."""
        many = np.bincount(np.searchsorted(starts, place, "right") - 1, minlength=len(starts))
        if many.max() < 2:
            return place
        made = self.made[at]
        new = symbols.copy()
        new[place] = made[place]
        gone = np.zeros(len(symbols), dtype=bool)
        gone[place + 1] = True
        rest = np.flatnonzero(~gone)
        pair = seq[rest[:-1]] == seq[rest[1:]]
        ranks = np.full(len(rest), NONE)
        ranks[:-1][pair] = self.ranks[self._look(new[rest[:-1]][pair], new[rest[1:]][pair])]
        group = np.searchsorted(starts, rest, "right") - 1
        # a single merge may also stand beside an unmerged neighbour of the same pair
        half = np.full(len(place), NONE)
        nxt = place + 2
        ok = (nxt < len(symbols)) & (seq[np.minimum(nxt, len(seq) - 1)] == seq[place])
        half[ok] = self.ranks[self._look(made[place[ok]], symbols[nxt[ok]])]
        bad = np.zeros(len(starts), dtype=bool)
        bad[group[ranks < low[group]]] = True
        of = np.searchsorted(starts, place, "right") - 1
        bad[of[half < low[of]]] = True
        first = np.concatenate([[True], of[1:] != of[:-1]])
        return place[first | ~bad[of]]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        if len(self.known) > CACHE_WORDS:
            self.known = {"": 0}
        known = self.known
        new = [w for w in words if w not in known]
        long = [w for w in new if len(w) > LONG]
        lengths: dict[str, int] = {}
        if long:
            new = [w for w in new if len(w) <= LONG]
            start = size = 0
            for i, w in enumerate(long):
                size += len(w)
                if size >= AT_ONCE or i + 1 == len(long):
                    part = long[start : i + 1]
                    lengths.update(zip(part, self._counted(part, self.merge_ranked).tolist()))
                    start, size = i + 1, 0
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self._counted(part, self.merge).tolist()))
        return np.array([known[w] if w in known else lengths[w] for w in words], dtype=np.int64)

    def _counted(self, words: list[str], merge) -> np.ndarray:
        """Tokens of each of words, none of them empty: symbols that merging leaves, and bytes of unknown characters."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        symbols, counts = self.points[points], np.array([len(w) for w in words], dtype=np.int64)
        more = np.where(symbols >= 0, 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
        return merge(symbols, counts) + np.add.reduceat(more, np.cumsum(counts) - counts)

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: a mark in front, marks for spaces, cut before each run of marks and at line feeds."""
        texts = pc.fill_null(texts, "")
        marked = pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", MARK), "")
        # line feeds stand for the cuts; a real one is a token by itself, which no merge crosses either
        lines = np.asarray(pc.count_substring(texts, "\n"), dtype=np.int64)
        cut = pc.replace_substring_regex(marked, f"([^{MARK}\n])({MARK}+)", "\\1\n\\2")
        if self.apart:
            cut = pc.replace_substring_regex(cut, f"([{LETTERS}])([{self.apart}])", "\\1\n\\2")
        lists = pc.split_pattern(cut, "\n")
        coded = lists.flatten().dictionary_encode()
        per = self.count(coded.dictionary.to_pylist())[np.asarray(coded.indices)]
        ends = np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))
        total = np.concatenate([[0], np.cumsum(per)])[ends]
        out = np.diff(total, prepend=0) + lines
        return np.where(np.asarray(pc.binary_length(texts)) == 0, 0, out)


@lru_cache(maxsize=1)
def merge_counter(path: str) -> MergeCounter:
    """The worker process's own counter: its tables and the words that it knows outlive a task, bounded by CACHE_WORDS."""
    return MergeCounter(path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for each row of docs (doc_id, text).

    Null text counts as empty: no bytes, no tokens. Rows are independent, repeated rows give repeated results, other
    columns are left out, an empty table gives an empty result. Whole texts are counted, however long.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(model_path)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                n = counter.count_texts(batch.column("text"))
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)
