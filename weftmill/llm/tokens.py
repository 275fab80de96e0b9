"""Encoding of whole texts with the lower-case word BPE, one library call for each distinct word."""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import gather_ragged, split_words

END_ID = 1
#: So many words are kept, and so many characters and ids of theirs.
CACHE_WORDS, CACHE_SIZE = 150_000, 16 << 20
#: Latin letters whose lower case and normal form are plain, then ASCII punctuation: the pre-tokenizer cuts between the two.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"


class WordEncoder:
    """ids of whole texts, equal to tokenizers' encode(text, add_special_tokens=False).

    The file's pre-tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are those
    of its pieces between spaces and line feeds, in order. A plain piece is a lower-cased word and a tail of punctuation,
    which are pre-tokens of their own; any other piece is encoded as it stands. Each distinct word is encoded once and
    kept, up to CACHE_WORDS and CACHE_SIZE; beyond that, words met in one batch only make room.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ends = [i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends_word[ends] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.size = 0
        self.counts, self.values = [np.zeros(1, dtype=np.int64)], [np.empty(0, dtype=np.uint32)]
        self.offsets, self.again = np.zeros(2, dtype=np.int64), np.ones(1, dtype=bool)

    def _make_room(self) -> None:
        """Forgets the words that no later batch met again, or all words where that is not enough."""
        if np.count_nonzero(self.again) > CACHE_WORDS // 2 or self.size > CACHE_SIZE:
            return self._clear()
        self.known = {w: i for i, w in enumerate(compress(self.known, self.again.tolist()))}
        counts, values = gather_ragged(self.offsets, self.values[0], np.flatnonzero(self.again))
        self.size = sum(map(len, self.known)) + len(values)
        self.counts, self.values = [counts], [values]
        self.offsets, self.again = np.concatenate([[0], np.cumsum(counts)]), np.zeros(len(counts), dtype=bool)
        self.again[0] = True

    def _keep(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.size += sum(map(len, words)) + len(ids)
        self.counts.append(counts)
        self.values.append(ids)

    def _learn(self, words: list[str], plain: bool) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            if plain:  # one pre-token each, so each one's ids end with its only word end
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                stops = np.flatnonzero(self.ends_word[ids]) + 1
                counts = np.diff(stops, prepend=0)
                assert len(stops) == len(part) and stops[-1] == len(ids)
            else:
                rows = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                counts = np.array([len(r) for r in rows], dtype=np.int64)
                ids = np.array([i for r in rows for i in r], dtype=np.uint32)
            self._keep(part, counts, ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after the other); null counts as empty."""
        if len(self.known) > CACHE_WORDS or self.size > CACHE_SIZE:
            self._make_room()
        pieces, distinct, codes = split_words(texts)
        parts = pc.extract_regex(distinct, PLAIN)
        plain = parts.is_valid()
        cores = pc.utf8_lower(pc.fill_null(pc.struct_field(parts, "core"), "")).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
        others = pc.if_else(plain, "", distinct).dictionary_encode()
        units = np.empty((len(distinct), 3), dtype=np.int64)
        for k, (coded, one_word) in enumerate(((cores, True), (tails, False), (others, False))):
            words = coded.dictionary.to_pylist()
            at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            new, old = at < 0, at[(at >= 0) & (at < len(self.again))]
            self.again[old] = True
            if new.any():
                fresh = len(self.known)
                self._learn(list(compress(words, new.tolist())), one_word)
                at[new] = np.arange(fresh, len(self.known))
            units[:, k] = at[np.asarray(coded.indices)]
        if len(self.counts) > 1:
            self.counts, self.values = [np.concatenate(self.counts)], [np.concatenate(self.values)]
            self.offsets = np.concatenate([[0], np.cumsum(self.counts[0])])
            self.again = np.concatenate([self.again, np.zeros(len(self.known) - len(self.again), dtype=bool)])
        n, ids = gather_ragged(self.offsets, self.values[0], units.ravel())
        offsets = np.concatenate([[0], np.cumsum(n.reshape(-1, 3).sum(axis=1))])
        n, ids = gather_ragged(offsets, ids, codes)
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.diff(ends[np.cumsum(pieces)], prepend=0), ids

    def encode_ended(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with END_ID after each text: (offsets of the texts, all ids)."""
        n, ids = self.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(offsets[-1]), END_ID, dtype=np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[offsets[1:] - 1] = False
        out[keep] = ids
        return offsets, out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The worker process's own encoder: the words that it knows outlive a task, bounded by CACHE_WORDS."""
    return WordEncoder(path)
