"""The best term for a value by weighted ratio, without scoring every term.

An index over a block of terms gives each term an upper bound of its ratio with a value, as array operations over the block; terms are
scored from the highest bound down, until no bound reaches the best score so far or the threshold. Bounds, each exact for what it bounds:

* a common subsequence is no longer than the characters that both texts have, with multiplicity (first by sets of characters as 64-bit
  masks, then by counts in buckets, for terms that are still in);
* a window of the longer text that is not the shorter text itself misses one of its characters at least, and an Aho-Corasick automaton over
  the terms (and a search of the terms for the value) tells which texts contain each other;
* word-wise ratios take common words as a start of both texts: a word index tells how many characters those have; texts that repeat a word
  count as equal.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np

from .similarity import weighted_ratio

#: Buckets of characters that are counted apart.
BUCKETS = 48
#: Rounding that a bound allows for.
SLACK = 1e-6


def _mask(text: str) -> int:
    m = 0
    for c in text:
        m |= 1 << (ord(c) * 0x9E37 >> 3) % 64
    return m


def _counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int32)
    for c, n in Counter(text).items():
        out[(ord(c) * 0x9E37 >> 2) % BUCKETS] += n
    return out


class TermIndex:
    """An index of terms in their order; ``best`` answers with the first of those with the highest ratio."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        tight = ["".join(t.split()) for t in terms]
        words = [t.split() for t in terms]
        self.length = np.array([len(t) for t in terms], np.int64)
        self.dark = np.array([len(t) for t in tight], np.int64)  # characters that are no white space
        self.gaps = np.array([max(0, len(w) - 1) for w in words], np.int64)  # spaces between words
        self.repeats = np.array([len(set(w)) < len(w) for w in words], bool)
        self.masks = np.array([_mask(t) for t in tight], np.uint64)
        self.counts = np.array([_counts(t) for t in tight], np.int32).reshape(len(terms), BUCKETS)
        self.by_word: dict[str, list[int]] = {}
        places: dict[str, list[int]] = {}
        for i, (t, w) in enumerate(zip(terms, words, strict=True)):
            for x in set(w):
                self.by_word.setdefault(x, []).append(i)
            if t:
                places.setdefault(t, []).append(i)
        self.inside = ahocorasick.Automaton()
        for t, at in places.items():
            self.inside.add_word(t, at)
        if places:
            self.inside.make_automaton()
        # all terms as one text; a character that the value lacks stands between them
        self.joined, self.starts = "\0".join(terms), np.cumsum([0, *(len(t) + 1 for t in terms)])
        self.scored = 0

    def _containing(self, value: str) -> np.ndarray:
        """Which terms contain the value or are contained in it."""
        out = np.zeros(len(self.terms), bool)
        if len(self.inside):
            for _, at in self.inside.iter(value):
                out[at] = True
        if "\0" in value:
            out[[i for i, t in enumerate(self.terms) if value in t]] = True
        else:
            at = self.joined.find(value)
            while at >= 0:
                i = int(np.searchsorted(self.starts, at, "right")) - 1
                out[i] = True
                at = self.joined.find(value, int(self.starts[i + 1]))
        return out

    def bounds(self, value: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms whose ratio with value may be ``least`` or more, and their bounds."""
        words = value.split()
        tight = "".join(words)
        n, dark, gaps = len(value), len(tight), max(0, len(words) - 1)
        free = n - dark  # white space
        shared, letters = np.zeros((2, len(self.terms)), np.int64)  # words in common, and their characters
        for w in set(words):
            if w in self.by_word:
                shared[self.by_word[w]] += 1
                letters[self.by_word[w]] += len(w)
        loose = self.repeats | (len(set(words)) < len(words))
        held = self._containing(value)
        mask = np.uint64(_mask(tight))
        # of the shorter text's characters, at least one for each bit that the other text lacks is not common
        common = np.minimum(dark - np.bitwise_count(mask & ~self.masks).astype(np.int64), self.dark - np.bitwise_count(self.masks & ~mask).astype(np.int64))
        at = np.flatnonzero(self.length > 0)
        bound = self._bound(at, common[at], n, dark, gaps, free, shared[at], letters[at], loose[at], held[at])
        at = at[bound >= least - SLACK]
        common = np.minimum(self.counts[at], _counts(tight)).sum(1)
        bound = self._bound(at, common, n, dark, gaps, free, shared[at], letters[at], loose[at], held[at])
        keep = bound >= least - SLACK
        return at[keep], bound[keep]

    def _bound(self, at, common, n, dark, gaps, free, shared, letters, loose, held) -> np.ndarray:
        length, other = self.length[at], self.dark[at]
        spaces = np.minimum(free, length - other)
        plain = 200.0 * (common + spaces) / (n + length)
        # words sorted and joined by one space
        m, k, sorted_common = dark + gaps, other + self.gaps[at], common + np.minimum(gaps, self.gaps[at])
        by_words = 200.0 * sorted_common / np.maximum(m + k, 1)
        # common words against each text's words: a start of them, or all of them
        both = letters + np.maximum(shared - 1, 0)
        by_words = np.maximum(by_words, 200.0 * both / np.maximum(both + np.minimum(m, k), 1))
        all_of_one = (shared > 0) & ((shared == gaps + 1) | (shared == self.gaps[at] + 1))
        by_words = np.where(loose | all_of_one, 100.0, by_words)
        long = np.maximum(n, length) / np.maximum(np.minimum(n, length), 1)
        scale = np.where(long <= 8, 0.9, 0.6)
        short = np.minimum(n, length)
        window = np.minimum(common + spaces, np.where(held, short, short - 1))
        partial = 200.0 * window / np.maximum(short + window, 1)
        low = np.minimum(m, k)
        part = np.minimum(sorted_common, low)
        by_part = np.where(loose | (shared > 0), 100.0, 200.0 * part / np.maximum(low + part, 1))
        return np.where(long < 1.5, np.maximum(plain, 0.95 * by_words), np.maximum(plain, scale * np.maximum(partial, 0.95 * by_part)))

    def best(self, value: str, threshold: float) -> tuple[int, float] | None:
        """Place and ratio of the best term, the first of equals; None below the threshold."""
        least = max(threshold, 0.0)
        if not value:
            return (0, 0.0) if self.terms and least <= 0 else None
        at, bound = self.bounds(value, least)
        best, place = -1.0, -1
        for i in np.lexsort((at, -bound)).tolist():
            if bound[i] < best - SLACK:
                break
            self.scored += 1
            score, here = weighted_ratio(value, self.terms[int(at[i])]), int(at[i])
            if score > best or score == best and here < place:
                best, place = score, here
        if best <= 0 and least <= 0 and self.terms:
            return 0, 0.0  # nothing to reach: terms without any likeness are equals
        if best < least or best < 0:
            return None
        return place, best
