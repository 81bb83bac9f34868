"""Periodic runs of words: all maximal repetitions of a text from its suffix array.

A batch of texts is one array of word numbers, unique to each text, so that nothing matches across texts, and every step is a numpy
operation over the whole array:

1. Ranks of all stretches of 1, 2, 4, ... words by doubling, each made only for stretches that are not unique yet; the last one orders the
   suffixes. Two stretches are equal if their ranks are, so the longest common extension of two places takes one look a level.
2. LCP of neighbours in the suffix array by extension; longest previous factor (LPF) of each place from the nearest suffixes on either side that
   start earlier, with the least LCP on the way (found by jumping over those that start later).
3. LPF gives the blocks of the Lempel-Ziv factorisation and where each occurred before.
4. Main's extensions: a run that is not strictly inside a block touches the start of one, b. Where length is at least four periods, that
   period is below a third of the blocks before and after b, and two periods lie to one side of b. So for each start and each such period, equal neighbouring
   stretches are looked up, least period first, and extended in both directions; periods that an earlier run of this start accounts for go.
5. Runs strictly inside a block are copied from the block's earlier occurrence, from left to right, out of buckets by start.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length of at least max(6, 4 q) that no
neighbouring word extends. A word is dropped if a run holds it after that run's first q words.

Defined results: null and empty texts have no words and no runs; the four columns of the longest run are null where there is none, and the
collapsed text is then the words joined by single spaces (an empty text for none). Repeated rows give repeated results; other columns
don't matter. Memory of a task: some 4 bytes for each word of a batch (or of its one longest text) and level; there are
log2(longest repeated stretch) levels.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, small_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
ARROW = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in (x.split()[0] for x in SCHEMA.split(", "))])


class Factors:
    """Equal stretches of an array of numbers, and its suffixes in order.

    ``levels[k][i]`` is the rank of the 2^k numbers from i on; what would go beyond the end counts as unlike anything else."""

    def __init__(self, numbers: np.ndarray):
        self.n = n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        rank = self._ranked(numbers[order], order, np.empty(n, np.int32), np.arange(n, dtype=np.int32))
        self.levels = [rank]
        group = rank[order]  # first place of each suffix's group
        while True:
            # places in the order of suffixes that share their group with a neighbour
            same = group[1:] == group[:-1]
            tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False)) if n else np.empty(0, np.int64)
            if not len(tied):
                break
            size = 1 << (len(self.levels) - 1)
            at = order[tied]
            after = at + size
            key = (group[tied].astype(np.int64) << 32) + np.where(after < n, rank[np.minimum(after, n - 1)], -1) + 1
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[tied] = at
            rank = self._ranked(key, at, rank.copy(), tied.astype(np.int32))
            group[tied] = rank[at]
            self.levels.append(rank)
        self.order = order

    @staticmethod
    def _ranked(keys: np.ndarray, at: np.ndarray, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rank with each of ``at`` set to the first place of its group of equal keys."""
        if len(keys):
            new = np.insert(keys[1:] != keys[:-1], 0, True)
            rank[at] = first[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return rank

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` (1 or more) from a and from b on, all within the array, are equal."""
        level = np.frexp(length)[1] - 1
        out = level < len(self.levels)
        for k in np.unique(level[out]).tolist():
            i = np.flatnonzero(out & (level == k))
            x, y, more, rank = a[i], b[i], length[i] - (1 << k), self.levels[k]
            out[i] = (rank[x] == rank[y]) & (rank[x + more] == rank[y + more])
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers from a and from b on agree; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[k], a + out, b + out
            met = (y < self.n) & (rank[np.minimum(x, self.n - 1)] == rank[np.minimum(y, self.n - 1)])
            out[met] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers before a and before b agree; a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, x, y = self.levels[k], a - out - (1 << k), b - out - (1 << k)
            met = (x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])
            out[met] += 1 << k
        return out


def _nearest_earlier(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix in order, the nearest one before it in the order that starts earlier in the text (-1: none), and the least lcp on
    the way. lcp[i] is that of i - 1 and i."""
    n = len(order)
    near, least = np.arange(-1, n - 1), lcp.copy()
    open_ = np.flatnonzero((near >= 0) & (least > 0))
    near[least == 0] = -1
    while len(open_):
        to = near[open_]
        open_ = open_[order[to] > order[open_]]
        to = near[open_]
        # everything between near[to] and to starts later than to does, and so later than this one
        step, low = near[to], np.minimum(least[open_], least[to])
        near[open_], least[open_] = np.where(low > 0, step, -1), low
        open_ = open_[near[open_] >= 0]
    least[near < 0] = 0
    return near, least


def previous_factors(factors: Factors) -> tuple[np.ndarray, np.ndarray]:
    """LPF of each place, and where that factor occurs earlier (itself where LPF is 0)."""
    order, n = factors.order, factors.n
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1], order[1:]
    lcp[1:] = factors.forward(np.minimum(a, b), np.maximum(a, b))
    up, up_lcp = _nearest_earlier(order, lcp)
    turned = np.append(0, lcp[1:][::-1]) if n else lcp
    down, down_lcp = _nearest_earlier(order[::-1], turned)
    down, down_lcp = np.where(down < 0, -1, n - 1 - down)[::-1], down_lcp[::-1]
    from_ = np.where(up_lcp >= down_lcp, up, down)
    length = np.maximum(up_lcp, down_lcp)
    lpf, source = np.empty(n, np.int64), np.empty(n, np.int64)
    lpf[order] = length
    source[order] = np.where(length > 0, order[from_], order)
    return lpf, source


def blocks_of(lpf: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end of the last."""
    steps, at, starts, n = np.maximum(lpf, 1).tolist(), 0, [], len(lpf)
    while at < n:
        starts.append(at)
        at += steps[at]
    return np.array([*starts, n], np.int64)


def touching_runs(factors: Factors, edges: np.ndarray) -> set[tuple[int, int, int]]:
    """start, end, period of the runs that touch the start or end of a block (Main's extensions)."""
    n, found = factors.n, set()
    size = np.diff(edges)
    most = (np.append(0, size) + np.append(size, 0)) // (LEAST_PERIODS - 1) + 1  # periods to look at, for each edge
    for after in (True, False):
        room = (n - edges if after else edges) // 2
        upto = np.minimum(most, room)
        b = np.repeat(edges, upto)
        q = np.arange(1, len(b) + 1) - np.repeat(np.cumsum(upto) - upto, upto)
        keep = factors.equal(b if after else b - 2 * q, b + q if after else b - q, q)
        b, q = b[keep], q[keep]  # by edge, then period
        while len(b):
            first = np.insert(b[1:] != b[:-1], 0, True)
            x, p = b[first], q[first]
            lo, hi = (x, x + p) if after else (x - p, x)
            start, end = lo - factors.backward(lo, hi), hi + factors.forward(lo, hi)
            long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
            found.update(zip(start[long].tolist(), end[long].tolist(), p[long].tolist(), strict=True))
            of = np.cumsum(first) - 1
            reach = b + 2 * q <= end[of] if after else b - 2 * q >= start[of]
            b, q = b[~reach & ~first], q[~reach & ~first]
    return found


def all_runs(factors: Factors, edges: np.ndarray, source: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """start -> (end, period) of all runs: those that touch a block's ends, and copies of those strictly inside earlier occurrences."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in touching_runs(factors, edges):
        buckets.setdefault(start, []).append((end, period))
    if not buckets:
        return buckets
    starts = sorted(buckets)
    for at in np.flatnonzero(np.diff(edges) >= LEAST_WORDS + 2).tolist():
        begin, end = int(edges[at]), int(edges[at + 1])
        back = begin - int(source[begin])
        if not back:
            continue
        i = bisect_right(starts, begin - back)
        while i < len(starts) and (start := starts[i]) + back < end:
            for stop, period in list(buckets[start]):
                if stop + back < end:
                    if start + back not in buckets:
                        insort(starts, start + back)
                        buckets[start + back] = []
                    if (stop + back, period) not in buckets[start + back]:
                        buckets[start + back].append((stop + back, period))
            i += 1
    return buckets


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """start, length, period of all runs of each list of words, by start, then period."""
    numbers = {w: i for i, w in enumerate({w for words in texts for w in words})}
    firsts = np.cumsum([0, *map(len, texts)])
    out: list[list] = [[] for _ in texts]
    if not firsts[-1]:
        return out
    flat = np.fromiter((numbers[w] for words in texts for w in words), np.int64, firsts[-1])
    factors = Factors(np.repeat(np.arange(len(texts)), np.diff(firsts)) * len(numbers) + flat)
    lpf, source = previous_factors(factors)
    found = all_runs(factors, blocks_of(lpf), source)
    starts = sorted(found)
    for start, k in zip(starts, (np.searchsorted(firsts, starts, "right") - 1).tolist(), strict=True):
        out[k] += [(start - int(firsts[k]), end - start, q) for end, q in sorted(found[start], key=lambda r: r[1])]
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def repeated(doc_id: int | None, words: list) -> list:
    """The words of a document; from those of every tenth checksum of an id, a part is repeated, as the task has it. A null id has no checksum."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def row_of(doc_id: int | None, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    """A row of the result."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *four, sha256(told.encode()).hexdigest(), sha256(b" ".join(kept_words(words, runs))).hexdigest()


def periodic_runs(documents: DataFrame, text: str = "text", planted: bool = False) -> DataFrame:
    """A row for each document: how many runs, the longest, digests of all runs and of the collapsed text. ``planted``: see ``repeated``."""
    small_batches(documents.sparkSession, size="2m")

    def make():
        def step(batch):
            ids = batch.column("doc_id").to_pylist()
            texts = [(value.as_py() or "").encode().split() for value in batch.column(text)]  # bytes part at just 09-0D and 20
            if planted:
                texts = list(map(repeated, ids, texts))
            rows = list(map(row_of, ids, texts, runs_of(texts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)] if rows else [pa.array([], t) for t in ARROW.types], schema=ARROW)

        return step

    return by_batch(documents.select("doc_id", text), make, SCHEMA)


def op12_periodic_runs(documents: DataFrame) -> DataFrame:
    return periodic_runs(documents, planted=True)
