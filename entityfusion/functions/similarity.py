"""Text similarities that have no built-in equivalent, over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sequence_ratio(left: str | None, right: str | None) -> float:
    """difflib's ratio of both texts, lower-cased with white space normalised; 0 if one is blank."""
    a, b = (" ".join((t or "").split()).lower() for t in (left, right))
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def text_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        yield pd.Series([sequence_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def longest_common_subsequence(a: str, b: str) -> int:
    """Its length, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        both = row & at.get(c, 0)
        row = (row + both) | (row - both)
    return (~row & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths)."""
    both = len(a) + len(b)
    return 100.0 * 2 * longest_common_subsequence(a, b) / both if both else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best indel ratio of the shorter text with a window of the longer one, windows cut at both ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n = len(short)
    spans = [(0, i) for i in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(i, len(long)) for i in range(len(long) - n + 1, len(long))]
    best = max(indel_ratio(short, long[i:j]) for i, j in spans)
    if len(a) == len(b) and best < 100:
        best = max(best, max(indel_ratio(long, short[i:j]) for i, j in spans))
    return best


def token_ratio(a: str, b: str, partial: bool) -> float:
    """The better of the ratios of sorted words and of common words with the rest."""
    ratio = partial_ratio if partial else indel_ratio
    wa, wb = sorted(a.split()), sorted(b.split())
    if not wa or not wb:
        return 0.0
    sa, sb = set(wa), set(wb)
    both, only_a, only_b = sorted(sa & sb), sorted(sa - sb), sorted(sb - sa)
    best = ratio(" ".join(wa), " ".join(wb))
    if partial:
        return 100.0 if both else max(best, ratio(" ".join(only_a), " ".join(only_b)))
    if both and (not only_a or not only_b):
        return 100.0
    common = " ".join(both)
    first, second = (" ".join([*both, *rest]) for rest in (only_a, only_b))
    best = max(best, ratio(first, second))
    return max(best, ratio(common, first), ratio(common, second)) if both else best


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, word-wise and partial ratios, each with the weight that its leniency deserves (0 to 100).

    Fixed values: 0.95 for word-wise; partial ones count from a length ratio of 1.5 on, 0.9, or 0.6 above 8."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = indel_ratio(a, b)
    if longer < 1.5:
        return max(best, token_ratio(a, b, False) * 0.95)
    scale = 0.9 if longer <= 8 else 0.6
    return max(best, partial_ratio(a, b) * scale, token_ratio(a, b, True) * 0.95 * scale)
