"""The best term by bounds against scoring every term."""

import random

import pytest
from pyspark.sql import functions as F

from entityfusion.functions.fuzzy_index import TermIndex
from entityfusion.functions.similarity import weighted_ratio
from entityfusion.operators import dictionary

WORDS = ["senior", "software", "engineer", "lead", "data", "scientist", "of", "the", "intern", "ing", "müller", "c++", "a", "aa", " ", "  ", "x"]


def text(rng):
    if rng.random() < 0.5:
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5)))
    s = list(" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))))
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(s) + 1)
        if rng.random() < 0.5 and i < len(s):
            s.pop(i)
        else:
            s.insert(i, rng.choice("abcde fg\t\0"))
    return "".join(s)


def plain(value, terms, threshold):
    score, i = max(((weighted_ratio(value, t), -i) for i, t in enumerate(terms)), default=(-1.0, 0))
    return (-i, score) if score >= max(threshold, 0.0) else None


def names(rng, n):
    parts = ["ka", "lo", "mi", "ter", "son", "ber", "ing", "ville", "dra", "qu", "ost", "hen", "fri", "zu"]
    made = set()
    while len(made) < n:
        made.add(" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 3))))
    return sorted(made)


@pytest.mark.parametrize("threshold", [0, 40, 60, 80, 90, 95])
def test_best_of_bounds(threshold):
    rng = random.Random(threshold)
    for _ in range(60):
        terms = [text(rng) for _ in range(rng.randint(0, 30))]
        index = TermIndex(terms)
        for _ in range(15):
            value = text(rng)
            assert index.best(value, threshold) == plain(value, terms, threshold), (value, terms)


def test_few_are_scored():
    """Of 20,000 terms one or so in a thousand are scored, and the answers are those of all pairs."""
    rng = random.Random(1)
    terms = names(rng, 20_000)
    index = TermIndex(terms)
    values = []
    for _ in range(200):
        t = rng.choice(terms)
        i = rng.randrange(len(t))
        values.append(t[:i] + rng.choice("xyz") + t[i + 1 :])
    got = [index.best(v, 90) for v in values]
    assert index.scored < 0.01 * len(values) * len(terms)
    for v, g in list(zip(values, got, strict=True))[:2]:
        assert g == plain(v, terms, 90)


def test_blocks_of_terms(spark, monkeypatch):
    rng = random.Random(2)
    terms = names(rng, 300)
    rows = [("d", i // 3, i % 3, t, t, i % 3 > 0, t, "c", "p", [], {}) for i, t in enumerate(terms)] + [("e", 0, 0, "solo", "solo", False, "solo", None, None, [], {})]
    held = spark.createDataFrame(rows, dictionary.TERMS)
    values = [t[:-1] + "x" for t in rng.sample(terms, 60)] + ["", None, "zzz", "solo"]
    given = spark.createDataFrame([(d, v) for d in ("d", "e", "none") for v in values], "domain string, value string")
    want = {(r["domain"], r["value"]): r["fuzzy"] for r in dictionary.fuzzy_best(given, held, 60).collect()}
    monkeypatch.setattr(dictionary, "BLOCK_TERMS", 40)
    got = {(r["domain"], r["value"]): r["fuzzy"] for r in dictionary.fuzzy_best(given, held, 60).collect()}
    assert got == want and len(want) == 3 * len(values)
    ordered = [t for _, t in sorted(((r[1], r[5], r[2]), r[3]) for r in rows[:-1])]
    for v in values:
        best = plain(v or "", ordered, 60)
        assert (want["d", v] and (want["d", v]["term"], want["d", v]["score"])) == (best and (ordered[best[0]], best[1]))
    assert dictionary.fuzzy_best(given.filter(F.lit(False)), held).count() == 0
