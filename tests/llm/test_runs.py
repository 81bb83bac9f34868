"""Periodic runs against their definition."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from entityfusion.llm import runs

DOCS = "doc_id bigint, text string, start string, period string, n_runs string"


def plain_runs(w):
    """Every maximal stretch by the definition: for each period, stretches of equal words q apart, smallest period only."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(b"%d" % doc_id)) % 10 == 0:
        g, old = h // 10, list(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        for i in range(a, n):
            w[i] = old[a + (i - a) % p]
    found = plain_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[0] if found else None
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    told, left = "".join(f"{s},{m},{q}\n" for s, m, q in found), b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(found), *four, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def words(rng):
    """Nested repetitions with faults, over few or many words."""
    letters, out = "abcdefgh"[: rng.choice([1, 2, 2, 3, 8])], []
    while len(out) < rng.randint(0, 90):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 7))]
        if out and rng.random() < 0.5:
            i = rng.randrange(len(out))
            part = out[i : i + rng.randint(1, 30)]
        out += part * rng.choice([1, 1, 2, 4, 5, 9])
        if rng.random() < 0.3:
            out.append(rng.choice(letters))
    return out[:140]


def test_runs_by_definition():
    rng = random.Random(7)
    for _ in range(150):
        texts = [words(rng) for _ in range(rng.randint(1, 12))]
        assert runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_all_short_words():
    import itertools

    texts = [list(t) for n in range(13) for t in itertools.product("ab", repeat=n)]
    assert runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_factors_by_definition():
    rng = random.Random(2)
    for _ in range(60):
        w = words(rng) or ["a"]
        f = runs.Factors(np.array([ord(c) for c in w]))
        assert f.order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        lpf, source = runs.previous_factors(f)
        match = lambda i, j: next((k for k in range(len(w) - j) if w[i + k] != w[j + k]), len(w) - j)
        for i, (size, at) in enumerate(zip(lpf.tolist(), source.tolist(), strict=True)):
            assert size == max((match(j, i) for j in range(i)), default=0)
            assert w[at : at + size] == w[i : i + size] and (at < i or not size)


def test_query(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "x\x1cy\x85 z　q " * 6, "Ein Wort " * 4, "\n".join(["same line here"] * 4)]
    rows = [(i, t, "s", "p", "n") for i, t in enumerate(texts + [" ".join(words(rng)) for _ in range(200)])]
    rows += [rows[5], (None, "b b b b b b b", None, None, None), (None, None, None, None, None)]
    got = runs.op12_periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(i, t)) for i, t, *_ in rows)
    assert runs.op12_periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("kind", ["one word", "period 4", "nested", "prose", "fibonacci"])
def test_long_texts(kind):
    rng, n = random.Random(1), 300_000
    w = {
        "one word": lambda: ["a"] * n, "period 4": lambda: list("abcd") * (n // 4), "prose": lambda: [str(int(rng.paretovariate(0.7))) for _ in range(n)],
        "nested": lambda: (["a"] * 7 + ["b"]) * 9 * (n // 72) + ["c"],
        "fibonacci": lambda: list(fibonacci(n)),
    }[kind]()
    began = time.time()
    (found,) = runs.runs_of([w])
    assert time.time() - began < 30
    if kind == "one word":
        assert found == [(0, n, 1)]
    if kind == "period 4":
        assert found == [(0, n, 4)]
    if kind == "nested":
        assert (0, len(w) - 1, 8) in found and found.count((8, 7, 1)) == 1 and len(found) == 9 * (n // 72) + 1
    if kind == "fibonacci":
        assert found == []  # no fourth powers


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]
