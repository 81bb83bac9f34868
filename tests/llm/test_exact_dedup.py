"""Exact dedup against a plain grouping; the perfect hash by itself."""

import hashlib
import random

import numpy as np
import pytest

from entityfusion.llm import common, exact_dedup
from entityfusion.llm.common import Scratch

DOCS = "doc_id bigint, text string, digest string, keep_id string, shard string"


def plain(rows):
    """(doc_id, keep_id, size, kept, sha256) of each row."""
    norm = [(i, hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()).hexdigest()) for i, t, *_ in rows]
    out = []
    for i, d in norm:
        same = [j for j, e in norm if e == d]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, d))
    return sorted(map(repr, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "d", "k", "s") for i, t in rows], DOCS).repartition(3)


def got(df):
    return sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])) for r in df.collect())


ODD = [(1, None), (2, ""), (3, "A b"), (4, "a B"), (5, "Ä"), (6, "ä"), (7, "x" * 300_000), (8, "X" * 300_000), (8, "X" * 300_000), (None, "a b"), (None, "alone"), (9, "a b "), (10, "İ"), (11, "i̇")]


def test_exact_dedup(spark):
    rng = random.Random(3)
    rows = ODD + [(i, rng.choice(["hot", f"T{rng.randint(0, 150)}", f"t{rng.randint(0, 150)}"])) for i in range(20, 600)]
    assert got(exact_dedup.op13_exact_dedup(frame(spark, rows))) == plain(rows)


def test_exact_dedup_over_shards_and_hot_keys(spark, monkeypatch):
    rng = random.Random(4)
    rows = ODD + [(i, rng.choice(["hot", f"t{rng.randint(0, 300)}"])) for i in range(20, 900)]
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 10)
    docs = frame(spark, rows)
    found = exact_dedup.dedup(docs.filter("doc_id % 3 = 0"), docs.filter("not coalesce(doc_id % 3 = 0, false)"), Scratch(spark, "t"), 20)
    assert got(found.selectExpr("*", "lower(hex(digest)) as text_sha256")) == plain(rows)


def test_repeats_and_new_texts(spark):
    scratch = Scratch(spark, "t")
    old, new = (scratch.table(exact_dedup.digests_of(frame(spark, r))) for r in ([(1, "a"), (5, "b"), (2, "c")], [(3, "A"), (4, "B"), (6, "n"), (7, "N")]))
    index = scratch.table(exact_dedup.build_index(old, 2))
    rows = {bytes(r["digest"]): tuple(r)[1:] for r in exact_dedup.look_up(index, new, 2).collect()}
    of = lambda t: rows[hashlib.sha256(t.encode()).digest()]
    assert (of("a"), of("b"), of("c"), of("n")) == ((3, 2, True), (5, 2, True), (2, 1, None), (7, 2, False))
    assert sum(len(r["sizes"]) for r in index.collect()) == 3  # as many slots as digests


@pytest.mark.parametrize("split", ["history", "intake", "both"])
def test_empty_sides(spark, split):
    rows, none = frame(spark, ODD), frame(spark, [])
    found = exact_dedup.dedup(none if split != "intake" else rows, none if split != "history" else rows, Scratch(spark, "t"))
    assert found.count() == (0 if split == "both" else len(ODD))
    assert exact_dedup.op13_exact_dedup(none).count() == 0


def test_perfect_hash():
    rng = random.Random(1)
    for n in (0, 1, 2, 1000, 20_000):
        keys = list({rng.randbytes(32) for _ in range(n)})
        words = exact_dedup.words_of(keys)
        made = exact_dedup.PerfectHash(*exact_dedup.PerfectHash.build(words))
        assert sorted(made.slots(words)) == list(range(n))
    others = exact_dedup.words_of([rng.randbytes(32) for _ in range(1000)])
    slots = made.slots(others)
    assert slots.min() >= -1 and slots.max() < 20_000 and np.any(slots >= 0)
