"""Alignment of tokenizers against whole-text tokenization and plain overlaps."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from entityfusion.llm import alignment, common

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, row string, pair string, pairs string, times string"
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a\r", "x;\r\ny );\r z", "word\n\nword \n x", "tab\tseparated\t\ttext", "naïve Ünïcode 日本語テキスト 🙂👍🏽 \x1c x　y", "a▁b", "▁", "x<|endoftext|> <s> </s> <unk> <0x0A>",
    "x\x00y", "é ́", "\xa0nbsp\xa0 \x85", "don't we'll 'tis  12 345!?  \n\n  z ", "日" * 3000, "a" * 5000, "the quick brown fox " * 500, "   x 　 y　",
]


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, from whole texts and all overlaps."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    spelt_a, spelt_b = alignment.bytes_a(A)[1], alignment.bytes_b(B)[1]
    rows, counts = [], Counter()
    for t in texts:
        raw, ids_a, ids_b = b" " + (t or "").encode(), a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        if not t or b"".join(spelt_a[i] for i in ids_a) != raw or b"".join(spelt_b[i] for i in ids_b) != raw:
            rows.append(None)
            continue
        ends = lambda ids, spelt, at=0: [at := at + len(spelt[i]) for i in ids]
        ends_a, ends_b = ends(ids_a, spelt_a), ends(ids_b, spelt_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        part = lambda ids, e, lo, hi: ",".join(str(i) for i, x in zip(ids, e, strict=True) if lo < x <= hi)
        near = 0
        links = []
        for i, (x, e) in enumerate(zip(ids_a, ends_a, strict=True)):
            s = ends_a[i - 1] if i else 0
            while near and ends_b[near - 1] > s:
                near -= 1
            while ends_b[near] <= s:
                near += 1
            k = near
            while k < len(ids_b) and (ends_b[k - 1] if k else 0) < e:
                links.append((x, ids_b[k]))
                k += 1
        counts.update(links)
        told = ""
        if len(cuts) < 400:
            told = ";".join(f"{part(ids_a, ends_a, lo, hi)}|{part(ids_b, ends_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))
        rows.append((len(ids_a), len(ids_b), len(cuts), links, told))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    for r in rows:
        if r is None:
            yield (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, n_groups, links, told = r
            best = sum(counts[x] == most[x[1]] for x in links)
            yield (n_a, n_b, n_groups, len(links), best, sum(counts[x] for x in links), sha256(told.encode()).hexdigest() if told else None)


def scraps(n, seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\r\n", "\t", "\xa0", "\x85", "　", " ", "the", "The", "Überraschung", "don't", "'s", "12", "345", "!?", ";", ");", "{", "日本", "語", "🙂", "é", "\x1c", "\x0b", "naïveté", "https://x.y/z", "<s>", "ﬁ", "½", "Ω", "​", "﻿"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def check(spark, texts):
    rows = [(i, t, "r", "p", "p", "t") for i, t in enumerate(texts)] + [(None, "the the", None, None, None, None)]
    got = alignment.op11_alignment(spark.createDataFrame(rows, DOCS).repartition(3), A, B).collect()
    want = list(plain([t for _, t, *_ in rows]))
    by_id = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert len(got) == len(rows)
    for (i, t, *_), w in zip(rows, want, strict=True):
        assert by_id[i][:6] == w[:6], t
        assert w[6] is None or by_id[i][6] == w[6], t


def test_alignment(spark):
    check(spark, ODD + ODD[:3] + scraps(400, 1))


def test_alignment_beyond_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL", 0)
    monkeypatch.setattr(common, "HOT", 30)
    monkeypatch.setattr(common, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(alignment, "TRANSITIONS", 50)
    check(spark, ODD + scraps(200, 2))


def test_empty(spark):
    assert alignment.op11_alignment(spark.createDataFrame([], DOCS), A, B).count() == 0


def test_counts_add_up(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(scraps(50, 3))], "doc_id bigint, text string")
    scratch = common.Scratch(spark, "t")
    aligned = scratch.table(alignment.align_documents(docs, A, B), "a")
    counts = alignment.pair_counts(aligned, scratch)
    assert counts.agg(F.sum("total")).first()[0] == aligned.agg(F.sum("n_links")).first()[0]
    assert counts.filter("best").select("b_id").distinct().count() == counts.select("b_id").distinct().count()


def test_transducer():
    t = alignment.Transducer([b"ab", b"a", b"c", b"bc"], [b"a", b"bc", b"b", b"abc", b""])
    assert t.align([0, 2], [0, 1]) == ("0,2|0,1", [0 << alignment.SHIFT, 1, (2 << alignment.SHIFT) + 1])
    assert t.align([1, 3], [0, 1]) == ("1|0;3|1", [1 << alignment.SHIFT, (3 << alignment.SHIFT) + 1])
    assert t.align([0], [0]) is None and t.align([1], [0, 1]) is None and t.align([1], [2]) is None and t.align([1], [4, 0]) is None and t.align([], []) == ("", [])


def test_chunks_end_before_marks():
    """A word and the marks behind it are chunks of their own, so a word is worked out once whatever marks follow it."""
    one = alignment.Aligner(A, B)
    assert not set("|>") & set(one.marks) and set(",.;:!?'#") <= set(one.marks)
    assert one.pattern.findall(" a, don't.\n,é,x|y 1,") == [" a", ",", " don", "'t", ".", "\n,é,x|y", " 1,"]
    for t in ("word", "word,", "word.", "(word)###"):
        one.row(t)
    assert [c for c in one.cache.now if "word" in c] == [" word", " (word"]
    for text in scraps(300, 9):
        assert "".join(one.pattern.findall(" " + text)) == " " + text
