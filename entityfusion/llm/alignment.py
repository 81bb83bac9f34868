"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizers spell the same bytes. At any place one side leads: the transducer's state is which side that is and the bytes of its last token
that the other side has not matched yet. The next token always comes from the side that lags; it overlaps the leader's last token (a link), and
shortens the residual, empties it (which closes a group) or takes the lead with a residual of its own. Transitions depend only on
state and token, so they are memoised.

Texts are cut where both tokenizers cut whatever surrounds the place: between a character that is no white space and a space, or other white
space that no piece of B joins to anything. Tokens, groups and links of such chunks are worked out once and remembered (bounded).

Counts of id pairs cover the whole corpus: each document becomes a row of a written table with its distinct pairs and how often it has
each; they are added up (combined before the shuffle), and the totals meet the documents' pairs again: broadcast while few, otherwise hot pairs
apart and the rest by shuffle.

Defined results: null and empty texts, and texts that either tokenizer does not spell back byte by byte, have no tokens: zeros and ''.
Repeated rows are documents of their own and count twice; a null doc_id is kept; columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import functools
import json
import os
import re
import string
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of
from .common import WHITE_SPACE, ChunkCache, Scratch, by_batch, look_up_by_key, small_batches, texts_of

#: A pair is a number: A's id times 2^SHIFT, plus B's id.
SHIFT = 24
#: Transitions that are remembered before all are dropped.
TRANSITIONS = 400_000
SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
ARROW = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
NONE = (0, 0, 0, 0, "", [], [])


@functools.cache
def bytes_a(path: str):
    """A byte-level tokenizer that takes special strings as text, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Tokenizer

    made, back = Tokenizer.from_file(path), byte_of()
    made.encode_special_tokens = True
    shown = (made.id_to_token(i) or "" for i in range(made.get_vocab_size()))
    return made, [bytes(back[c] for c in s) if all(c in back for c in s) else b"" for s in shown]


@functools.cache
def bytes_b(path: str):
    """A piece tokenizer, the bytes of each id, and the white space at which it always cuts."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [made.id_to_piece(i) for i in range(made.vocab_size())]
    spelt = [bytes([int(s[3:-1], 16)]) if made.is_byte(i) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
    joined = {c for i, s in enumerate(names) if len(s) > 1 and not made.is_byte(i) for c in s}
    if any("▁" in s.lstrip("▁") for s in names):
        raise ValueError("a piece goes on after a word's end: chunks can't be cut before spaces")
    spaces = [c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE_SPACE}]", c)]
    return made, spelt, " " + "".join(c for c in spaces if c != " " and c not in joined)


def marks_apart(a, spelt_a: list[bytes], b, spelt_b: list[bytes]) -> str:
    """Punctuation marks before which both tokenizers cut behind a letter of ASCII: A's pattern ends a match there, and no entry of either
    vocabulary holds the two side by side, so no merge leads over the place."""
    made = json.loads(a.pre_tokenizer.__getstate__()) if a.pre_tokenizer else {}
    if a.normalizer or made.get("type") != "ByteLevel" or not made["use_regex"] or len(b.encode("a")) != 1:
        return ""
    joined = {m for t in (*spelt_a, *spelt_b) for m in re.findall(rb"[A-Za-z]([!-/:-@\[-`{-~])", t)}
    return "".join(c for c in string.punctuation if c.encode() not in joined)


def chunk_pattern(cuts: str, marks: str = "") -> re.Pattern:
    """Chunks: white space, other characters, and what follows up to a place before one of ``cuts``, or between a letter of ASCII and one of ``marks``."""
    space, letter, cut = f"[{WHITE_SPACE}]", "[A-Za-z]", f"(?![{re.escape(cuts)}])"
    other, on = f"[^A-Za-z{WHITE_SPACE}]", f"[^A-Za-z{WHITE_SPACE}{re.escape(marks)}]"
    rest = f"(?:{on}{other}*{letter}*)*"
    return re.compile(f"{space}*(?:{other}+{letter}*|{letter}+){rest}(?:{cut}{space}+{other}*{letter}*{rest})*|{space}+")


class Transducer:
    """States are numbers; 0 is the empty residual."""

    def __init__(self, spelt_a: list[bytes], spelt_b: list[bytes]):
        self.spelt = (spelt_a, spelt_b)
        self._start()

    def _start(self) -> None:
        self.known: dict[tuple[int, bytes], int] = {}
        self.leads, self.residual, self.steps, self.size = [0], [b""], [{}], 0

    def _state(self, leads: int, residual: bytes) -> int:
        if not residual:
            return 0
        if (at := self.known.setdefault((leads, residual), len(self.steps))) == len(self.steps):
            self.leads.append(leads)
            self.residual.append(residual)
            self.steps.append({})
        return at

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that lags (of A in state 0); -1 if its bytes are not the residual's."""
        leads, residual = self.leads[state], self.residual[state]
        t = self.spelt[0 if state == 0 else 1 - leads][token]
        if not t or t[: len(residual)] != residual[: len(t)]:
            to = -1
        elif len(t) <= len(residual):
            to = self._state(leads, residual[len(t) :])
        else:
            to = self._state(0 if state == 0 else 1 - leads, t[len(residual) :])
        self.steps[state][token] = to
        self.size += 1
        return to

    def align(self, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """Groups as text, and the linked pairs; None if the two don't spell the same bytes."""
        if self.size > TRANSITIONS:
            self._start()
        steps, leads, groups, pairs, i, j, m, n = self.steps, self.leads, [], [], 0, 0, len(a), len(b)
        first = steps[0].get
        while i < m:
            from_a, from_b, token = i, j, a[i]
            i += 1
            state = first(token)
            if state is None:
                state = self._step(0, token)
            while state > 0:
                if leads[state]:  # B leads: A's turn
                    if i == m:
                        return None
                    token = a[i]
                    i += 1
                else:
                    if j == n:
                        return None
                    token = b[j]
                    j += 1
                to = steps[state].get(token)
                if to is None:
                    to = self._step(state, token)
                state = to
                pairs.append((a[i - 1] << SHIFT) + b[j - 1])
            if state < 0:
                return None
            if i - from_a == 1 == j - from_b:
                groups.append(f"{a[from_a]}|{token}")
            else:
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
        return (";".join(groups), pairs) if j == n else None


class Aligner:
    """Both tokenizers and the transducer in one Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.spelt_a = bytes_a(path_a)
        self.b, self.spelt_b, cuts = bytes_b(path_b)
        self.word_start, self.letter = self.b.piece_to_id("▁"), self.b.encode("a")
        self.marks = marks_apart(self.a, self.spelt_a, self.b, self.spelt_b)
        self.pattern, self.transducer = chunk_pattern(cuts, self.marks), Transducer(self.spelt_a, self.spelt_b)
        self.cache = ChunkCache(self._fill)

    def _pieces(self, chunks: list[str]) -> list[list[int]]:
        """B's ids of each chunk. B puts a space before what it gets: that is a chunk's own first space, or is taken off again, with a letter where
        a chunk begins behind one."""
        marks = self.marks
        given = self.b.encode([c[1:] if c[0] == " " else f"a{c}" if c[0] in marks else c for c in chunks], num_threads=1)
        start = lambda c: self.letter if c[0] in marks else [self.word_start]
        return [(ids or [self.word_start]) if c[0] == " " else ids[1:] if ids[:1] == start(c) else [] for c, ids in zip(chunks, given, strict=True)]

    def _fill(self, chunks: list[str]):
        """For each chunk: groups, pairs (8 bytes each), tokens of A and of B; None where it is not spelt back."""
        encoded, spelt = self.a.encode_batch_fast(chunks, add_special_tokens=False), self.spelt_a.__getitem__
        for c, e, b in zip(chunks, encoded, self._pieces(chunks), strict=True):
            a = e.ids
            # what is aligned is spelt alike by both
            made = self.transducer.align(a, b) if b"".join(map(spelt, a)) == c.encode() else None
            yield None if made is None else (made[0].encode(), array("q", made[1]).tobytes(), len(a), len(b))

    def row(self, text: str) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs, times."""
        if not text:
            return NONE
        parts = list(self.cache.values(self.pattern.findall(" " + text)))
        self.cache.settle()
        if None in parts:
            return NONE
        groups, linked, of_a, of_b = zip(*parts, strict=True)
        pairs, times = np.unique(np.frombuffer(b"".join(linked), np.int64), return_counts=True)
        n_a, n_b, n_links = sum(of_a), sum(of_b), int(times.sum())
        return n_a, n_b, n_a + n_b - n_links, n_links, sha256(b";".join(groups)).hexdigest(), pairs, times


@functools.cache
def aligner_at(path_a: str, path_b: str) -> Aligner:
    """A worker's aligner: what it remembers (bounded) serves all tasks of the worker."""
    return Aligner(path_a, path_b)


def align_documents(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """A row for each document: counts, digest of its groups, its distinct id pairs and how many links have each."""
    small_batches(docs.sparkSession, rows=500, size="4m")

    def make():
        aligner = aligner_at(path_a, path_b)

        def step(batch):
            rows = zip(*map(aligner.row, texts_of(batch, text)), strict=True)
            columns = list(rows) or [[]] * (len(ARROW) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, ARROW.types[1:], strict=True))], schema=ARROW)

        return step

    return by_batch(docs.select("doc_id", text), make, SCHEMA)


def pair_counts(aligned: DataFrame, scratch: Scratch) -> DataFrame:
    """pair, a_id, b_id, n_links over all documents, uses (documents that have it), best: whether no other pair of b_id has more links.

    The largest counts are one row an id of B, fewer than 2^SHIFT whatever the corpus; in practice the vocabulary."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"), F.count(F.lit(1)).alias("uses"))
    counts = scratch.table(counts.select("*", F.shiftright("pair", SHIFT).alias("a_id"), (F.col("pair") % (1 << SHIFT)).alias("b_id")), "counts")
    most = counts.groupBy("b_id").agg(F.max("total").alias("most"))
    return scratch.table(counts.join(most, "b_id").withColumn("best", F.col("total") == F.col("most")).drop("most"), "pairs")


def with_corpus_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """aligned with n_best and count_sum. aligned: a written table with ``row``, a number of its own for each row."""
    uses = counts.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = look_up_by_key(each, counts.select("pair", "total", "uses", "best"), "pair", "uses", uses)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


def op11_alignment(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    scratch = Scratch(documents.sparkSession, "op11")
    aligned = scratch.table(align_documents(documents, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    found = with_corpus_counts(aligned, pair_counts(aligned, scratch))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
