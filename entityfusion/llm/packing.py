"""Packing of tokenised documents into sequences by swap-based local search.

Documents become pieces of at most ``capacity`` tokens. For packing, only a piece's length matters, so the packing is
solved on the histogram of lengths, which has at most ``capacity`` entries however many documents there are, and for
classes of bins with equal contents instead of single bins.

*Start.* Best fit by decreasing length, many equal pieces at once.
*Local search.* Takes the emptiest underfull bins and moves a piece, exchanges one for one, two for one or one for two
with fuller underfull bins, always such that the sum of squared fills rises, until a bin empties and is dropped; it ends
at a lower bound on the number of bins, or where no step between any two bins is left. What each bin could give back stands in arrays, so the best
step of a bin is looked up over all others at once. Each step applies to as many bins of the two classes as both have.

*Dealing.* Pieces of one length are interchangeable: each gets a rank among them, and the solution says for runs of
ranks which bin and offset they have. A third of all pieces may have one length, so the ranks of a common length are made in
groups of about GROUP_ROWS pieces; the counts of the groups (capacity + pieces / GROUP_ROWS numbers) give their first ranks.

Defined results: null and empty texts are one piece with the end id alone; repeated rows are packed one by one, as are
rows without id; the end id counts to the length; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_table
from .common import ChunkCache, Scratch, by_batch, small_batches, texts_of, words_by_white_space

#: Pieces of one length that are ranked in one group, about.
GROUP_ROWS = 1 << 18
#: Bins: contents -> number of bins; contents are (length, copies) pairs, longest first.
Bins = dict[tuple[tuple[int, int], ...], int]


@functools.cache
def tokenizer_at(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def as_bytes(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit numbers."""
    raw, ends = np.array(list(itertools.chain.from_iterable(ids)), "<u4").tobytes(), [0, *itertools.accumulate(4 * len(x) for x in ids)]
    return [raw[a:b] for a, b in itertools.pairwise(ends)]


#: Words that are remembered; what is rare is put together from its pieces as fast.
WORDS = 100_000
#: Words, a line each, whose characters stay one by one under composition and lower-casing: printable Latin-1.
PLAIN_WORDS = re.compile("[\n!-~\xa1-\xff]*")


def split_pattern(tokenizer) -> re.Pattern | None:
    """The pattern by which the tokenizer takes pieces from lower-cased words, as one of Latin-1 characters; None if it works in another way."""
    state = lambda part: json.loads(part.__getstate__()) if part else {}
    steps, pre = [n["type"] for n in state(tokenizer.normalizer).get("normalizers", ())], state(tokenizer.pre_tokenizer).get("pretokenizers", ())
    known = steps == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"]
    known = known and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not tokenizer.post_processor and not tokenizer.model.dropout
    if not known:
        return None
    letters, numbers = ("".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind) for kind in "LN")
    pattern = pre[0]["pattern"]["Regex"]
    for written, of in ((r"[\p{L}]", f"[{letters}]"), (r"[\p{N}]", f"[{numbers}]"), (r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]")):
        pattern = pattern.replace(written, of)
    return re.compile(pattern) if r"\p" not in pattern else None


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space and encodes what stands between on its own.

    Words are looked up; of new ones, plain words are cut into pieces by the tokenizer's own pattern, and new pieces go to its
    model, which spares a run of the whole tokenizer for each. All other words take that run."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer_at(path)
        self.cut, self.model = split_pattern(self.tokenizer), self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = {b: t for b in range(128, 256) if (t := "".join(byte_table()[x] for x in chr(b).encode("utf-8")))}
        self.words, self.parts = ChunkCache(self._words, WORDS), ChunkCache(self._parts)

    def _parts(self, parts: list[str]) -> list[bytes]:
        tokenize = self.model.tokenize
        return as_bytes([[t.id for t in tokenize(p if p.isascii() else p.translate(self.shown))] for p in parts])

    def _plain(self, words: str) -> bool:
        return bool(self.cut and PLAIN_WORDS.fullmatch(words)) and not any(x in words for x in self.special)

    def _words(self, words: list[str]) -> list[bytes]:
        whole = "\n".join(words)
        if not self._plain(whole):
            plain = [self._plain(w) for w in words]
            joined = iter(self._joined([w.lower() for w, p in zip(words, plain, strict=True) if p]))
            rest = [w for w, p in zip(words, plain, strict=True) if not p]
            others = iter(as_bytes([e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]))
            return [next(joined) if p else next(others) for p in plain]
        return self._joined(whole.lower().split("\n"))

    def _joined(self, words: list[str]) -> list[bytes]:
        """Of plain words in lower case."""
        cut = list(map(self.cut.findall, words)) if words else []
        parts = self.parts.values(list(itertools.chain.from_iterable(cut)))
        out = [next(parts) if len(c) == 1 else b"".join(itertools.islice(parts, len(c))) for c in cut]
        self.parts.settle()
        return out

    def ids(self, text: str) -> bytes:
        out = b"".join(self.words.values(words_by_white_space(text)))
        self.words.settle()
        return out


def pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, keep: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ``ids`` (little-endian unsigned 32-bit) if asked for."""
    small_batches(df.sparkSession)
    df = df.select(keep, F.col(text).alias("_text_"))
    kind = df.schema[keep].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        tokens = WordTokens(path)

        def step(batch):
            names, starts, numbers, lengths, sums, ids = [], [], [], [], [], []
            for name, whole in zip(batch.column(keep).to_pylist(), texts_of(batch, "_text_"), strict=True):
                raw = tokens.ids(whole) + end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    names.append(name)
                    numbers.append(n)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [pa.array(names, batch.schema.field(keep).type), pa.array(numbers, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))]
            columns += [pa.array(ids, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [keep, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

        return step

    return by_batch(df, make, f"`{keep}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def fill_of(bin_: tuple) -> int:
    return sum(length * n for length, n in bin_)


def changed(bin_: tuple, out: tuple[int, ...], into: tuple[int, ...]) -> tuple:
    """The contents without the pieces ``out`` and with the pieces ``into``."""
    held = dict(bin_)
    for length in out:
        held[length] -= 1
    for length in into:
        held[length] = held.get(length, 0) + 1
    return tuple(sorted(((x, n) for x, n in held.items() if n), reverse=True))


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best fit by decreasing length: each piece goes to the fullest bin that has room for it."""
    done: Bins = {}
    at: dict[int, Bins] = {}  # room left -> bins
    rooms: list[int] = []

    def put(bin_: tuple, n: int, room: int) -> None:
        if room == 0:
            done[bin_] = done.get(bin_, 0) + n
            return
        if room not in at:
            at[room] = {}
            insort(rooms, room)
        at[room][bin_] = at[room].get(bin_, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                bin_, many = at[room].popitem()
                if not at[room]:
                    del at[room], rooms[i]
            else:
                room, bin_, many = capacity, (), left
            copies = room // length
            full = min(many, left // copies)
            if full:
                put((*bin_, (length, copies)), full, room - copies * length)
                left -= full * copies
                rest = many - full
            else:
                put((*bin_, (length, left)), 1, room - left * length)
                left, rest = 0, many - 1
            if rest and bin_:
                put(bin_, rest, room)
    for held in at.values():
        for bin_, n in held.items():
            done[bin_] = done.get(bin_, 0) + n
    return done


def exchanges(bin_: tuple) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """Tokens -> pieces that a bin can give at once: none or one; two."""
    held = dict(bin_)
    one = {0: ()} | {a: (a,) for a in held}
    two = {a + b: (a, b) for a in held for b in held if a > b or a == b and held[a] > 1}
    return one, two


class Targets:
    """What all underfull bins could give back, as arrays: an exchange is found by a look-up, not tried.

    ``value[i]`` tokens leave bin ``owner[i]`` in one piece or none (``two[i]`` false), or in two. Bins that are gone stay in the arrays until half of
    them are."""

    def __init__(self, capacity: int):
        self.capacity, self.size = capacity, 0
        self.value, self.owner, self.two = np.empty(1024, np.int32), np.empty(1024, np.int32), np.empty(1024, bool)
        self.bins: list[tuple] = []
        self.fill, self.alive = np.empty(256, np.int64), np.zeros(256, bool)
        self.number: dict[tuple, int] = {}

    def add(self, bin_: tuple) -> None:
        one, two = exchanges(bin_)
        values = np.fromiter((*one, *two), np.int32)
        while self.size + len(values) > len(self.value):
            self.value, self.owner, self.two = (np.concatenate([x, np.empty_like(x)]) for x in (self.value, self.owner, self.two))
        if len(self.bins) == len(self.fill):
            self.fill, self.alive = (np.concatenate([x, np.zeros_like(x)]) for x in (self.fill, self.alive))
        at, n = slice(self.size, self.size + len(values)), len(self.bins)
        self.value[at], self.owner[at], self.two[at] = values, n, np.arange(len(values)) >= len(one)
        self.size += len(values)
        self.fill[n], self.alive[n], self.number[bin_] = fill_of(bin_), True, n
        self.bins.append(bin_)

    def remove(self, bin_: tuple) -> None:
        self.alive[self.number.pop(bin_)] = False

    def best_step(self, source: tuple, fill: int, since: int, alone: bool) -> tuple | None:
        """(target, pieces out, pieces back) between source and the bins at least as full, from entry ``since`` on, that raises the sum of squared fills
        most; one piece for none, one or two, or two for none or one. ``alone``: there is but one bin like source."""
        one, two = exchanges(source)
        ones, both = np.full((2, self.capacity + 1), -1, np.int32)
        ones[[x for x in one if x]] = [x for x in one if x]
        both[:] = ones
        both[[x for x in two if x <= self.capacity]] = [x for x in two if x <= self.capacity]
        ones, both = np.maximum.accumulate(ones), np.maximum.accumulate(both)  # the most that source can give up to so many tokens
        value, owner = self.value[since : self.size], self.owner[since : self.size]
        others = self.fill[owner]
        most = value + self.capacity - others
        gain = np.where(self.two[since : self.size], ones[most], both[most]) - value
        usable = self.alive[owner] & (others >= fill) & (gain > 0)
        if alone:
            usable &= owner != self.number[source]
        raised = np.where(usable, gain * (others - fill + gain), 0)
        i = int(np.argmax(raised)) if len(raised) else 0
        if not len(raised) or raised[i] <= 0:
            return None
        target = self.bins[owner[i]]
        give, back = exchanges(target)
        out = int(value[i] + gain[i])
        return target, one[out] if out in one else two[out], back[int(value[i])] if self.two[since + i] else give[int(value[i])]


def least_bins(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs at least (Martello and Toth's second bound): of pieces of ``least`` tokens or more, those over half a
    bin stand alone, and the others fill what room these leave."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(histogram)] = list(histogram.values())
    count, tokens = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    half = capacity // 2
    least = np.arange(1, half + 1)
    alone, beside = count[-1] - count[capacity - least], count[capacity - least] - count[half]
    rest = tokens[half] - tokens[least - 1] - (beside * capacity - (tokens[capacity - least] - tokens[half]))
    return int(max(-(-tokens[-1] // capacity), *(alone + beside + np.maximum(0, -(-rest // capacity))))) if half else int(count[-1])


def local_search(bins: Bins, capacity: int) -> Bins:
    """Empties bins by moves and exchanges between underfull bins, each of which raises the sum of squared fills.

    Bin classes give in order of emptiness, each until no step from it is left; what was looked at once is not looked at again, so a pass after the
    first only looks at new classes. Ends at the least number of bins, or where no step between any two bins is left."""
    bins = dict(bins)
    histogram: dict[int, int] = {}
    for bin_, n in bins.items():
        for length, copies in bin_:
            histogram[length] = histogram.get(length, 0) + n * copies
    least, count = least_bins(histogram, capacity), sum(bins.values())
    if count <= least:
        return bins
    targets, seen = Targets(capacity), {}
    for bin_ in bins:
        if fill_of(bin_) < capacity:
            targets.add(bin_)

    def add(bin_: tuple, n: int) -> None:
        if bin_ not in bins and fill_of(bin_) < capacity:
            targets.add(bin_)
        if bins.get(bin_, 0) == 1:
            seen.pop(bin_, None)  # two alike may exchange
        bins[bin_] = bins.get(bin_, 0) + n

    def take(bin_: tuple, n: int) -> None:
        bins[bin_] -= n
        if not bins[bin_]:
            del bins[bin_]
            targets.remove(bin_)
            seen.pop(bin_, None)

    moved = True
    while moved and count > least:
        moved = False
        if len(targets.bins) > 2 * len(targets.number) + 100:
            # anew without those that are gone; who had seen all still has
            held, quiet, targets = list(targets.number), [b for b in seen if seen[b] == targets.size], Targets(capacity)
            for bin_ in held:
                targets.add(bin_)
            seen = dict.fromkeys(quiet, targets.size)
        for source in sorted(targets.number, key=lambda b: (fill_of(b), b)):
            fill = fill_of(source)
            while count > least and source in bins:
                found = targets.best_step(source, fill, seen.get(source, 0), bins[source] < 2)
                if not found:
                    seen[source] = targets.size
                    break
                moved = True
                target, out, back = found
                n = bins[source] // 2 if source == target else min(bins[source], bins[target])
                take(source, n)
                take(target, n)
                add(changed(target, back, out), n)
                if emptied := changed(source, out, back):
                    add(emptied, n)
                else:
                    count -= n
    return bins


class Layout:
    """Where the pieces of a solution go: runs of ranks of one length."""

    def __init__(self, bins: Bins):
        runs, first, ranks = [], 0, {}
        for bin_, n in sorted(bins.items()):
            offset = 0
            for length, copies in bin_:
                rank = ranks.get(length, 0)
                runs.append((length, rank, first, offset, copies))
                ranks[length] = rank + n * copies
                offset += length * copies
            first += n
        runs.sort()
        columns = np.array(runs, np.int64).reshape(-1, 5).T
        self.key = (columns[0] << 44) + columns[1]
        self.rank, self.first, self.offset, self.copies = columns[1:]

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence_id and offset of pieces."""
        run = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        beyond = rank - self.rank[run]
        return self.first[run] + beyond // self.copies[run], self.offset[run] + beyond % self.copies[run] * length


def pack(made: DataFrame, scratch: Scratch, capacity: int = 4096, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (length and any other columns). Rows are numbered as written, so equal rows stay apart."""
    spark = made.sparkSession
    numbered = scratch.table(made.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    # at most ``capacity`` rows
    common = [(r["length"], -(-r["n"] // group_rows)) for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows).collect()]
    groups = F.coalesce(F.create_map(*(F.lit(x) for pair in common for x in pair))[F.col("length")], F.lit(1)) if common else F.lit(1)
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_n"), groups).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).toArrow()  # see Dealing
    lengths, salt, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("length", "_salt", "n"))
    if lengths.size == 0:
        return made.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    order = np.lexsort((salt, lengths))
    lengths, salt, n = lengths[order], salt[order], n[order]
    values, begin = np.unique(lengths, return_index=True)
    before = np.cumsum(n) - n
    group_key, group_rank = (lengths << 32) + salt, before - np.repeat(before[begin], np.diff([*begin, len(n)]))
    histogram = dict(zip(values.tolist(), np.add.reduceat(n, begin).tolist(), strict=True))
    sent = spark.sparkContext.broadcast((group_key, group_rank, Layout(local_search(best_fit(histogram, capacity), capacity))))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_n"))
    names = made.columns
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in made.schema)

    def make():
        keys, ranks, layout = sent.value

        def step(batch):
            length, salt, row = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_salt", "_row"))
            rank = ranks[np.searchsorted(keys, (length << 32) + salt)] + row - 1
            sequence, offset = layout.of(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

        return step

    return by_batch(salted.withColumn("_row", within), make, f"{head}sequence_id bigint, offset bigint")


def op9_packing(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    scratch = Scratch(documents.sparkSession, "packing")
    return pack(pieces(documents, path), scratch)
