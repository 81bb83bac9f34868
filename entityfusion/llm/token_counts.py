"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer with its pre-tokenizer is a deterministic transducer over characters: each transition
carries the number of tokens that it adds, which may be negative where a later character joins earlier ones. The
running sum is at every place the token count of the text read so far.

*States.* The pre-tokenizer needs few modes (run of letters, numbers, others or white space, one space, apostrophe
and begun contraction). Inside a run, the state of BPE is the last token, and the count, of each prefix from which a
longer token could still begin; since the last token of a prefix is unique and decided by compatible neighbours, this
is finite. The table is compiled ahead, once a worker, along every token of the vocabulary, with and without a space before it;
combinations that only texts show are added when first met (and dropped again when they are too many), so nothing is merged twice.

*Chunk maps.* Every document is cut into pieces; each is a map from the state in which it is entered to the state in
which it is left and the tokens added. A piece that holds a synchronising place (a non-space before white space) leads
every entry to the same state after it, so its map is its head (the characters before that place), a count, and an
exit. A change of class (a letter before a digit, say) synchronises too, which counts where there is no white space; pieces without either become part of
the next one's head. Words between two such places have constant maps, which are memoised. Maps compose associatively; ``prefix_scan`` composes
them by pairs, which gives the tokens up to the end of each piece, whatever order pieces are mapped in.

Defined results: null and empty texts have 0 bytes and 0 tokens; special strings inside texts count as one token, as
in the library's default; repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of
from .common import CHUNK, WHITE_SPACE, ChunkCache, by_batch, small_batches

#: Transitions that texts may add to the compiled table before they are dropped again.
TABLE_TRANSITIONS = 600_000
#: Characters of a piece of a document.
PIECE_CHARS = 1 << 10
#: Characters after which a long stretch looks at the size of the table.
GO_CHARS = 1 << 13
#: The contractions of the byte-level pattern, after the apostrophe.
SHORT, LONG = frozenset("stmd"), {"r": "e", "v": "e", "l": "l"}
LETTER, NUMBER, SPACE, OTHER = "LNSO"
_CLASSES = ((LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(f"[{WHITE_SPACE}]")))


#: Places between a letter, number or other character (but an apostrophe) and one of another class: whatever came before, a new pre-token begins.
CHANGE = regex.compile(rf"(?<=\p{{L}})[^\p{{L}}{WHITE_SPACE}]|(?<=\p{{N}})[^\p{{N}}{WHITE_SPACE}]|(?<=[^\p{{L}}\p{{N}}{WHITE_SPACE}'])[\p{{L}}\p{{N}}]")


@functools.cache
def class_of(char: str) -> str:
    return next((k for k, p in _CLASSES if p.match(char)), OTHER)


class Merges:
    """Token bytes, and which two neighbours BPE would leave as they are."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.vocab, self.ranks = vocab, ranks
        self.made = {p[0] + p[1]: (rank, p) for p, rank in ranks.items()}
        self.prefixes = {t[:i] for t in vocab for i in range(len(t))}
        self.known: dict[tuple[bytes, bytes], bool] = {}

    @classmethod
    def from_json(cls, path: str) -> tuple[Merges, dict[str, int]]:
        """The model of a tokenizers file, and its special tokens; refuses what the transducer doesn't model."""
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        pre, model = made["pre_tokenizer"] or {}, made["model"]
        if made["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-level BPE can be compiled")
        back = byte_of()
        special = {t["content"]: t["id"] for t in made["added_tokens"]}
        raw = {s: bytes(map(back.__getitem__, s)) for s in model["vocab"] if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return cls({b: model["vocab"][s] for s, b in raw.items()}, {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}), special

    def stays(self, left: bytes, right: bytes) -> bool:
        """Whether left and right, next to each other, are the BPE encoding of their bytes.

        Both tokens are taken apart again at their common edge, the later merge first. They stay if at no time an
        earlier merge could have joined across the edge.
        """
        key = (left, right)
        if (known := self.known.get(key)) is None:
            known = self.known[key] = self._stays(left, right)
        return known

    def _stays(self, left: bytes, right: bytes) -> bool:
        limit = len(self.ranks)  # merges across the edge before this one would have come first
        while True:
            if self.ranks.get((left, right), limit) < limit:
                return False
            when_left, left_parts = self.made.get(left, (-1, None))
            when_right, right_parts = self.made.get(right, (-1, None))
            if when_left > when_right:
                limit, left = when_left, left_parts[1]
            elif right_parts:
                limit, right = when_right + 1, right_parts[0]  # of equal merges the leftmost comes first
            else:
                return True


class Transducer:
    """Character-wise transducer; nodes are made when first reached.

    A node is a dictionary char -> (node, tokens added); what it stands for is in ``what``.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.nodes: dict[tuple, dict] = {}
        self.what: dict[int, tuple] = {}
        self.new_nodes: list[tuple] = []
        self.new_moves: list[tuple[dict, str]] = []
        self.start = self.node(("start",))

    def node(self, what: tuple) -> dict:
        if (made := self.nodes.get(what)) is None:
            made = self.nodes[what] = {}
            self.what[id(made)] = what
            self.new_nodes.append(what)
        return made

    def keep(self) -> None:
        """What the table holds now stays in it."""
        self.new_nodes, self.new_moves = [], []

    def forget(self) -> None:
        """Drops what was added since ``keep``."""
        for node, char in self.new_moves:
            del node[char]
        for what in self.new_nodes:
            del self.what[id(self.nodes.pop(what))]
        self.keep()
        self.m.known.clear()

    # BPE inside one run: the last bytes as far as a token may still begin there, and each such place: (bytes after it,
    # last token before it, token count there less the count now)
    FRESH = (b"", ((0, b"", 0),))

    def feed(self, state: tuple, char: str) -> tuple[tuple, int]:
        """State after one more character of the run, and the tokens that it adds."""
        added = 0
        for b in char.encode("utf-8"):
            state, d = self._byte(state, bytes((b,)))
            added += d
        return state, added

    def _byte(self, state: tuple, byte: bytes) -> tuple[tuple, int]:
        window, marks = state
        window += byte
        for back, last, count in marks:
            token = window[-back - 1 :]
            if token in self.m.vocab and (not last or self.m.stays(last, token)):
                break
        else:
            raise AssertionError("every byte is a token")
        added = count + 1
        places = tuple((n + 1, t, c - added) for n, t, c in marks if window[-n - 1 :] in self.m.prefixes)
        longest = places[0][0] if places else 0
        return (window[len(window) - longest :], (*places, (0, token, 0))), added

    # pre-tokenizer
    def step(self, node: dict, char: str) -> tuple[dict, int]:
        what = self.what[id(node)]
        to, added = self._step(what, char, class_of(char))
        made = node[char] = (self.node(to), added)
        self.new_moves.append((node, char))
        return made

    def _begin(self, char: str, kind: str) -> tuple[tuple, int]:
        """A new pre-token begins with char."""
        if char == " ":
            return ("space",), 1
        run, added = self.feed(self.FRESH, char)
        if char == "'":
            return ("apostrophe", run), added
        if kind == SPACE:
            return ("white", run, 0, char, False), added
        return ("run", kind, run), added

    def _after_space(self, char: str, kind: str) -> tuple[tuple, int]:
        run, added = self.feed(self.feed(self.FRESH, " ")[0], char)
        return ("run", kind, run), added

    def _step(self, what: tuple, char: str, kind: str) -> tuple[tuple, int]:
        mode = what[0]
        if mode == "space":
            if kind != SPACE:
                return self._after_space(char, kind)
            run, added = self.feed(self.feed(self.FRESH, " ")[0], char)
            return ("white", run, -added, char, True), added
        if mode == "run" and what[1] == kind:
            run, added = self.feed(what[2], char)
            return ("run", kind, run), added
        if mode == "white":
            _, run, less, last, several = what  # less: tokens of the run without its last character, less those of the run
            if kind == SPACE:
                run, added = self.feed(run, char)
                return ("white", run, -added, char, True), added
            if several:  # the last white space stands alone or before what follows
                alone = self.feed(self.FRESH, last)[1]
                to, added = self._after_space(char, kind) if last == " " else self._begin(char, kind)
                return to, less + alone + added
        if mode == "apostrophe":
            if char in SHORT:
                return ("start",), self.feed(what[1], char)[1]
            if char in LONG:
                run, added = self.feed(self.FRESH, char)
                return ("contraction", char, run, self.feed(what[1], char)), added
            if kind == OTHER:
                run, added = self.feed(what[1], char)
                return ("run", OTHER, run), added
        if mode == "contraction":
            _, first, run, (whole, added) = what
            if char == LONG[first]:
                single = self.feed(self.FRESH, first)[1]
                return ("start",), added + self.feed(whole, char)[1] - single
            if kind == LETTER:
                run, added = self.feed(run, char)
                return ("run", LETTER, run), added
        return self._begin(char, kind)

    def run(self, node: dict, text: str) -> tuple[dict, int]:
        """The map of ``text`` at one entry."""
        total = 0
        for char in text:
            if (move := node.get(char)) is None:
                move = self.step(node, char)
            node, added = move
            total += added
        return node, total

    def go(self, state: tuple, text: str) -> tuple[tuple, int]:
        """The same between states, for texts of any length: what they add to the table is dropped on the way when it is too much."""
        total = 0
        for i in range(0, len(text), GO_CHARS):
            node, added = self.run(self.node(state), text[i : i + GO_CHARS])
            state = self.what[id(node)]
            total += added
            if len(self.new_moves) > TABLE_TRANSITIONS:
                self.forget()
        return state, total


class PieceMap:
    """Map of a piece of a document: entry state -> (exit state, tokens added).

    head: characters before the first synchronising place; body and exit: what follows adds, and the state in which it ends. Without
    such a place, head is the whole piece and exit None.
    """

    __slots__ = ("body", "exit", "head", "t")

    def __init__(self, t: Transducer, head: str, body: int = 0, exit: tuple | None = None):
        self.t, self.head, self.body, self.exit = t, head, body, exit

    def __call__(self, entry: tuple) -> tuple[tuple, int]:
        left, added = self.t.go(entry, self.head)
        return (left, added) if self.exit is None else (self.exit, added + self.body)

    def then(self, other: PieceMap) -> PieceMap:
        """The map of both pieces; associative."""
        if self.exit is None:
            return PieceMap(self.t, self.head + other.head, other.body, other.exit)
        left, added = other(self.exit)
        return PieceMap(self.t, self.head, self.body + added, left)


def glued(maps: list[PieceMap]) -> list[PieceMap]:
    """Each piece without a synchronising place as part of the next one's head, put together once; only the last may be left without."""
    out, heads = [], []
    for m in maps:
        heads.append(m.head)
        if m.exit is not None:
            out.append(PieceMap(m.t, "".join(heads), m.body, m.exit))
            heads = []
    return [*out, PieceMap(maps[0].t, "".join(heads))] if heads else out


def prefix_scan(maps: list, then: Callable) -> list:
    """Inclusive scan of an associative composition, by pairs: half the length each round."""
    if len(maps) < 2:
        return list(maps)
    pairs = prefix_scan([then(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)], then)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else then(pairs[i // 2 - 1], maps[i]))
    return out


class Counter:
    """Counts tokens in one Python worker."""

    def __init__(self, path: str):
        merges, special = Merges.from_json(path)
        self.t = Transducer(merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = ChunkCache(lambda chunks: [self.t.run(self.t.start, c)[1] for c in chunks])
        self.compile()

    def compile(self) -> None:
        """Fills the transducer's table along the vocabulary."""
        for token in self.t.m.vocab:
            text = token.decode("utf-8", "ignore")
            self.t.run(self.t.start, text)
            self.t.run(self.t.start, f" {text.lstrip()}")
        self.t.keep()

    def piece(self, text: str) -> PieceMap:
        """The map of a piece, its body by the memoised maps of words; without white space, from its first change of class on."""
        chunks, start = CHUNK.findall(text), ("start",)
        if len(chunks) < 2:
            change = CHANGE.search(text, 1)
            return PieceMap(self.t, text) if change is None else PieceMap(self.t, text[: change.start()], *reversed(self.t.go(start, text[change.start() :])))
        middle, last = chunks[1:-1], chunks[-1]
        left, added = self.t.go(start, last)
        return PieceMap(self.t, chunks[0], sum(self.words.values(middle)) + added, left)

    def running(self, text: str) -> list[int]:
        """Tokens of a text without special strings up to the end of each piece with a synchronising place, and of the text; later characters may still
        join the last ones. No head is read more than some log2(pieces) times, so time grows with the text whatever it holds."""
        maps = prefix_scan(glued([self.piece(text[i : i + PIECE_CHARS]) for i in range(0, len(text), PIECE_CHARS)]), PieceMap.then)
        _, head = self.t.go(("start",), maps[0].head)  # the head of all prefixes
        self.words.settle()
        return [head + m.body for m in maps]

    def segment(self, text: str) -> int:
        return self.running(text)[-1] if text else 0

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@functools.cache
def counter_at(path: str) -> Counter:
    """A worker's counter: compiled once, it lives as long as the worker."""
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``n_bytes`` (UTF-8) and ``n_tokens`` of every whole text."""
    small_batches(df.sparkSession)
    df = df.select(*keep, F.col(text).alias("_text_"))
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def make():
        counter = counter_at(path)

        def step(batch):
            sizes, counts = [], []
            for value in batch.column("_text_"):
                text = value.as_py() or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [*keep, "n_bytes", "n_tokens"]
            )

        return step

    return by_batch(df, make, f"{head}n_bytes bigint, n_tokens bigint")


def op7_token_counts(documents: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every document."""
    return count_tokens(documents, path).withColumn("over_limit", F.col("n_tokens") > limit)
