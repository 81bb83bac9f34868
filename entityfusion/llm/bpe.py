"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches.

A rank file (token bytes in base64, rank) is turned into a tokenizers model: each byte stands for one printable
character (the byte table), the merges are derived from the ranks, and the pattern splits texts before merging.
Encoding runs over Arrow batches; texts are cut where every byte-level pattern cuts them (before a run of white
space), so equal chunks are encoded once per worker. Decoding looks tokens up, reverses the byte table and joins
the bytes; a character whose bytes are split over several tokens is put together only then.

Defined results: null and empty texts give no ids; decoding no ids gives no bytes; repeated rows give repeated
results; other columns of the input are kept, except that ``ids``, ``n_tokens``, ``starts``, ``ends``, ``decoded``
of the input give way to those made here.
"""

from __future__ import annotations

import base64
import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK, WHITE_SPACE, ChunkCache, by_batch, small_batches, texts_of

#: Chunks that begin with white space and don't end in it.
EDGES = re.compile(f"[{WHITE_SPACE}].*[^{WHITE_SPACE}]", re.DOTALL)


@functools.cache
def byte_table() -> tuple[str, ...]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, the others for
    the code points from 256 on, in order of the byte."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return tuple(chr(b) if b in plain else chr(next(spare)) for b in range(256))


@functools.cache
def byte_of() -> dict[str, int]:
    """The byte table reversed."""
    return {c: b for b, c in enumerate(byte_table())}


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def split_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that BPE merges last to make ``token``; None for a single byte or an unreachable token."""
    limit, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= limit:
            return None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.cache
def tokenizer_from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges as the rank file says; ids are the ranks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_table()
    shown = lambda token: "".join(table[b] for b in token)
    merges = [(shown(p[0]), shown(p[1])) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (p := split_of(t, ranks))]
    made = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


@functools.cache
def token_bytes(path: str, pattern: str) -> list[bytes]:
    """Bytes of each id, from the tokenizer's own strings through the reversed byte table."""
    made, back = tokenizer_from_ranks(path, pattern), byte_of()
    size = 1 + max(made.get_vocab().values())
    shown = (made.id_to_token(i) for i in range(size))
    return [b"" if s is None else bytes(back[c] for c in s) for s in shown]


class Codec:
    """Encodes and decodes in one Python worker."""

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.bytes_of = tokenizer_from_ranks(path, pattern), token_bytes(path, pattern)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.cache = ChunkCache(self._encode_chunks)

    def _encode_chunks(self, chunks: list[str]):
        """Chunks that begin with white space and end otherwise can stand next to each other: they are encoded in
        one call, and the ids are dealt out by the tokens' bytes."""
        encode = lambda text: np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        row = [i for i, c in enumerate(chunks) if EDGES.fullmatch(c)]
        ids = encode("".join(chunks[i] for i in row))
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(chunks[i].encode("utf-8")) for i in row]), "left") + 1
        raw, out, at = ids.tobytes(), [None] * len(chunks), 0
        for i, end in zip(row, ends.tolist(), strict=True):
            out[i], at = raw[4 * at : 4 * end], end
        for i, made in enumerate(out):
            if made is None:
                out[i] = encode(chunks[i]).tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = b"".join(self.cache.values(CHUNK.findall(text)))
        self.cache.settle()
        return out

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points at which each token starts and ends; a token with a part of a character covers it whole."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char_at = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
        ends = np.cumsum(self.lengths[ids])
        return char_at[ends - self.lengths[ids]] - 1, char_at[ends - 1]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _without(df: DataFrame, *names: str) -> tuple[DataFrame, str]:
    """df without the named columns, and the DDL of what is left."""
    df = df.drop(*names)
    return df, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False, keep_text: bool = True) -> DataFrame:
    """Adds ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens``; with ``offsets`` also ``starts`` and
    ``ends``, each token's code points in the text."""
    small_batches(df.sparkSession)
    df, head = _without(df, "ids", "n_tokens", "starts", "ends")
    keep = [c for c in df.columns if keep_text or c != text]
    kept = T.StructType([df.schema[c] for c in keep])
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)

    def make():
        codec = Codec(path, pattern)

        def step(batch):
            ids, starts, ends = [], [], []
            for t in texts_of(batch, text):
                ids.append(made := codec.encode(t))
                if offsets:
                    a, b = codec.offsets(t, np.frombuffer(made, "<u4"))
                    starts.append(a)
                    ends.append(b)
            more = [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
            more += [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)] * offsets
            names = [*keep, "ids", "n_tokens", *["starts", "ends"] * offsets]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names)

        return step

    return by_batch(df, make, f"{head}ids binary, n_tokens bigint" + ", starts array<bigint>, ends array<bigint>" * offsets)


def decode_documents(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded`` (binary) made from ``ids``; null ids give no bytes. ``decode(decoded, 'UTF-8')`` is the text."""
    small_batches(df.sparkSession)
    df, head = _without(df, "decoded")
    names = df.columns

    def make():
        codec = Codec(path, pattern)

        def step(batch):
            out = pa.array([codec.decode(v.as_py() or b"") for v in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*names, "decoded"])

        return step

    return by_batch(df, make, f"{head}decoded binary")


def op4_byte_bpe(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, through encoding and decoding."""
    encoded = encode_documents(documents.select("doc_id", "text"), path, pattern, keep_text=False)
    decoded = decode_documents(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
