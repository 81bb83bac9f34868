"""Exact dedup against a history, by a minimal perfect hash over the history's distinct digests.

The history's digests are dealt by their first bits over shards of some SHARD_KEYS keys each, so no shard is hot whatever
texts repeat. Within a shard a minimal perfect hash sends each of its n digests to one of n slots: level after level, keys that are alone
at their place of a bit field stay there, the others go on to the next, smaller field; the slot is the number of set bits before
the key's place. A slot holds the full digest, the locator of the text that stays (its doc_id) and the number of rows. The index is a table with a
row a shard, written once; later intakes are looked up in it.

A looked-up digest lands in some slot whether or not it was ever indexed, so all its bytes are compared with the slot's. Equal: a repeat, its
rows go to that slot. Otherwise it is new, and new digests are groups of their own.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of equal texts the row with the largest doc_id
stays; a null doc_id is less than any other, and where all are null keep_id is null and each such row stays. Repeated rows (same doc_id, same
text) are one document: ``kept`` is the same for both. An empty history makes everything new; an empty intake leaves
the history's groups. Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, look_up_by_key

#: Distinct digests a shard, on average; a shard's row takes some 50 bytes each.
SHARD_KEYS = 100_000
#: Places of a level's bit field for each key that is left.
ROOM = 2
SHARD = "shard int, levels array<bigint>, bits array<binary>, digests binary, keep_ids array<bigint>, sizes array<bigint>"
FOUND = "digest binary, keep_id bigint, group_size bigint, repeat boolean"

INDEX = pa.schema([("shard", pa.int32()), ("levels", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary())), ("digests", pa.binary()), ("keep_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
GROUPS = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("repeat", pa.bool_())])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = f"""
with t as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256 from documents),
g as (select *, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size from t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g
"""


def words_of(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as rows of four unsigned numbers."""
    return np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), 4)


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest falls in a level's bit field."""
    x = words[:, level % 4] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64) ^ (words[:, (level + 1) % 4] >> np.uint64(7))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct digests: sizes and bits of its levels, and each level's first slot."""

    def __init__(self, sizes: list[int], bits: list[bytes]):
        self.sizes, self.fields, self.before, first = sizes, [], [], 0
        for size, raw in zip(sizes, bits, strict=True):
            field = np.unpackbits(np.frombuffer(raw, np.uint8), count=size)
            self.fields.append(field)
            self.before.append(first + np.cumsum(field, dtype=np.int64) - field)
            first += int(field.sum())

    @staticmethod
    def build(words: np.ndarray) -> tuple[list[int], list[bytes]]:
        sizes, bits, left = [], [], words
        while len(left):
            size = ROOM * len(left) + 7
            at = places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone).tobytes())
            left = left[~alone[at]]
        return sizes, bits

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where no level has a set bit for it (then it was never indexed)."""
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (size, field, before) in enumerate(zip(self.sizes, self.fields, self.before, strict=True)):
            at = places(words[open_], level, size)
            here = field[at] == 1
            out[open_[here]] = before[at[here]]
            open_ = open_[~here]
        return out


def digests_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the digest of each normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256)).alias("digest"))


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """shard, digest, keep_id, group_size: combined before the shuffle, so that a hot text is a row a task."""
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.withColumn("shard", F.expr(f"cast(cast(conv(hex(substring(digest, 1, 6)), 16, 10) as bigint) % {shards} as int)"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The index over the digests of rows (doc_id, digest): a row a shard."""

    def shard(table: pa.Table) -> pa.Table:
        digests = table["digest"].to_pylist()
        words = words_of(digests)
        sizes, bits = PerfectHash.build(words)
        order = np.argsort(PerfectHash(sizes, bits).slots(words)).tolist()
        ordered = lambda c: table[c].take(pa.array(order)).to_pylist()
        row = {"shard": table["shard"][0].as_py(), "levels": sizes, "bits": bits, "digests": b"".join(ordered("digest")), "keep_ids": ordered("keep_id"), "sizes": ordered("group_size")}
        return pa.Table.from_pylist([row], INDEX)

    return _grouped(rows, shards).groupBy("shard").applyInArrow(shard, SHARD)


def look_up(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """digest, keep_id, group_size, repeat of all texts of the history and of rows (doc_id, digest) together.

    ``repeat`` says that rows had a text of the history: true for slots met again, false for texts that are new, null for slots that
    no row asked for. ``shards`` is the index's; a task holds a shard of it and the distinct digests of rows that fall there."""

    def shard(new: pa.Table, known: pa.Table) -> pa.Table:
        digests, ids, sizes = (new[c].to_pylist() for c in ("digest", "keep_id", "group_size"))
        old, keep, count = [], [], []
        at = np.full(len(digests), -1, np.int64)
        if known.num_rows:
            (row,) = known.to_pylist()
            raw, keep, count = row["digests"], row["keep_ids"], row["sizes"]
            old = [raw[i : i + 32] for i in range(0, len(raw), 32)]
            at = PerfectHash(row["levels"], row["bits"]).slots(words_of(digests))
        met: list = [None] * len(old)
        fresh = []
        for i, (slot, digest) in enumerate(zip(at.tolist(), digests, strict=True)):
            if slot >= 0 and old[slot] == digest:  # every byte; any digest falls into some slot
                met[slot] = True
                count[slot] += sizes[i]
                keep[slot] = max((x for x in (keep[slot], ids[i]) if x is not None), default=None)
            else:
                fresh.append(i)
        return pa.Table.from_arrays(
            [
                pa.array(old + [digests[i] for i in fresh], pa.binary()), pa.array(keep + [ids[i] for i in fresh], pa.int64()),
                pa.array(count + [sizes[i] for i in fresh], pa.int64()), pa.array(met + [False] * len(fresh), pa.bool_()),
            ],
            schema=GROUPS,
        )

    return _grouped(rows, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(shard, FOUND)


def dedup(history: DataFrame, intake: DataFrame, scratch: Scratch, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every document of both."""
    old, new = (scratch.table(digests_of(docs), name) for docs, name in ((history, "history"), (intake, "intake")))
    rows = old.unionByName(new)
    shards = 1 + rows.agg(F.approx_count_distinct("digest")).first()[0] // shard_keys
    index = scratch.table(build_index(old, shards), "index")
    groups = scratch.table(look_up(index, new, shards), "groups")
    found = look_up_by_key(rows, groups.drop("repeat"), "digest", "group_size", rows.count())
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op13_exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document. The lower half of the range of ids is the history that is indexed,
    the upper half the intake that is looked up."""
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    middle = 0 if low is None else (low + high) // 2
    past = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    docs = documents.select("doc_id", "text")
    found = dedup(docs.filter(past), docs.filter(~past), Scratch(documents.sparkSession, "op13"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
