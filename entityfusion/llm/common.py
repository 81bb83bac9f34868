"""What the training-data operators share: table access, scratch tables, Arrow helpers, word chunks.

Scratch tables (written tables in the shared folder) are the way lineage is cut here, so that a lost executor costs a re-read and
never a recomputation of the Python work before it.
"""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import Tables as Scratch
from ..plans.tables import few

#: The code points of Unicode's White_Space property, as a regular-expression class body.
WHITE_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with the run of other characters after it. Byte-level pre-tokenizers always cut
#: between a non-space and a space, so such chunks can be encoded one by one.
CHUNK = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")
#: Runs without white space.
WORD = re.compile(f"[^{WHITE_SPACE}]+")
#: Separators that str.split() knows and the White_Space property does not.
ODD_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Entries that a chunk cache may hold before it starts anew, and the longest chunk it keeps.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


#: Rows of a table of values by key up to which it is broadcast whole, and the most hot keys that are broadcast beyond that.
SMALL, HOT = 1_000_000, 20_000


def look_up_by_key(rows: DataFrame, values: DataFrame, key: str, uses: str, total: int) -> DataFrame:
    """rows left-joined with values by ``key``, whatever key is hot. values: a written table with each key once; its column ``uses``
    says how many of the ``total`` rows have the key.

    A small table is broadcast. Otherwise keys of more than total / HOT rows are (fewer than HOT, since uses add up to total), and the others
    meet by shuffle, where none has more than that share of the rows."""
    if few(values, SMALL):
        return rows.join(F.broadcast(values), key, "left")
    hot = F.col(uses) > total // HOT
    found = rows.join(F.broadcast(values.filter(hot).select(key)), key, "left_anti").join(values.filter(~hot), key, "left")
    return rows.join(F.broadcast(values.filter(hot)), key).unionByName(found)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark's own reader whatever the store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds the Arrow batches that go to Python workers by rows and by bytes, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Freed memory goes back to the system: Arrow's pool and the C library keep it, also for the stages after this one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with a function that is made once per task: ``make()`` loads models, its result maps a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
        # models and caches refer to each other in circles; a worker lives on and must not keep them
        del step
        gc.collect()
        give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    """The texts of a column one by one, null as the empty text; only one is a Python string at a time."""
    for value in batch.column(column):
        yield value.as_py() or ""


def words_by_white_space(text: str) -> list[str]:
    """Maximal runs without Unicode white space."""
    return WORD.findall(text) if ODD_SEPARATORS.search(text) else text.split()


#: What no chunk has as its value.
ABSENT = object()


class ChunkCache:
    """Chunk -> whatever ``fill`` computes for a list of unseen chunks.

    Natural text repeats its words, so most chunks cost one dictionary look-up. The size is bounded: two generations
    of at most ``entries`` (CACHE_ENTRIES if not given) short chunks; chunks met again move from the older to the newer one, and when the newer
    one is full it becomes the older. Long chunks are dropped after the document.
    """

    def __init__(self, fill: Callable[[list[str]], Iterable], entries: int | None = None):
        self.fill, self.entries, self.now, self.old, self.long = fill, entries, {}, {}, []

    def values(self, chunks: list[str]) -> Iterator:
        """The values of the chunks, in order."""
        now, distinct, unseen = self.now, set(chunks), []
        # a document's chunks meet again in a table of its own, which is small
        mine = dict(zip(distinct, map(now.get, distinct, repeat(ABSENT)), strict=True))
        for c in [c for c, v in mine.items() if v is ABSENT]:
            if (known := self.old.get(c, ABSENT)) is ABSENT:
                unseen.append(c)
            else:
                now[c] = mine[c] = known
        if unseen:
            self.long += [c for c in unseen if len(c) > CACHE_CHARS]
            new = dict(zip(unseen, self.fill(unseen), strict=True))
            now.update(new)
            mine.update(new)
        return map(mine.__getitem__, chunks)

    def settle(self) -> None:
        """Call between documents."""
        for c in self.long:
            self.now.pop(c, None)
        self.long = []
        if len(self.now) > (self.entries or CACHE_ENTRIES):
            self.old, self.now = self.now, {}
