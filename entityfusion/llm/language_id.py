"""Language identification by words first, and character n-grams for unseen words.

A word that the model knows scores its log frequency in each language. An unseen word falls back to character n-grams
of the word between two edge marks: at each place the longest known n-gram, from LONGEST characters down to one, scores
its log frequency in each language, divided by its length so that overlapping n-grams don't count a character twice.
What no n-gram covers says nothing. The scores of all words of the whole text are added; ``score`` is the share of the
best language after the evidence is scaled to that of EVIDENCE words at most, so long texts are not all certain.

The model learns from a sample of labelled texts, bounded by ``per_lang`` texts of each language (chosen by a hash of the text; the bound holds in
the mean; copies of a text count once), and keeps at most ``words`` words and ``grams`` n-grams of each language, the most
frequent ones, and ENTRIES of either kind over all languages, in equal parts. It is sparse: a unit has entries for the languages in which it
was met; what it says of all others is one number a language (and length of n-grams). So its size, which goes to every worker, is
bounded whatever the number of languages.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is any text where nothing was
learned; ties go to the language first in order; repeated rows give repeated results. Documents without id are neither
learned from nor held out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import few
from .common import ChunkCache, Scratch, by_batch, small_batches

LONGEST, EVIDENCE, FOLDS = 5, 20, 5
#: (language, unit) pairs of either kind that a model keeps at most (some 40 bytes each), and languages up to which their sizes are broadcast.
ENTRIES, LANGUAGES = 2_000_000, 10_000
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
SMOOTHING = 0.5


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams_of(word: str) -> list[list[str]]:
    """At each place of the word between edge marks, the n-grams that begin there, longest first."""
    marked = f"_{word}_"
    return [[marked[i : i + n] for n in range(min(LONGEST, len(marked) - i), 0, -1)] for i in range(len(marked) - 1)]


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def sample(labelled: DataFrame, per_lang: int, scratch: Scratch) -> DataFrame:
    """lang, text of about ``per_lang`` texts of each language, all if there are fewer; the same ones each time, copies once."""
    sizes = scratch.table(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    grain = 1 << 20
    sized = labelled.withColumn("hash", F.xxhash64("text")).join(F.broadcast(sizes) if few(sizes, LANGUAGES) else sizes, "lang")
    return sized.filter(F.pmod("hash", F.lit(grain)) < F.ceil(F.lit(grain * per_lang) / F.col("n"))).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")


def _counted(df: DataFrame, column: str, make_counts) -> DataFrame:
    """lang, unit, n: what ``make_counts(batch)`` counts, combined in each batch, then over all."""

    def make():
        def step(batch):
            found = make_counts(batch)
            langs, units, counts = zip(*((k[0], k[1], n) for k, n in found.items()), strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(units, pa.string()), pa.array(counts, pa.int64())], ["lang", column, "n"])

        return step

    return by_batch(df, make, f"lang string, {column} string, n bigint").groupBy("lang", column).agg(F.sum("n").alias("n"))


def _count_words(batch: pa.RecordBatch) -> Counter:
    found: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        for word, n in Counter(words_of(text.as_py() or "")).items():
            found[lang, word] += n
    return found


def _count_grams(batch: pa.RecordBatch) -> Counter:
    found: Counter = Counter()
    for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        for place in grams_of(word):
            for gram in place:
                found[lang, gram] += n
    return found


#: An entry of a unit: a place in the vector of sums (a language, or what a default counts for) and what it adds there.
ENTRY = np.dtype([("at", "<i4"), ("add", "<f8")])


def _table(rows: list[tuple[str, int, int]], langs: int, by_size: bool) -> tuple[str, np.ndarray, bytes, np.ndarray]:
    """Units, a line each, how many ENTRYs each has for languages, these beyond the defaults, and the defaults (size x language), from (unit, language,
    count). Some megabytes: workers keep what is broadcast, and make dictionaries of it for a task only."""
    size_of = len if by_size else (lambda unit: 0)
    total, units = np.zeros((LONGEST + 1, langs)), Counter(size_of(u) for u in {u for u, *_ in rows})
    for unit, lang, n in rows:
        total[size_of(unit), lang] += n
    below = np.log(np.maximum(total + SMOOTHING * np.array([[units[i]] for i in range(LONGEST + 1)]), SMOOTHING))
    default, held = np.log(SMOOTHING) - below, {}
    for unit, lang, n in rows:
        held.setdefault(unit, []).append((lang, (np.log(n + SMOOTHING) - below[size_of(unit), lang] - default[size_of(unit), lang]) / max(1, size_of(unit))))
    entries = [x for e in held.values() for x in e]
    return "\n".join(held), np.array([len(e) for e in held.values()], np.int32), np.array(entries, ENTRY).tobytes(), default


def _entries(units: str, sizes: np.ndarray, entries: bytes) -> dict[str, bytes]:
    """unit -> its ENTRYs."""
    ends = (np.cumsum(sizes) * ENTRY.itemsize).tolist()
    return {u: entries[a:b] for u, a, b in zip(units.split("\n"), [0, *ends], ends, strict=False)}


def train(labelled: DataFrame, scratch: Scratch, per_lang: int = 4000, words: int = 30_000, grams: int = 30_000) -> dict:
    """The model: languages in order, and for words and n-grams their entries and defaults.

    labelled: doc_id, lang, text, without null languages."""
    small_batches(labelled.sparkSession)
    counted = scratch.table(_counted(sample(labelled, per_lang, scratch), "word", _count_words), "words")
    parts = _counted(counted, "gram", _count_grams).withColumnRenamed("gram", "word")
    n_langs = counted.select("lang").distinct().count()
    tops = []
    for table, most in ((counted, words), (parts, grams)):
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
        top = table.withColumn("rank", rank).filter(F.col("rank") <= max(1, min(most, ENTRIES // max(1, n_langs)))).select("lang", "word", "n").toArrow()  # bounded: see above
        tops.append(sorted(zip(*(top.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True)))
    out: dict = {"langs": sorted({lang for _, lang, _ in tops[0]})}
    at = {lang: i for i, lang in enumerate(out["langs"])}
    for kind, rows in zip(("words", "grams"), tops, strict=True):
        out[kind] = _table([(unit, at[lang], n) for unit, lang, n in rows], len(at), kind == "grams")
    return out


class Predictor:
    """Applies a model in one Python worker."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        (*words, default), (*grams, defaults) = model["words"], model["grams"]
        self.words, self.grams = _entries(*words), _entries(*grams)
        #: what the places beyond the languages count: known words, then n-grams by length, each divided by it
        self.defaults = np.vstack([default[:1], defaults[1:] / np.arange(1, LONGEST + 1)[:, None]])
        ones = np.zeros(LONGEST + 1, ENTRY)
        ones["at"], ones["add"] = len(self.langs) + np.arange(LONGEST + 1), 1.0
        self.one = [ones[i : i + 1].tobytes() for i in range(LONGEST + 1)]
        self.cache = ChunkCache(lambda words: [self.word(w) for w in words])

    def word(self, word: str) -> bytes:
        """The entries of one word."""
        if (known := self.words.get(word)) is not None:
            return known + self.one[0]
        out = []
        for place in grams_of(word):
            for gram in place:
                if (known := self.grams.get(gram)) is not None:
                    out += [known, self.one[len(gram)]]
                    break
        entries = np.frombuffer(b"".join(out), ENTRY)
        at, same = np.unique(entries["at"], return_inverse=True)
        made = np.zeros(len(at), ENTRY)
        made["at"], made["add"] = at, np.bincount(same, entries["add"], len(at)) if len(at) else 0
        return made.tobytes()

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log likelihood of the words in each language."""
        entries = np.frombuffer(b"".join(self.cache.values(words)), ENTRY)
        sums = np.bincount(entries["at"], entries["add"], len(self.langs) + LONGEST + 1)
        self.cache.settle()
        return sums[: len(self.langs)] + sums[len(self.langs) :] @ self.defaults

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text or "")
        if not words or not self.langs:
            return "und", 0.0
        evidence = self.evidence(words)
        evidence = (evidence - evidence.max()) * min(1.0, EVIDENCE / len(words))
        best = int(evidence.argmax())
        return self.langs[best], float(1 / np.exp(evidence).sum())


def identify(df: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with ``lang_pred`` and ``score``."""
    spark = df.sparkSession
    small_batches(spark)
    whole = text if text in keep else "_text_"
    df = df.select(*keep, *([] if text in keep else [F.col(text).alias(whole)]))
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    sent = spark.sparkContext.broadcast(model)

    def make():
        predictor = Predictor(sent.value)

        def step(batch):
            found = [predictor.predict(v.as_py()) for v in batch.column(whole)]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], [*keep, "lang_pred", "score"])

        return step

    return by_batch(df, make, f"{head}lang_pred string, score double")


def in_a_language(docs: DataFrame, scratch: Scratch, least: float = 0.3) -> DataFrame:
    """docs whose language is recognised with a score of ``least``; all columns stay as they are. Where nothing was learned, no
    text can be told from another and only those without a letter go."""
    known = docs.filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    model = train(known.select("doc_id", "lang", "text"), scratch)
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # columns of the input may have the names of the prediction's
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    found = identify(inner, model, text=f"c{docs.columns.index('text')}", keep=tuple(inner.columns))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*inner.columns).toDF(*docs.columns)


def op8_language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those not held out."""
    labelled = documents.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
    model = train(labelled, Scratch(documents.sparkSession, "language"))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
