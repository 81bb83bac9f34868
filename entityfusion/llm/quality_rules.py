"""Quality rules with risk-controlled thresholds, as DataFrame functions only.

Base rules reject texts of few words or of many repeated five-word windows. The method's rules compare four signals
(symbols per word, share of repeated lines, mean word length, share of words in repeated windows) with cutoffs that are
chosen per stratum from labelled documents: of a fixed grid, the lowest cutoff whose upper confidence bound on the
share of good documents that it rejects stays within ``risk``. The bound is exact (Clopper and Pearson): a cutoff with
k of n good documents above it passes if P(Binomial(n, risk) <= k) is at most the error that it is given. The errors of
all strata, signals and cutoffs add up to ``error`` (Bonferroni), so with probability 1 - ``error`` every cutoff in use
keeps its promise. A signal whose cutoffs all fail in a stratum rejects nothing there. A stratum's rules together
reject at most ``risk`` of its good documents, as each signal gets an equal part of it.

Everything stays in the JVM: words, windows and lines are arrays of one document, so no text is shuffled; only the
signals, some hundred bytes a document, are written once and read for the cutoffs and for the verdicts. A text counts as one
trial in its stratum, however many copies it has.

Defined results: a null text has no words and fails the base; empty texts too. A document without label takes no part in
choosing cutoffs; contradictory labels count as not good. Null strata are a stratum of their own. Without labels no
cutoff passes, so only the base rejects. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read_table

#: The separators of words, and the symbols that are counted.
SEPARATORS, NOT_SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
WINDOW = 5
#: Cutoffs tried for each signal, from strict to lenient; a document is rejected above its signal's cutoff.
GRID = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0),
    "dup_lines": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6),
    "word_length": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "repeats": (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18),
}

#: Strata up to which their rules are broadcast, below 300 bytes each; beyond, they are joined by shuffle.
STRATA = 20_000


def _once(value: Column, use) -> Column:
    """use(value) with value computed once, though use may refer to it within a lambda."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of WINDOW words found twice or more in the array.

    Windows are compared by 64-bit hashes. Sorting (hash, place) brings equal windows together; the places of the
    repeated ones, sorted again, cover min(WINDOW, gap to the next place) words each.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    paired = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)), lambda x: x["i"])
    )
    covered = lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    found = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_once(paired(h), lambda s: _once(twice(s), covered)))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_once(words, lambda w: _once(hashes(w), found)))


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_words", F.array_remove(F.split(whole, SEPARATORS, -1), "")).withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.drop("_words", "_lines").withColumn("base_failed", failed)


def signals() -> dict[str, Column]:
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "word_length": ratio("word_chars", "n_words"),
        "repeats": ratio("n_repeat_words", "n_words"),
    }


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 9, then down by the product of the eight factors between."""
    x = n + F.lit(9.0)
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    product = F.lit(1.0)
    for i in range(1, 9):
        product = product * (n + i)
    return series - F.log(product)


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) <= k) for k below n*p: the largest term, times the sum of ratios of the terms below it.

    The ratios fall geometrically, so some dozen standard deviations of terms are all that a double can hold."""
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p))
    steps = F.least(k, 12 * F.sqrt(n * p * (1 - p)) + 100).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(a: Column, i: Column) -> Column:
        j = k - i + 1  # from the term of j to that of j - 1
        term = a["term"] * j * (1 - p) / ((n - j + 1) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(steps >= 1, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), top * F.aggregate(terms, start, down, lambda a: a["sum"]))


def safe_cutoffs(labelled: DataFrame, scratch: Scratch, risk: float, error: float, grid: dict = GRID) -> DataFrame:
    """stratum, signal, cutoff, k, n: the lowest cutoff of each signal that passes its test in each stratum.

    labelled: stratum, good, and a column for each signal. One pass counts, for each stratum, how many good documents
    lie above each of the grid's cutoffs; the counts combine before the shuffle."""
    names = [(s, c, f"{s}_{i}") for s, cutoffs in grid.items() for i, c in enumerate(cutoffs)]
    counts = labelled.filter("good").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(s) > c).alias(a) for s, c, a in names))
    counts = scratch.table(counts, "good-counts")
    share = error / (len(names) * max(1, counts.count()))
    part = F.lit(risk / len(grid))
    each = F.inline(F.array(*(F.struct(F.lit(s).alias("signal"), F.lit(float(c)).alias("cutoff"), F.col(a).alias("k")) for s, c, a in names)))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    passes = (k < n * part) & (binomial_cdf(k, n, part) <= share)
    best = counts.select("stratum", "n", each).filter(passes).groupBy("stratum", "signal").agg(F.min_by(F.struct("cutoff", "k", "n"), "cutoff").alias("best"))
    return best.select("stratum", "signal", "best.*")


def rules_of(counted: DataFrame, labels: DataFrame, scratch: Scratch, risk: float, error: float) -> DataFrame:
    """rule_stratum, rules (map from signal to cutoff), one row a stratum. counted: doc_id, stratum, text_hash and the counts."""
    good = labels.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    told = counted.filter("not base_failed").select("doc_id", "stratum", "text_hash", *(c.alias(n) for n, c in signals().items())).join(good, "doc_id")
    # trials are independent only if a text counts once, however many rows and ids it has
    trials = told.groupBy("stratum", "text_hash").agg(F.min("good").alias("good"), *(F.first(n).alias(n) for n in signals()))
    cutoffs = safe_cutoffs(trials, scratch, risk, error)
    rules = cutoffs.groupBy(F.col("stratum").alias("rule_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("rules"))
    rules = scratch.table(rules, "rules")
    return F.broadcast(rules) if rules.limit(STRATA + 1).count() <= STRATA else rules


def judged(counted: DataFrame, rules: DataFrame) -> DataFrame:
    """counted with ``rejected_by`` (signals above their cutoff) and ``kept``."""
    found = counted.join(rules, F.col("stratum").eqNullSafe(F.col("rule_stratum")), "left")
    above = F.array_compact(F.array(*(F.when(c > F.col("rules")[n], n) for n, c in signals().items())))
    found = found.withColumn("rejected_by", F.when(F.col("rules").isNull(), F.array().cast("array<string>")).otherwise(above))
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("rules", "rule_stratum")


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, risk: float = 0.04, error: float = 0.05) -> DataFrame:
    """doc_id with the base counts, ``base_failed``, ``rejected_by`` and ``kept``.

    docs: doc_id, text, lang. labels: doc_id, quality. The stratum is the language given with the document; a stratum
    of few labels gets no cutoff, since no small sample can pass the test."""
    counted = base_counts(docs.select("doc_id", F.col("lang").alias("stratum"), "text", F.xxhash64("text").alias("text_hash"))).drop("text")
    counted = scratch.table(counted, "signals")
    out = judged(counted, rules_of(counted, labels, scratch, risk, error))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")


def passing(docs: DataFrame, labels: DataFrame, scratch: Scratch, risk: float = 0.04, error: float = 0.05) -> DataFrame:
    """docs that the rules keep, with their columns. The counts are made twice, for the cutoffs and for the verdicts, so that no
    text is shuffled, joined or written on the way."""
    # columns of the input may have any name
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    doc_id, lang, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "lang", "text"))
    named = inner.withColumns({"doc_id": F.col(doc_id), "stratum": F.col(lang), "text_hash": F.xxhash64(text)})
    counted = scratch.table(base_counts(named.select("doc_id", "stratum", "text_hash", text), text).drop(text), "signals")
    return judged(base_counts(named, text), rules_of(counted, labels, scratch, risk, error)).filter("kept").select(*inner.columns).toDF(*docs.columns)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs, read_table(spark, sf_dir, "labels"), Scratch(spark, "quality")).drop("rejected_by")


def oracle_sql(risk: float = 0.04, error: float = 0.05, grid: dict = GRID) -> str:
    """op6_quality_rules as DuckDB SQL; the binomial sums are taken term by term."""
    signals = {"symbols": "n_symbols / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "word_length": "word_chars / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)"}
    tests = ", ".join(f"('{s}', {float(c)}::double)" for s, cutoffs in grid.items() for c in cutoffs)
    part, size = risk / len(grid), sum(map(len, grid.values()))
    words = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
with split as (
  select doc_id, lang, text, {words} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) as n_symbols from documents),
windows as (select doc_id, i, w[i:i + {WINDOW - 1}] as win from split, unnest(range(1, len(w) - {WINDOW - 2})) as u(i)),
twice as (select doc_id, win from windows group by all having count(*) > 1),
repeated as (select doc_id, count(distinct i + k) as n from windows join twice using (doc_id, win), range({WINDOW}) as r(k) group by doc_id),
counted as (
  select s.doc_id, lang, text, len(w)::bigint as n_words, length(list_aggregate(w, 'string_agg', ''))::bigint as chars, n_symbols::bigint as n_symbols, len(l) as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words from split s left join repeated r using (doc_id)),
judged as (select * exclude (chars), coalesce(chars, 0)::bigint as word_chars, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from counted),
signals as (select doc_id, lang, text, base_failed, unnest([{", ".join(f"struct_pack(signal := '{s}', value := ({e})::double)" for s, e in signals.items())}], recursive := true) from judged),
told as (select doc_id, min(quality) = 1 as good from labels group by doc_id),
trials as (select lang, text, signal, min(value) as value from signals join told using (doc_id) where not base_failed group by all having bool_and(good)),
tested as (select lang, signal, cutoff, count(*) as n, count(*) filter (value > cutoff) as k from trials join (values {tests}) as t(signal, cutoff) using (signal) group by all),
bounds as (
  select *, (select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({part}) + (n - j) * ln(1 - {part}))) from range(k + 1) as r(j)) as p,
    (select count(distinct coalesce(lang, '')) from tested) as strata from tested),
cutoffs as (select lang, signal, min(cutoff) as cutoff from bounds where k < n * {part} and p <= {error} / ({size} * strata) group by all),
rejected as (select distinct s.doc_id from signals s join cutoffs c on s.lang is not distinct from c.lang and s.signal = c.signal where value > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from rejected) as kept from judged"""
