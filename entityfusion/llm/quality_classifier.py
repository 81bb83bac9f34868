"""Quality classification by hierarchical empirical Bayes: a document's own evidence with the record of its host and path.

*Document evidence.* A logistic regression on shares and counts of the whole text gives each document a log likelihood
ratio: its log odds less those of the sample that it learned from. It learns from a sample of labelled documents that
``sample`` bounds (in the mean, by a hash of the id; one text an id). There are two models, each learned from one half of the texts, by a hash of the text, and
a text gets its evidence from the model of the other half, so no text is judged by a model that has seen it or a copy of it.
*Sites.* Over all documents, each counts for its path and host with the probability that its evidence gives it under the global prior, or
with its label where it has one. Paths shrink to their host, hosts to the global prior: the posterior mean of a site of
n documents with sum s is (s + k m) / (n + k), m being the level above. The strengths k are empirical Bayes estimates:
by moments, from how much sites differ beyond chance. A sparse site so says what its host says, a dense one its own record.
*Verdict.* The posterior log odds are those of the path, without the document itself, plus the document's evidence.

Aggregation is grouped by (host, path) and combines before the shuffle; a host with a third of all documents is some rows.

Defined results: null and empty texts are classified like texts without words; a null host or path is a site of its own; labels of one
document that differ count as the lower; without labels, or with one class only, evidence is 0 and every document has the prior; repeated rows
count each time; documents without id have no label.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import few
from .common import Scratch, by_batch, read_table, small_batches

SAMPLE, RIDGE, STEPS = 20_000, 1e-2, 40
LEAST, MOST = 1e-4, 1 - 1e-4
#: Sites up to which their posteriors are broadcast (below 100 bytes each); beyond, they are joined by shuffle.
SITES = 100_000
#: Strength of a level whose sites don't differ beyond chance, and least strength.
STRONGEST, WEAKEST = 1e6, 2.0
NAMES = ("log_words", "word_length", "distinct", "common", "symbols", "marks", "digits", "upper_words", "no_letters", "bars", "lines", "dup_lines", "short_lines", "pairs", "stops", "runs")
RUNS = re.compile(r"([^\w\s])\1{1,}")
SYMBOLS, MARKS = str.maketrans("", "", "#*$%&|<>{}[]\\^~=+_@"), str.maketrans("", "", "!?:;")


def features(text: str) -> list[float]:
    """Shares and logarithms that say how a text is made; all are finite for any text."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(len(words)), min(sum(map(len, words)) / n, 50.0), len(counts) / n, max(counts.values(), default=0) / n, min((len(text) - len(text.translate(SYMBOLS))) / n, 5.0), min((len(text) - len(text.translate(MARKS))) / n, 5.0),
        sum(map(text.count, "0123456789")) / chars, sum(map(str.isupper, words)) / n, 1 - sum(1 for w in words if any(map(str.isalpha, w))) / n, text.count("|") / n, np.log1p(len(lines)), 1 - len(set(lines)) / m,
        sum(len(x) < 20 for x in lines) / m, len(set(zip(words, words[1:], strict=False))) / n, min(text.count(".") / n, 1.0), min(len(RUNS.findall(text)) / n, 5.0),
    ]


def fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Ridge logistic regression by Newton's steps, on standardised features; None if there is one class only."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, ridge = np.zeros(z.shape[1]), RIDGE * len(y) * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    prior = float(np.clip(y.mean(), LEAST, MOST))
    return {"mean": mean, "scale": scale, "w": w, "prior": np.log(prior / (1 - prior))}


def evidence_of(x: np.ndarray, fold: np.ndarray, models: tuple[dict | None, dict | None]) -> np.ndarray:
    """Log likelihood ratios of features, those of a fold by the model of the other; 0 where there is none."""
    out = np.zeros(len(x))
    for own, m in enumerate(reversed(models)):
        rows = fold == own
        if m is not None and rows.any():
            out[rows] = np.clip((x[rows] - m["mean"]) / m["scale"], -8, 8) @ m["w"][1:] + m["w"][0] - m["prior"]
    return out


def with_features(df: DataFrame, keep: tuple[str, ...], models: tuple[dict | None, dict | None], learning: bool = False) -> DataFrame:
    """The kept columns with ``x`` (the features) and ``fold``, or with ``evidence`` (the log likelihood ratio) under the models of the folds."""
    small_batches(df.sparkSession)
    df = df.withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).cast("int"))
    keep = (*keep, "fold") if learning else keep
    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    sent = df.sparkSession.sparkContext.broadcast(models)

    def make():
        held = sent.value

        def step(batch):
            x = np.array([features(v.as_py() or "") for v in batch.column("text")]).reshape(-1, len(NAMES))
            if learning:
                made, name = pa.array(list(x), pa.list_(pa.float64())), "x"
            else:
                made, name = pa.array(evidence_of(x, batch.column("fold").to_numpy(), held)), "evidence"
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], [*keep, name])

        return step

    return by_batch(df.select(*keep, *(() if learning else ("fold",)), "text"), make, f"{head}x array<double>" if learning else f"{head}evidence double")


def learn(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[dict | None, dict | None]:
    """The document classifiers of the two folds; labels: doc_id, good, each id once."""
    n = labels.count()
    grain = 1 << 20
    some = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < min(grain, grain * sample // max(1, n) + 1)).withColumnRenamed("doc_id", "_id")
    # about ``sample`` ids, each with one text
    rows = docs.select("doc_id", "text").join(F.broadcast(some) if few(some, 2 * sample) else some, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("text").alias("text"))
    got = with_features(rows, ("doc_id", "good"), (None, None), learning=True).orderBy("doc_id").toArrow()
    x, y = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)), got.column("good").to_numpy().astype(float)
    fold = got.column("fold").to_numpy()
    return fit(x[fold == 0], y[fold == 0]), fit(x[fold == 1], y[fold == 1])


def log_odds(p: Column) -> Column:
    p = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), p))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, n: str, s: str, mean: Column) -> float:
    """Empirical Bayes strength of a level by moments: how far the sites' means vary about ``mean`` beyond chance."""
    p = F.col(s) / F.col(n)
    r = sites.agg(F.sum(F.col(n) * (p - mean) ** 2).alias("q"), F.sum(mean * (1 - mean)).alias("v"), F.sum(F.col(n)).alias("n"), F.sum(F.col(n) ** 2).alias("n2"), F.count(F.lit(1)).alias("m")).first()
    if not r["m"] or r["m"] < 2:
        return STRONGEST
    variance = r["v"] / r["m"]
    spread = (r["q"] - r["v"] * (r["m"] - 1) / r["m"]) / max(1e-9, r["n"] - r["n2"] / r["n"])
    return float(min(STRONGEST, max(WEAKEST, variance / spread - 1))) if spread > 0 else STRONGEST


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch, host: str = "source", path: str = "lang", sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score (probability of good quality), kept (score of ``least`` or more).

    docs: doc_id, text, and the columns of host and path. labels: doc_id, quality."""
    labels = scratch.table(labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good")), "labels")
    models = learn(docs, labels, sample)
    given = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), "text")
    told = scratch.table(with_features(given, ("doc_id", "host", "path"), models), "evidence")
    prior = labels.agg(F.avg(F.col("good").cast("double"))).first()[0]
    base = float(np.clip(0.5 if prior is None else prior, LEAST, MOST))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    told = told.join(labels.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    told = scratch.table(told.withColumn("s", F.coalesce(F.col("good").cast("double"), logistic(F.col("evidence") + float(np.log(base / (1 - base)))))), "told")
    paths = scratch.table(told.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("s").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = paths.agg(F.sum("s"), F.sum("n")).first()
    mean = float(whole[0] / whole[1]) if whole[1] else base
    k_host = strength(hosts, "host_n", "host_s", F.lit(mean))
    hosts = hosts.withColumn("host_posterior", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host)).withColumnRenamed("host", "_host")
    sites = scratch.table(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", F.col("s").alias("site_s"), "host_posterior"), "sites")
    k_path = strength(sites, "n", "site_s", F.col("host_posterior"))
    sites = F.broadcast(sites) if few(sites, SITES) else sites
    met = told.join(sites, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    without = (F.col("site_s") - F.col("s") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    met = met.withColumn("path_posterior", F.greatest(F.lit(LEAST), F.least(F.lit(MOST), without)))
    score = logistic(log_odds(F.col("path_posterior")) + F.col("evidence"))
    return met.select("doc_id", "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= least).alias("kept"))


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score, kept of every document."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), Scratch(spark, "classifier"))
