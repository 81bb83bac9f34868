"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

*Reduction.* With M the largest norm, a vector x becomes (x/M, sqrt(1 - |x/M|^2)) and a query q becomes (q/|q|, 0); both
are unit vectors, and the nearest x to q by distance is that with the largest inner product.
*Tables.* Each table hashes by ``width``-wide cells of several Gaussian (2-stable) projections. The number of projections
grows with the logarithm of the number of vectors, so buckets keep their size.
*Probes.* For a neighbour at inner product rho from the query, the projection is about normal with mean rho times the
query's and variance 1 - rho^2, which gives each cell, and by products each bucket, a probability of holding it. Buckets are visited from
the most probable on (best first over the cells' order, so no grid is built) until their probabilities add up to SUCCESS in each table. rho is first that
of the k-th neighbour in a bounded sample (SAMPLE vectors), a median. The k-th score that a query finds is at most that of its true k-th
neighbour; where it is below the rho assumed, the query is asked again with its own, so its buckets' success is SUCCESS at least whatever
the density around it. A query whose own rho asks for more buckets than there are vectors visits all buckets.
*Distribution.* Table rows and probes meet in partitions of buckets: within one, the index comes first and stays in memory, queries
stream by in batches, and each probed bucket is one matrix product. A bucket larger than BUCKET_ROWS is split over several partitions. Each
partition answers with one row a query, a list of its best k at most; a query's lists, sorted next to each other, are merged as they stream by. A
query that is asked again brings its k-th score along, so partitions answer only with what is no worse.

Equal vectors are one entry with its k + 1 smallest ids, and equal queries are asked once, so copies cost nothing.
A query that finds fewer than k (or all) candidates is asked again of all buckets: the exact way.

The LENGTHS most common vector lengths have an index each; vectors of other lengths are compared one with another, in blocks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without id; vectors
of different lengths don't meet; ties go to the smaller id; a query's own id is never its neighbour; repeated rows count once.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

TABLES, WIDTH, SUCCESS, SAMPLE = 2, 1.5, 0.88, 2048
BUCKET_ROWS, PART_ROWS, BATCH, LENGTHS = 20_000, 8192, 256, 16
ROWS = "p bigint, kind int, id bigint, vec array<double>, floor double, ids array<bigint>, keys array<bigint>"
NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]
LISTS = "query bigint, ids array<bigint>, scores array<double>"


def normal_below(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


class Hashes:
    """The hash functions of all tables, made from a seed, the same in every worker."""

    def __init__(self, dim: int, functions: int, largest: float, rho: float, seed: int = 7):
        rng = np.random.default_rng([seed, dim, functions])
        self.a = rng.standard_normal((TABLES, dim + 1, functions))
        self.b = rng.random((TABLES, functions)) * WIDTH
        self.largest, self.rho = largest, min(max(rho, 0.0), 0.999)

    @staticmethod
    def key(table: int, cells) -> int:
        raw = xxhash.xxh64_intdigest(np.asarray([table, *cells], "<i8").tobytes())
        return raw - (1 << 64) if raw >> 63 else raw

    def index_keys(self, x: np.ndarray) -> np.ndarray:
        """A key for each vector and table."""
        x = x / self.largest
        x = np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]])
        cells = np.floor((np.einsum("nd,tdk->tnk", x, self.a) + self.b[:, None, :]) / WIDTH).astype(np.int64)
        return np.array([[self.key(t, row) for row in cells[t]] for t in range(TABLES)], np.int64).reshape(TABLES, len(x)).T

    def probes(self, q: np.ndarray, rho: float | None = None, most: int | None = None) -> list[tuple[int, int]] | None:
        """(table, key) of the buckets to visit for one query, each table's in order of estimated success; None for more than ``most`` in a table."""
        unit = q / np.linalg.norm(q)
        out = []
        rho = self.rho if rho is None else min(max(rho, -0.999), 0.999)
        spread = math.sqrt(1 - rho**2)
        for t in range(TABLES):
            cells = [self._cells(float(p) * rho, float(b), spread) for p, b in zip(unit @ self.a[t, :-1], self.b[t], strict=True)]
            found = list(itertools.islice(self._best_first(cells), None if most is None else most + 1))
            if most is not None and len(found) > most:
                return None
            out += [(t, self.key(t, bucket)) for bucket in found]
        return out

    @staticmethod
    def _cells(mean: float, shift: float, spread: float) -> list[tuple[float, int]]:
        """(probability, cell), most probable first."""
        low, high = (math.floor((mean + s * 4 * spread + shift) / WIDTH) for s in (-1, 1))
        below = [normal_below((c * WIDTH - shift - mean) / spread) for c in range(low, high + 2)]
        return sorted(((below[i + 1] - below[i], c) for i, c in enumerate(range(low, high + 1))), reverse=True)

    @staticmethod
    def _best_first(cells: list[list[tuple[float, int]]]) -> Iterator[tuple[int, ...]]:
        """Buckets by falling probability, until they add up to SUCCESS."""
        at = (0,) * len(cells)
        total, queue = 0.0, [(-math.prod(c[0][0] for c in cells), at, 0)]
        while queue and total < SUCCESS:
            p, at, first = heapq.heappop(queue)
            total -= p
            yield tuple(c[i][1] for c, i in zip(cells, at, strict=True))
            for k in range(first, len(cells)):  # each bucket is reached once: only places from the last raised one on are raised
                i = at[k]
                if i + 1 < len(cells[k]) and cells[k][i + 1][0] > 0:
                    heapq.heappush(queue, (p / cells[k][i][0] * cells[k][i + 1][0], (*at[:k], i + 1, *at[k + 1 :]), k))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, by score and then smaller id, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    out = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(scores, out, 1).min(1)
    for r in np.nonzero((scores >= least[:, None]).sum(1) > k)[0]:
        if least[r] > -np.inf:
            out[r] = np.lexsort((ids[r], -scores[r]))[:k]
    return out


class Part:
    """The index rows of one partition of buckets, and the search in it."""

    def __init__(self, rows: list[pa.RecordBatch], k: int):
        ids, keys, vecs, self.k = [], [], [], k
        self.ids_of: dict[int, list[int]] = {}
        for b in rows:
            ids += b.column("id").to_pylist()
            keys.append(b.column("keys").flatten().to_numpy())
            vecs.append(b.column("vec").flatten().to_numpy().reshape(b.num_rows, -1))
            self.ids_of.update(zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True))
        keys = np.concatenate(keys)
        order = np.lexsort((np.array(ids), keys))
        self.id, self.x = np.array(ids, np.int64)[order], np.concatenate(vecs)[order]
        self.key, self.begin = np.unique(keys[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def search(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """query, ids, scores: the best k of each query in this partition that reach its floor, copies included."""
        q = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, -1)
        floor = np.nan_to_num(batch.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
        floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), floor)  # products differ from exact scores in the last digits
        asked: dict[int, list[int]] = {}
        for r, keys in enumerate(batch.column("keys")):
            if not keys.is_valid:  # all buckets
                found = range(len(self.key))
            else:
                keys = keys.values.to_numpy()
                at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
                found = np.unique(at[self.key[at] == keys]).tolist()
            for bucket in found:
                asked.setdefault(bucket, []).append(r)
        score = np.full((len(q), self.k), -np.inf)
        at = np.zeros((len(q), self.k), np.int64)
        for bucket, rows in asked.items():
            lo, hi = self.begin[bucket], self.end[bucket]
            product = q[rows] @ self.x[lo:hi].T
            product[product < floor[rows][:, None]] = -np.inf
            both = np.hstack([score[rows], product])
            where = np.hstack([at[rows], np.broadcast_to(np.arange(lo, hi), (len(rows), hi - lo))])
            take = best_of(both, self.id[where], self.k)
            score[rows], at[rows] = np.take_along_axis(both, take, 1), np.take_along_axis(where, take, 1)
        names, ids, scores = [], [], []
        for r, query in enumerate(batch.column("id").to_pylist()):
            own = at[r][score[r] > -np.inf]
            if len(own):
                exact = (q[r] * self.x[own]).sum(1)
                copies = [self.ids_of[i] for i in self.id[own].tolist()]
                every, values = np.array([i for c in copies for i in c]), np.repeat(exact, [len(c) for c in copies])
                best = np.lexsort((every, -values))[: self.k]
                names.append(query)
                ids.append(every[best])
                scores.append(values[best])
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["query", "ids", "scores"])


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """query, vec_id, score: the best k of each query's lists. Rows are sorted by query; only one query's best are held."""
    now, best = None, (np.zeros(0, np.int64), np.zeros(0))

    def rows(done: list) -> pa.RecordBatch:
        n = [len(ids) for _, ids, _ in done]
        columns = [np.repeat(np.array([q for q, *_ in done], np.int64), n), *(np.concatenate([d[i] for d in done]) if done else np.zeros(0, t) for i, t in ((1, np.int64), (2, float)))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "vec_id", "score"])

    for batch in batches:
        done = []
        for query, ids, scores in zip(batch.column("query").to_pylist(), batch.column("ids"), batch.column("scores"), strict=True):
            if query != now:
                if now is not None:
                    done.append((now, *best))
                now, best = query, (np.zeros(0, np.int64), np.zeros(0))
            ids, first = np.unique(np.concatenate([best[0], ids.values.to_numpy()]), return_index=True)  # a vector can come from each table
            scores = np.concatenate([best[1], scores.values.to_numpy()])[first]
            keep = np.lexsort((ids, -scores))[:k]
            best = ids[keep], scores[keep]
        yield rows(done)
    if now is not None:
        yield rows([(now, *best)])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (p, kind): a partition's index, then its queries."""
    p, held, part = None, [], None
    for whole in batches:
        marks = whole.column("p").to_numpy().astype(np.int64) * 2 + whole.column("kind").to_numpy()
        cuts = [0, *(np.nonzero(np.diff(marks))[0] + 1).tolist(), len(marks)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            now, kind = divmod(int(marks[lo]), 2)
            if now != p:
                p, held, part = now, [], None
            piece = whole.slice(lo, hi - lo)
            if kind == 0:
                held.append(piece)
                continue
            if part is None and held:
                part, held = Part(held, k), []
            if part is not None:
                for i in range(0, piece.num_rows, BATCH):
                    yield part.search(piece.slice(i, BATCH))


def nearest(vectors: DataFrame, is_query, k: int, scratch: Scratch) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the condition ``is_query`` holds.

    vectors: vec_id (bigint), embedding (array of numbers)."""
    good = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).filter(
        F.col("vec_id").isNotNull()
        & (F.size("vec") > 0)
        & F.forall("vec", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
        & F.exists("vec", lambda x: x != 0)
    )
    good = scratch.table(good.distinct(), "vectors")
    # equal vectors: k + 1 ids, cut before the shuffle
    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    entries = good.withColumn("n", first).filter(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = scratch.table(entries.select(F.col("ids")[0].alias("id"), "vec", "ids"), "entries")
    asking = good.filter(is_query).join(entries.select("vec", "id"), "vec").select(F.col("vec_id").alias("query_id"), "id", F.size("vec").alias("length"))
    asking = scratch.table(asking, "queries")
    lengths = entries.groupBy(F.size("vec").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    lengths = lengths.orderBy(F.desc("n"), "length").limit(LENGTHS + 1).collect()
    found = [_of_length(entries.filter(F.size("vec") == r["length"]), asking.filter(F.col("length") == r["length"]), r["n"], math.sqrt(r["most"]), r["length"], k, scratch) for r in lengths[:LENGTHS]]
    if len(lengths) > LENGTHS:
        common = [r["length"] for r in lengths[:LENGTHS]]
        found.append(_of_rare_lengths(entries.filter(~F.size("vec").isin(common)), asking.filter(~F.col("length").isin(common)), k, scratch))
    if not found:
        return good.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _answers(rows: DataFrame, parts: int, k: int) -> DataFrame:
    """query, vec_id, score: the best k + 1 of each query, itself included, from index and query rows (ROWS)."""
    rows = rows.repartition(parts, "p").sortWithinPartitions("p", "kind")
    lists = rows.mapInArrow(lambda b: _search(b, k + 1), LISTS)
    return lists.repartition("query").sortWithinPartitions("query").mapInArrow(lambda b: _merged(b, k + 1), "query bigint, vec_id bigint, score double")


def _to_askers(asking: DataFrame, hits: DataFrame) -> DataFrame:
    return asking.join(hits, F.col("id") == F.col("query")).filter("query_id <> vec_id").select("query_id", "vec_id", "score")


def _of_rare_lengths(entries: DataFrame, asking: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """query_id, vec_id, score of the best among the vectors of equal length, by comparing each query with all of them in blocks of PART_ROWS."""
    small_batches(entries.sparkSession)
    blocks = entries.groupBy(F.size("vec").alias("length")).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("blocks"))
    rows = entries.join(blocks, F.size("vec") == F.col("length"))
    empty = F.lit(None)
    column = lambda block: F.shiftleft(F.col("length").cast("long"), 32) + block
    index = rows.select(column(F.pmod(F.xxhash64("id"), "blocks")).alias("p"), F.lit(0).alias("kind"), "id", "vec", empty.cast("double").alias("floor"), "ids", F.array(F.lit(0).cast("long")).alias("keys"))
    queries = rows.join(asking.select("id").distinct(), "id", "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = queries.select(column(F.col("block")).alias("p"), F.lit(1).alias("kind"), "id", "vec", empty.cast("double").alias("floor"), empty.cast("array<bigint>").alias("ids"), empty.cast("array<bigint>").alias("keys"))
    parts = max(1, math.ceil(entries.count() / PART_ROWS))
    return _to_askers(asking, scratch.table(_answers(index.union(asked), parts, k), "rare"))


def _of_length(entries: DataFrame, asking: DataFrame, n: int, largest: float, dim: int, k: int, scratch: Scratch) -> DataFrame:
    """query_id, vec_id, score among vectors of one length: more than the best k of each query."""
    spark = entries.sparkSession
    small_batches(spark)
    queries = entries.join(asking.select("id").distinct(), "id", "left_semi")
    sample = np.array([r["vec"] for r in entries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()])
    functions = max(1, round(math.log2(max(4, n / 20)) / 2))
    hashes = Hashes(dim, functions, largest, _rho(sample, largest, k, n))
    parts = max(1, math.ceil(n / PART_ROWS))  # of each table; a partition holds buckets of one table, so no vector twice

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy().reshape(b.num_rows, dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(hashes.index_keys(x)), pa.list_(pa.int64()))], ["id", "vec", "ids", "keys"])

    index = entries.select("id", "vec", "ids").mapInArrow(keyed, "id bigint, vec array<double>, ids array<bigint>, keys array<bigint>")
    index = index.select("id", "vec", "ids", F.posexplode("keys").alias("t", "key"))
    # at most n * TABLES / BUCKET_ROWS rows
    large = {r["key"]: -(-r["n"] // BUCKET_ROWS) for r in index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET_ROWS).collect()}

    def part_of(table: np.ndarray, key: np.ndarray, share: np.ndarray) -> np.ndarray:
        mixed = (key.astype(np.uint64) ^ (share.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (table * parts + ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)).astype(np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
            shares = np.array([i % large.get(key, 1) for i, key in zip(ids.tolist(), keys.tolist(), strict=True)], np.int64)
            size = b.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(keys))
            parts_of = pa.array(part_of(b.column("t").to_numpy().astype(np.int64), keys, shares))
            yield pa.RecordBatch.from_arrays([parts_of, pa.array(np.zeros(size, np.int32)), b.column("id"), b.column("vec"), pa.nulls(size, pa.float64()), b.column("ids"), lists], NAMES)

    def probing(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy().reshape(b.num_rows, dim)
            for r, rho in enumerate(b.column("rho").to_pylist()):
                probes = None if every else hashes.probes(x[r], rho, n)
                if probes is None:
                    to: list = [(p, None) for p in range(parts)]  # the first table's partitions hold every vector
                else:
                    keys = [(t, key, s) for t, key in probes for s in range(large.get(key, 1))]
                    at = part_of(*(np.array(c, np.int64) for c in zip(*keys, strict=True))).tolist()
                    lists: dict[int, list[int]] = {}
                    for p, (_, key, _) in zip(at, keys, strict=True):
                        lists.setdefault(p, []).append(key)
                    to = list(lists.items())
                m = len(to)
                one = b.slice(r, 1)
                same = lambda c, one=one, m=m: one.column(c).take(pa.array([0] * m))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in to], pa.int64()), pa.array([1] * m, pa.int32()), same("id"), same("vec"), same("floor"), pa.nulls(m, pa.list_(pa.int64())), pa.array([x for _, x in to], pa.list_(pa.int64()))],
                    NAMES,
                )

    def ask(questions: DataFrame, every: bool, name: str) -> DataFrame:
        rows = index.mapInArrow(dealt, ROWS).union(questions.select("id", "vec", "rho", "floor").mapInArrow(lambda b: probing(b, every), ROWS))
        return scratch.table(_answers(rows, parts * TABLES, k), name)

    queries = queries.withColumns({"rho": F.lit(None).cast("double"), "floor": F.lit(None).cast("double")})
    hits = ask(queries, False, "hits")
    # each query's own rho: of the k-th found beside itself
    last = hits.groupBy("query").agg(F.min("score").alias("last"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > k)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    own = queries.drop("rho", "floor").join(last, F.col("id") == F.col("query")).withColumn("rho", F.col("last") / (norm * largest)).filter(F.col("rho") < hashes.rho)
    again = scratch.table(own.select("id", "vec", "rho", F.col("last").alias("floor")), "again")
    if not again.isEmpty():
        hits = hits.union(ask(again, False, "hits-again")).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    enough = hits.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > k)
    short = scratch.table(queries.join(enough, F.col("id") == F.col("query"), "left_anti"), "short")
    if not short.isEmpty():
        hits = hits.join(short, F.col("query") == F.col("id"), "left_anti").union(ask(short, True, "rest"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    hits = hits.withColumn("n", best).filter(F.col("n") <= k + 1)
    return _to_askers(asking, hits)


def _rho(sample: np.ndarray, largest: float, k: int, n: int) -> float:
    """Inner product, after the reduction, of the k-th of n neighbours, as the sample has it: the median over some queries."""
    if len(sample) < 2:
        return 0.0
    q = sample[:128] / np.linalg.norm(sample[:128], axis=1)[:, None]
    scores = q @ sample.T / largest
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    place = min(len(sample) - 1, max(1, round(k * len(sample) / n)))
    return float(np.median(-np.sort(-scores, axis=1)[:, place - 1]))


def op3_vector_search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each row whose vec_id is divisible by ``every``."""
    scratch = Scratch(embeddings.sparkSession, "vectors")
    return nearest(embeddings, F.col("vec_id") % every == 0, k, scratch)
