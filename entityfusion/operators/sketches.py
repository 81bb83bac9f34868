"""Distinct counts and quantiles as sketch columns: made once for a part (a day, say), stored, and merged later into any coarser group without
the rows. Sketches combine before the shuffle and have a fixed size, so a hot group is no hot task.

Errors, as the sketches' own definitions have them: a distinct count's relative standard error is 1.04 / sqrt(2^LG_K), about 1.6 %; the rank of a quantile
is off by less than RANK_ERROR of the rows with 99 % confidence. Small groups are exact. Quantiles draw on random bits, so that runs differ within
that error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K, K = 12, 400
#: Relative standard error of a distinct count, and error in rank of a quantile of K.
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.0075


def _number(value: str) -> Column:
    """NaN has no rank, like null."""
    x = F.col(value).cast("double")
    return F.when(~F.isnan(x), x)


def sketched(rows: DataFrame, by: list[str], distinct: dict[str, str] | None = None, quantiles: dict[str, str] | None = None) -> DataFrame:
    """by, n, and a sketch of each name: of the distinct values of a column, or of its numbers. Nulls (and NaN among numbers) are in ``n`` only;
    a null ``by`` is a group like any other; no rows give no groups."""
    made = [F.hll_sketch_agg(c, LG_K).alias(name) for name, c in (distinct or {}).items()]
    made += [F.kll_sketch_agg_double(_number(c), K).alias(name) for name, c in (quantiles or {}).items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *made)


def merged(stored: DataFrame, by: list[str], distinct: list[str] = (), quantiles: list[str] = ()) -> DataFrame:
    """The same columns for coarser groups, from stored sketches. Merging again, in any order, gives the sketches of all rows."""
    made = [F.hll_union_agg(c).alias(c) for c in distinct] + [F.kll_merge_agg_double(c, K).alias(c) for c in quantiles]
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), *made)


def distinct_count(sketch: str) -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(sketch: str, rank: float) -> Column:
    """The value of that rank (0 to 1); null where the sketch holds no number."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(rank))))
