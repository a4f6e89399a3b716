"""Exact ranks, quantiles and correlations in groups of any size.

A group's values are cut at sketched quantiles; rows are ordered within (group, cut) only, and each
cut starts at the count of the cuts below it. Cuts decide where work is done, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join

CUTS = 64


def _cut(rows: DataFrame, keys: Sequence[str], value: str, cuts: int) -> DataFrame:
    """Known values (not NULL or NaN) with ``_cut``, the number of cut points below the value."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    points = known.groupBy(*keys).agg(F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 2000).alias("_points"))
    placed = salted_join(known.withColumn("_spread", F.xxhash64(value)), points, keys, "_spread", salts=8)
    return placed.withColumn("_cut", F.size(F.filter("_points", lambda p: p < F.col(value)))).drop("_points", "_spread")


def _offsets(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    counts = placed.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_k"))
    over = Window.partitionBy(*keys).orderBy("_cut")
    return counts.select(
        *keys,
        "_cut",
        F.coalesce(F.sum("_k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.col("_k"),
        F.sum("_k").over(Window.partitionBy(*keys)).alias("_n"),
    )


def _same(keys: Sequence[str]) -> Column:
    same = F.col("l._cut") == F.col("r._cut")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return same


def with_average_rank(rows: DataFrame, keys: Sequence[str], value: str, out: str, cuts: int = CUTS) -> DataFrame:
    """Rows with a known ``value`` and its average rank (from 1; ties share the mean of their ranks), and ``<out>_n``, the group's size."""
    placed = _cut(rows, keys, value, cuts)
    joined = placed.alias("l").join(_offsets(placed, keys).alias("r"), _same(keys)).select("l.*", "r._off", "r._n")
    inside = Window.partitionBy(*keys, "_cut")
    rank = F.col("_off") + F.rank().over(inside.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, "_cut", value)) - 1) / 2.0
    return joined.withColumns({out: rank, f"{out}_n": F.col("_n")}).drop("_cut", "_off", "_n")


def top_ranked(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], out: str, cuts: int = CUTS) -> DataFrame:
    """Rows with a known score and their place from the top (1 = greatest score, ties by ``tie`` ascending), and ``<out>_n``."""
    placed = _cut(rows, keys, score, cuts)
    joined = placed.alias("l").join(_offsets(placed, keys).alias("r"), _same(keys)).select("l.*", "r._off", "r._k", "r._n")
    inside = Window.partitionBy(*keys, "_cut").orderBy(F.col(score).desc(), *tie)
    above = F.col("_n") - F.col("_off") - F.col("_k")
    return joined.withColumns({out: above + F.row_number().over(inside), f"{out}_n": F.col("_n")}).drop("_cut", "_off", "_k", "_n")


def exact_quantiles(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], cuts: int = CUTS) -> DataFrame:
    """(keys, q, value, n): linearly interpolated quantiles of the known values; groups without any are absent.

    Only the cuts that hold a wanted rank are ordered.
    """
    placed = _cut(rows.select(*keys, value), keys, value, cuts)
    offsets = _offsets(placed, keys)
    wanted = offsets.select(*keys, "_cut", "_off", "_k", "_n", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q"))
    place = F.col("q") * (F.col("_n") - 1)
    ranks = wanted.select(*keys, "_cut", "_off", "_k", "_n", "q", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))).alias("_rank"))
    ranks = ranks.filter((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_k")))
    needed = ranks.select(*keys, "_cut", "_off").distinct()
    ordered = placed.alias("l").join(needed.alias("r"), _same(keys)).select("l.*", "r._off")
    numbered = ordered.withColumn("_rank", F.col("_off") + F.row_number().over(Window.partitionBy(*keys, "_cut").orderBy(value)) - 1)
    same = F.col("l._rank") == F.col("r._rank")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    hits = ranks.alias("l").join(numbered.alias("r"), same).select(*[F.col(f"l.{k}") for k in keys], "l.q", "l._n", "l._rank", F.col(f"r.{value}").alias("_v"))
    lo, hi = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    part = F.col("q") * (F.first("_n") - 1) - F.floor(F.col("q") * (F.first("_n") - 1))
    return hits.groupBy(*keys, "q").agg((lo + (hi - lo) * part).alias("value"), F.first("_n").alias("n"))


def correlation(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, n, pearson, spearman) over rows where both values are known; NULL correlations for constant columns or n < 2."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(*keys, a, b)
    ranked = with_average_rank(with_average_rank(both, keys, a, "_ra"), keys, b, "_rb")

    def r(x: str, y: str) -> Column:
        # corr() divides by zero on a constant column
        return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))

    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), r(a, b).alias("pearson"), r("_ra", "_rb").alias("spearman"))
