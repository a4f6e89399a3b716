"""Percentiles from merging centroid digests, with the rank error counted afterwards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join
from candlewright.operators.rolling import latest_load
from candlewright.session import materialise

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def cluster(points: DataFrame, groups: Sequence[str], delta: int) -> DataFrame:
    """(groups, mean, weight, lo, hi): at most ``delta`` + 1 centroids a group.

    ``points`` has the same columns (a raw value x is mean x, weight 1, lo x, hi x). Sorted by mean, a
    point whose middle lies at quantile q goes to cluster floor(delta * (asin(2q - 1) / pi + 1/2)):
    clusters are small at both ends. Infinite values have clusters of their own. Clustering the union of digests again merges
    them, in any grouping.
    """
    whole = Window.partitionBy(*groups)
    ordered = whole.orderBy("mean", "weight", "lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    q = (F.sum("weight").over(ordered) - F.col("weight") / 2) / F.sum("weight").over(whole)
    inner = F.floor(F.lit(float(delta)) * (F.asin(2 * F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) - 1) / math.pi + 0.5))
    bin_ = F.when(F.col("mean") == float("-inf"), -1).when(F.col("mean") == float("inf"), delta + 1).otherwise(inner)
    return (
        points.select(*groups, "mean", "weight", "lo", "hi", bin_.alias("_bin"))
        .groupBy(*groups, "_bin")
        .agg(
            (F.sum(F.col("mean") * F.col("weight")) / F.sum("weight")).alias("mean"),
            F.sum("weight").alias("weight"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        .drop("_bin")
    )


def measured(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, column, value): the known readings; NULL and NaN are missing."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_r")
    return rows.select(*keep, values).select(*keep, "_r.column", "_r.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def digest_parts(values: DataFrame, groups: Sequence[str], delta: int) -> DataFrame:
    """Digests of the parts that ``groups`` name; store them, and merge any of them with ``cluster``."""
    return cluster(values.select(*groups, F.col("value").alias("mean"), F.lit(1.0).alias("weight"), F.col("value").alias("lo"), F.col("value").alias("hi")), groups, delta)


def estimates(digest: DataFrame, groups: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """(groups, quantile, value, n, bound): interpolated between centroid middles, at the ends to the least and greatest value.

    Beside an infinite centroid nothing is interpolated. bound: the share of the group's weight in the two centroids about the estimate.
    """
    ordered = Window.partitionBy(*groups).orderBy("mean", "weight", "lo")
    run = ordered.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    placed = digest.select(
        *groups,
        "mean",
        "weight",
        "lo",
        (F.sum("weight").over(run) - F.col("weight") / 2).alias("_mid"),
        F.sum("weight").over(whole).alias("n"),
        F.min("lo").over(whole).alias("_min"),
        F.max("hi").over(whole).alias("_max"),
        F.row_number().over(ordered).alias("_i"),
    ).withColumns({"_next": F.lead("mean").over(ordered), "_next_mid": F.lead("_mid").over(ordered), "_next_w": F.lead("weight").over(ordered)})

    def point(a_at: Column, a: Column, b_at: Column, b: Column, share: Column, turn: Column) -> Column:
        return F.struct(a_at.alias("a_at"), a.alias("a"), b_at.alias("b_at"), b.alias("b"), share.alias("share"), turn.alias("turn"))

    zero = F.lit(0.0)
    head = F.when(F.col("_i") == 1, point(zero, F.col("_min"), F.col("_mid"), F.col("mean"), F.col("weight"), zero))
    tail = point(F.col("_mid"), F.col("mean"), F.coalesce("_next_mid", F.col("n") + 1e-9), F.coalesce("_next", "_max"), F.col("weight") + F.coalesce("_next_w", zero), F.col("_mid") + F.col("weight") / 2)
    spans = placed.select(*groups, "n", F.explode(F.array_compact(F.array(head, tail))).alias("s"))
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    hits = spans.select(*groups, "n", "s", wanted).filter((F.col("quantile") * F.col("n") >= F.col("s.a_at")) & (F.col("quantile") * F.col("n") < F.col("s.b_at")))
    part = F.least(F.lit(1.0), F.try_divide(F.col("quantile") * F.col("n") - F.col("s.a_at"), F.col("s.b_at") - F.col("s.a_at")))
    # (1 - p) a + p b would overflow less, but a value between equal ends must be exact
    finite = (F.abs("s.a") < float("inf")) & (F.abs("s.b") < float("inf"))
    nearer = F.when(F.col("quantile") * F.col("n") < F.col("s.turn"), F.col("s.a")).otherwise(F.col("s.b"))
    value = F.when(F.col("s.a") == F.col("s.b"), F.col("s.a")).when(~finite, nearer).otherwise(F.col("s.a") * (1 - part) + F.col("s.b") * part)
    return hits.select(*groups, "quantile", value.alias("value"), F.col("n").cast("bigint").alias("n"), (F.col("s.share") / F.col("n")).alias("bound"))


def bar_percentiles(
    bars: DataFrame,
    columns: Sequence[str] = ("ma_dispersion_atr", "atr_14"),
    quantiles: Sequence[float] = QUANTILES,
    delta: int = 200,
    part_rows: int = 65_536,
    fan_in: int = 256,
) -> DataFrame:
    """Percentiles of ``columns`` per symbol and over all (overall true, symbol NULL), with certified rank errors.

    Returns (overall, symbol, column, quantile, value, n, bound, rank_error, within_bound).
    rank_error is counted in a second pass over all bars: how far ``quantile`` lies outside the shares of
    values below and not above ``value``. Every bar counts once (its last load); missing readings
    (NULL, NaN) don't count, and a group without any has no row. Infinities are readings. Repeated values
    are ordinary; an empty table gives no rows. Other columns are ignored.

    The readings are written once, slim, to the shared folder: digests and the second pass both read them. A part is a symbol's ``part_rows`` positions, so no task sorts a whole symbol; digests are
    merged ``fan_in`` parts at a time and then per symbol, and symbols in groups and then over all.
    """
    part = F.floor(F.coalesce(F.col("pos"), F.lit(-1)) / part_rows)
    bar = latest_load(bars, list(columns))
    values = materialise(measured(bar.withColumn("_part", part), columns, ["symbol", "_part"]))
    parts = digest_parts(values, ["symbol", "_part", "column"], delta)
    level = parts.withColumn("_part", F.floor(F.col("_part") / fan_in))
    by_symbol = cluster(cluster(level, ["symbol", "column", "_part"], delta), ["symbol", "column"], delta)
    groups = cluster(by_symbol.withColumn("_part", F.pmod(F.xxhash64("symbol"), F.lit(fan_in))), ["_part", "column"], delta)
    every = cluster(groups, ["column"], delta)
    per_symbol = estimates(by_symbol, ["symbol", "column"], quantiles)
    overall = estimates(every, ["column"], quantiles)

    # second pass: each value against its symbol's and the overall estimates
    both = per_symbol.join(overall.select("column", "quantile", F.col("value").alias("_all"), F.col("n").alias("_n_all"), F.col("bound").alias("_bound_all")), ["column", "quantile"])
    one = F.struct("quantile", "value", "n", "bound", "_all", "_n_all", "_bound_all")
    wide = both.groupBy("symbol", "column").agg(F.array_sort(F.collect_list(one)).alias("_e"))
    held = salted_join(values, wide, ["symbol", "column"], "_part")
    k = len(quantiles)
    v = F.col("value")
    sums = [F.count_if(v < F.col("_e")[i]["value"]).alias(f"_b{i}") for i in range(k)]
    sums += [F.count_if(v <= F.col("_e")[i]["value"]).alias(f"_u{i}") for i in range(k)]
    sums += [F.count_if(v < F.col("_e")[i]["_all"]).alias(f"_ab{i}") for i in range(k)]
    sums += [F.count_if(v <= F.col("_e")[i]["_all"]).alias(f"_au{i}") for i in range(k)]
    counted = held.groupBy("symbol", "column").agg(*sums, F.any_value("_e").alias("_e"))
    own = F.array(*[F.struct(F.lit(False).alias("overall"), F.col("_e")[i]["quantile"].alias("quantile"), F.col("_e")[i]["value"].alias("value"), F.col("_e")[i]["n"].alias("n"), F.col("_e")[i]["bound"].alias("bound"), F.col(f"_b{i}").alias("below"), F.col(f"_u{i}").alias("upto")) for i in range(k)])
    total = F.array(*[F.struct(F.lit(True).alias("overall"), F.col("_e")[i]["quantile"].alias("quantile"), F.col("_e")[i]["_all"].alias("value"), F.col("_e")[i]["_n_all"].alias("n"), F.col("_e")[i]["_bound_all"].alias("bound"), F.col(f"_ab{i}").alias("below"), F.col(f"_au{i}").alias("upto")) for i in range(k)])
    flat = counted.select("symbol", "column", F.explode(F.concat(own, total)).alias("x")).select("symbol", "column", "x.*")
    out = flat.groupBy("overall", F.when(F.col("overall"), F.lit(None)).otherwise(F.col("symbol")).alias("symbol"), "column", "quantile").agg(
        F.any_value("value").alias("value"),
        F.any_value("n").alias("n"),
        F.any_value("bound").alias("bound"),
        F.sum("below").alias("_below"),
        F.sum("upto").alias("_upto"),
    )
    error = F.greatest(F.lit(0.0), F.col("quantile") - F.col("_upto") / F.col("n"), F.col("_below") / F.col("n") - F.col("quantile"))
    return out.withColumn("rank_error", error).withColumn("within_bound", F.col("rank_error") <= F.col("bound") + 1e-12).drop("_below", "_upto")
