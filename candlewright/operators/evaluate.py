"""Ranking evaluation: group statistics, top fractions, correlations, matched random controls, pooling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.ranks import correlation, exact_quantiles, top_ranked
from candlewright.functions.salting import salted_join
from candlewright.operators.outcomes import at_positions


def group_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and median utility, mean mfe, mae, gross and net, share of positive net returns, per group."""
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg("short_utility").alias("mean_short_utility"),
        F.avg("mfe_short").alias("mean_mfe"),
        F.avg("mae_short").alias("mean_mae"),
        F.avg("gross_return").alias("mean_gross_return"),
        F.avg("net_return").alias("mean_net_return"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("positive_net_return_ratio"),
    )
    medians = exact_quantiles(rows, keys, "short_utility", [0.5]).select(*keys, F.col("value").alias("median_short_utility"))
    return stats.join(medians, list(keys), "left")


def quartiles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, median, p25, p75) of the known values."""
    q = exact_quantiles(rows, keys, value, [0.25, 0.5, 0.75]).groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == x, F.col("value"))).alias(n) for x, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))]
    )
    means = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return means.join(q, list(keys), "left")


def top_groups(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], fractions: Sequence[float] = (0.1, 0.2)) -> DataFrame:
    """Rows tagged with the overlapping groups they belong to: top_10pct, top_20pct (at least one row each), all."""
    ranked = top_ranked(rows, keys, score, tie, "_place")
    tags = [F.when(F.col("_place") <= F.greatest(F.lit(1), F.ceil(F.col("_place_n") * F.lit(f))), f"top_{round(f * 100)}pct") for f in fractions]
    tagged = ranked.withColumn("grp", F.explode(F.array_compact(F.array(*tags, F.lit("all")))))
    return tagged.drop("_place", "_place_n")


def evaluate_score(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(correlations with short_utility, group statistics of the top fractions); groups under ``least`` rows are left out."""
    corr = correlation(rows, keys, score, "short_utility").filter(F.col("n") >= least)
    return corr, group_stats(top_groups(rows, keys, score, tie), [*keys, "grp"])


def with_p_values(correlations: DataFrame, columns: Sequence[str] = ("pearson", "spearman")) -> DataFrame:
    """Two-sided p-values of correlations under Student's t with n - 2 degrees of freedom, by the regularised incomplete beta.

    p = I(x; (n - 2) / 2, 1 / 2) with x = 1 - r^2, by its continued fraction, vectorised over the few
    result rows; NULL below three rows, 0 for |r| = 1.
    """

    @F.pandas_udf("double")
    def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
        from math import exp, lgamma, log

        def one(rv: float, nv: float) -> float | None:
            if rv is None or np.isnan(rv) or nv < 3:
                return None
            x, a, b = 1 - rv * rv, (nv - 2) / 2, 0.5
            if x <= 0:
                return 0.0
            if x >= 1:
                return 1.0
            front = lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)
            if x > (a + 1) / (a + b + 2):
                return 1 - exp(front) * fraction(1 - x, b, a) / b
            return exp(front) * fraction(x, a, b) / a

        def fraction(x: float, a: float, b: float) -> float:
            tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
            d = 1 / (d if abs(d) > tiny else tiny)
            h = d
            for m in range(1, 500):
                for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d = 1 + num * d
                    c = 1 + num / c
                    d = 1 / (d if abs(d) > tiny else tiny)
                    c = c if abs(c) > tiny else tiny
                    h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h

        return pd.Series([one(x, y) for x, y in zip(r, n)], dtype="float64")

    return correlations.withColumns({f"{c}_p": p_value(F.col(c), F.col("n")) for c in columns})


def draw_hash(pos: Column, draw: Column, seed: int) -> Column:
    """A number from the first 32 bits of an md5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", pos.cast("string"), draw.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


def matched_control(
    bars: DataFrame,
    events: DataFrame,
    horizon: int,
    lo: Column,
    hi: Column,
    label_columns: Sequence[str],
    period: str = "yyyy-MM",
    draws: int = 20,
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """``draws`` random bars for each event, from its bucket: month and ATR tercile of its series' pool.

    ``bars`` have labels and the bounds' columns; the pool is positions in [lo, min(hi, n_bars - horizon - 1))
    with a positive ATR. An event whose bucket is empty draws from the whole pool of its series
    (fallback). Returns symbol, event_pos, draw, decision_pos, fallback and the labels: exactly
    ``draws`` rows an event, unless the pool is empty.

    Pool rows are numbered by (bucket, hash) ranks from exact counts, and a draw picks a number, so
    no bucket is gathered. Draws join on (bucket, number).
    """
    pool = bars.filter((F.col("pos") >= lo) & (F.col("pos") < F.least(hi, F.col("n_bars") - horizon - 1)) & (F.col("atr_14") > 0))
    pool = pool.withColumn("_period", F.date_format("timestamp", period))
    cuts = exact_quantiles(pool, ["symbol"], "atr_14", [1 / 3, 2 / 3])
    value = F.col("value") if digits is None else F.round("value", digits)
    cuts = cuts.groupBy("symbol").agg(F.min(value).alias("_t1"), F.max(value).alias("_t2"))
    tercile = F.when(F.col("atr_14") < F.col("_t1"), 0).when(F.col("atr_14") < F.col("_t2"), 1).otherwise(2)
    pool = salted_join(pool, cuts, "symbol", "pos").withColumn("_ter", tercile)
    both = F.explode(F.array(F.struct(F.col("_period").alias("p"), F.col("_ter").alias("t")), F.struct(F.lit("*").alias("p"), F.lit(-1).alias("t"))))
    tagged = pool.select("symbol", "pos", both.alias("_g")).select("symbol", "pos", F.col("_g.p").alias("_period"), F.col("_g.t").alias("_ter"))
    # numbered along pos in blocks of positions
    blk = tagged.withColumn("_blk", F.floor(F.col("pos") / 8192))
    counts = blk.groupBy("symbol", "_period", "_ter", "_blk").agg(F.count(F.lit(1)).alias("_k"))
    over = Window.partitionBy("symbol", "_period", "_ter")
    offsets = counts.select("symbol", "_period", "_ter", "_blk", F.coalesce(F.sum("_k").over(over.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    sizes = counts.groupBy("symbol", "_period", "_ter").agg(F.sum("_k").alias("_size"))
    inside = Window.partitionBy("symbol", "_period", "_ter", "_blk").orderBy("pos")
    numbered = blk.join(offsets, ["symbol", "_period", "_ter", "_blk"]).withColumn("_number", F.col("_off") + F.row_number().over(inside) - 1).drop("_blk", "_off")

    at = at_positions(events.select("symbol", "decision_pos"), bars, ["timestamp", "atr_14"]).join(cuts, "symbol")
    placed = at.select("symbol", F.col("decision_pos").alias("event_pos"), F.date_format("timestamp", period).alias("_period"), tercile.alias("_ter"))
    own_size = placed.join(sizes, ["symbol", "_period", "_ter"], "left")
    fallback = F.col("_size").isNull()
    wanted = own_size.select("symbol", "event_pos", F.when(fallback, "*").otherwise(F.col("_period")).alias("_period"), F.when(fallback, -1).otherwise(F.col("_ter")).alias("_ter"), fallback.alias("fallback"))
    drawn = wanted.join(sizes, ["symbol", "_period", "_ter"]).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picked = drawn.withColumn("_number", F.pmod(draw_hash(F.col("event_pos"), F.col("draw"), seed), F.col("_size")))
    chosen = picked.join(numbered, ["symbol", "_period", "_ter", "_number"]).select("symbol", "event_pos", "draw", F.col("pos").alias("decision_pos"), "fallback")
    return at_positions(chosen, bars, label_columns)


def control_report(control: DataFrame, events: DataFrame, draws: int = 20) -> DataFrame:
    """Requested, actual, unique and repeated draws and events that fell back, per series."""
    asked = events.groupBy("symbol").agg((F.count(F.lit(1)) * draws).alias("requested_sample_count"))
    got = control.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("actual_sample_count"),
        F.count_distinct("decision_pos").alias("unique_decision_pos_count"),
        F.count_distinct(F.when(F.col("fallback"), F.col("event_pos"))).alias("n_fallback_events"),
    )
    both = asked.join(got, "symbol", "left").na.fill(0, ["actual_sample_count", "unique_decision_pos_count", "n_fallback_events"])
    return both.withColumn("duplicate_draw_count", F.col("actual_sample_count") - F.col("unique_decision_pos_count"))


def pool_folds(scored: DataFrame, score: str, control_means: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One row a cell: events, weighted and pooled correlations, top-fraction and overall returns, control return, edges in basis points.

    Top fractions are taken within each fold; folds without a control are left out of the control's mean.
    """
    ties = ["symbol", "decision_pos"]
    per_fold = correlation(scored, [*cell, "fold"], score, "short_utility")
    weighted = per_fold.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_folds_used"),
        F.sum("n").alias("n_oos_events"),
        F.try_divide(F.sum(F.col("spearman") * F.col("n")), F.sum(F.when(F.col("spearman").isNotNull(), F.col("n")))).alias("weighted_mean_spearman"),
    )
    pooled = correlation(scored, cell, score, "short_utility").select(*cell, F.col("spearman").alias("pooled_spearman"))
    groups = top_groups(scored, [*cell, "fold"], score, ties).groupBy(*cell).agg(
        *[F.avg(F.when(F.col("grp") == g, F.col("gross_return"))).alias(f"gross_{g}") for g in ("top_10pct", "top_20pct", "all")]
    )
    control = control_means.filter(F.col("control_gross").isNotNull() & (F.col("control_n") > 0)).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_folds_with_control"), (F.sum(F.col("control_gross") * F.col("control_n")) / F.sum("control_n")).alias("control_mean_gross_return")
    )
    out = weighted.join(pooled, list(cell), "left").join(groups, list(cell), "left").join(control, list(cell), "left")
    return out.withColumns(
        {
            "edge_all_vs_control_bp": (F.col("gross_all") - F.col("control_mean_gross_return")) * 1e4,
            "edge_top10_vs_control_bp": (F.col("gross_top_10pct") - F.col("control_mean_gross_return")) * 1e4,
        }
    )


def percent_rank(rows: DataFrame, keys: Sequence[str], score: str, out: str = "score_pct") -> DataFrame:
    """Average rank of the score over the group's size."""
    from candlewright.functions.ranks import with_average_rank

    return with_average_rank(rows, keys, score, "_r").withColumn(out, F.col("_r") / F.col("_r_n")).drop("_r", "_r_n")


def review_sets(rows: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], top: int = 50, middle: int = 50, bottom: int = 50, seed: int = 42) -> DataFrame:
    """Rows of the top, bottom and random-middle sets per group, with ``review_set`` and ``place``.

    The bottom takes at most what the top leaves; the middle excludes both and is the least by a seeded md5.
    """
    ranked = top_ranked(rows, keys, score, tie, "place")
    n, place = F.col("place_n"), F.col("place")
    in_top = place <= F.least(F.lit(top), n)
    in_bottom = place > n - F.least(F.lit(bottom), F.greatest(F.lit(0), n - top))
    named = ranked.withColumn("review_set", F.when(in_top, "top").when(in_bottom, "bottom").otherwise("middle"))
    ends = named.filter("review_set <> 'middle'")
    key = F.md5(F.concat_ws("|", *[F.col(t).cast("string") for t in tie], F.lit(str(seed))))
    rest = named.filter("review_set = 'middle'").withColumn("_h", key)
    mid = rest.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h", *tie))).filter(F.col("_r") <= middle)
    return ends.unionByName(mid.drop("_h", "_r")).drop("place_n")


def widened_pool(rows: DataFrame, keys: Sequence[str], need: int) -> DataFrame:
    """Rows to choose review sets from, per group, with ``pool``: the test rows, with those of val where they are under ``need``, and with those of train where that is still too few."""
    n = {s: F.count_if(F.col("split") == s).alias(f"_n_{s}") for s in ("test", "val")}
    sizes = rows.groupBy(*keys).agg(*n.values())
    pool = F.when(F.col("_n_test") >= need, "test").when(F.col("_n_test") + F.col("_n_val") >= need, "val+test").otherwise("train+val+test")
    named = salted_join(rows.withColumn("_spread", F.xxhash64("decision_pos")), sizes.select(*keys, pool.alias("pool")), keys, "_spread", salts=8).drop("_spread")
    return named.filter(F.array_contains(F.split("pool", r"\+"), F.col("split")))


#: A group of fewer rows is flagged; a control pool of fewer bars is an error.
FEW, LEAST_POOL = 10, 100


def with_few_flag(stats: DataFrame, count: str = "sample_count") -> DataFrame:
    """Group statistics with ``few``: are they of under ``FEW`` rows?"""
    return stats.withColumn("few", F.col(count) < FEW)


def pool_sizes(bars: DataFrame, horizon: int, lo: Column, hi: Column) -> DataFrame:
    """(symbol, pool, enough): bars that ``matched_control`` may draw from, and whether they reach ``LEAST_POOL``."""
    inside = bars.filter((F.col("pos") >= lo) & (F.col("pos") < F.least(hi, F.col("n_bars") - horizon - 1)) & (F.col("atr_14") > 0))
    sizes = bars.select("symbol").distinct().join(inside.groupBy("symbol").agg(F.count(F.lit(1)).alias("pool")), "symbol", "left")
    return sizes.select("symbol", F.coalesce("pool", F.lit(0)).alias("pool"), (F.coalesce("pool", F.lit(0)) >= LEAST_POOL).alias("enough"))


def cost_sweep(rows: DataFrame, keys: Sequence[str], costs: Sequence[float]) -> DataFrame:
    """Mean net return and share of positive ones at each cost."""
    spread = rows.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
    net = F.col("gross_return") - F.col("cost")
    return spread.groupBy(*keys, "cost").agg(F.count(F.lit(1)).alias("n"), F.avg(net).alias("mean_net_return"), F.avg((net > 0).cast("double")).alias("positive_ratio"))


def context_bars(events: DataFrame, bars: DataFrame, before: int = 119, after: int = 24) -> DataFrame:
    """Bars of each event from ``before`` bars earlier to ``after`` later, within the series, with their offset: an equi-join on positions."""
    span = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("decision_pos") - before), F.col("decision_pos") + after)
    wanted = events.select("symbol", "decision_pos", F.explode(span).alias("pos"))
    return wanted.join(bars, ["symbol", "pos"]).withColumn("offset", F.col("pos") - F.col("decision_pos"))
