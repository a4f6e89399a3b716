"""Causal indicators, the moving-average cluster, and the features built on both."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from candlewright.functions.blocks import BLOCK, blocked, own, series_window
from candlewright.functions.exprs import flag, full, holds, ratio, row_median

# Periods, warm-up and feature names of the published definition.
MA_PERIODS = (20, 60, 120)
ATR_PERIOD = 14
FEATURE_MAX_LOOKBACK = 139
MA_COLUMNS = [f"{k}_{n}" for n in MA_PERIODS for k in ("sma", "ema")]
FEATURES = [
    "ma_dispersion_atr",
    "ma_dispersion_mean_5",
    "ma_dispersion_min_10",
    "ma_dispersion_slope_5",
    "compression_duration",
    "ema20_slope_5",
    "sma20_slope_5",
    "ema60_slope_10",
    "sma120_slope_20",
    "short_long_slope_gap",
    "close_to_cluster_atr",
    "close_above_cluster_ratio_10",
    "close_below_cluster_ratio_10",
    "close_inside_cluster_ratio_10",
    "cluster_penetration_count_10",
    "failed_reclaim_count_10",
    "max_consecutive_close_above_10",
    "return_20",
    "return_60",
    "linear_slope_60",
    "distance_from_high_60_atr",
    "price_location_in_range_60",
    "body_ratio",
    "range_atr",
    "atr_ratio_5_20",
    "volume_zscore_20",
    "distance_to_low_20_atr",
]

#: Bars after which the oldest term of the longest exponential mean has a weight below 2 ** -60.
MEMORY = math.ceil(-60 * math.log(2) / math.log(1 - 2 / (max(MA_PERIODS) + 1)))
#: What a block must see of the bars before it: the means' memory and the features' look-back.
BACK = MEMORY + FEATURE_MAX_LOOKBACK + 21


def exponential_mean(x: Column, alpha: float, seed_pos: int, w: WindowSpec, size: int = BLOCK, back: int = BACK) -> Column:
    """e(t) = (1 - alpha) e(t-1) + alpha x(t), started by x at ``seed_pos``, as one running sum a block.

    With r = 1 - alpha, e(t) = r^t * sum of w_i x_i r^-i; exponents are taken from the middle of a block and its
    margin, which keeps them within a double's range (checked here). What lies
    before a block's margin has no weight a double could show.
    """
    r = 1.0 - alpha
    middle = F.col("_blk") * size + (size - back) // 2
    if (size + back) / 2 * -math.log(r) > 600:
        raise ValueError("alpha too large for this block size")
    i = (F.col("pos") - middle).cast("double")
    weight = F.when(F.col("pos") == seed_pos, 1.0).otherwise(alpha)
    past = F.sum(F.when(F.col("pos") >= seed_pos, weight * x * F.pow(F.lit(r), -i))).over(w.rowsBetween(w_unbounded, 0))
    return past * F.pow(F.lit(r), i)


w_unbounded = -(2**63)


def add_indicators(rows: DataFrame, w: WindowSpec, size: int = BLOCK, back: int = BACK) -> DataFrame:
    """sma, ema (20, 60, 120), tr, atr_14, tr_mean_5, tr_mean_20 on blocked rows; NULL during warm-up."""
    close, pos = F.col("close"), F.col("pos")
    prev = F.lag("close").over(w)
    tr = F.when(prev.isNotNull() & (pos > 0), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    first = rows.withColumn("tr", tr)
    columns = {}
    for n in MA_PERIODS:
        columns[f"sma_{n}"] = full(F.avg, close, n, w)
        columns[f"ema_{n}"] = F.when(pos >= n - 1, exponential_mean(close, 2 / (n + 1), 0, w, size, back))
    columns["atr_14"] = F.when(pos >= ATR_PERIOD, exponential_mean(F.col("tr"), 1 / ATR_PERIOD, 1, w, size, back))
    columns["tr_mean_5"] = full(F.avg, F.col("tr"), 5, w)
    columns["tr_mean_20"] = full(F.avg, F.col("tr"), 20, w)
    return first.withColumns(columns)


def add_cluster(rows: DataFrame) -> DataFrame:
    """ma_upper, ma_lower, cluster_center over the means that exist, and their distance in ATRs."""
    mas = [F.col(c) for c in MA_COLUMNS]
    banded = rows.withColumns({"ma_upper": F.greatest(*mas), "ma_lower": F.least(*mas), "cluster_center": row_median(*mas)})
    return banded.withColumn("ma_dispersion_atr", ratio(F.col("ma_upper") - F.col("ma_lower"), F.col("atr_14")))


def add_features(rows: DataFrame, w: WindowSpec) -> DataFrame:
    """All features but compression_duration, which depends on a threshold (see ``islands``)."""
    close, atr, disp, center = F.col("close"), F.col("atr_14"), F.col("ma_dispersion_atr"), F.col("cluster_center")
    lower, upper, high, low, volume = F.col("ma_lower"), F.col("ma_upper"), F.col("high"), F.col("low"), F.col("volume")
    slope = lambda c, k: ratio(F.col(c) - F.lag(c, k).over(w), atr)
    share = lambda p: full(F.avg, flag(holds(p)), 10, w)
    side = F.signum(close - center)
    base = rows.withColumns(
        {
            "_side": side,
            "_run": F.col("pos") - F.coalesce(F.max(F.when(~holds(close > center), F.col("pos"))).over(w.rowsBetween(w_unbounded, 0)), F.min("pos").over(w.rowsBetween(w_unbounded, 0)) - 1),
            "_high60": full(F.max, high, 60, w),
            "_low60": full(F.min, low, 60, w),
            "_low20": full(F.min, low, 20, w),
        }
    )
    crossed = flag(holds(F.col("_side") * F.lag("_side").over(w) < 0))
    base = base.withColumn("_crossed", crossed)
    runs = F.collect_list("_run").over(w.rowsBetween(-9, 0))
    deviation = F.stddev_pop("volume").over(w.rowsBetween(-19, 0))
    made = base.withColumns(
        {
            "ma_dispersion_mean_5": full(F.avg, disp, 5, w),
            "ma_dispersion_min_10": full(F.min, disp, 10, w),
            "ma_dispersion_slope_5": disp - F.lag(disp, 5).over(w),
            "ema20_slope_5": slope("ema_20", 5),
            "sma20_slope_5": slope("sma_20", 5),
            "ema60_slope_10": slope("ema_60", 10),
            "sma120_slope_20": slope("sma_120", 20),
            "close_to_cluster_atr": ratio(close - center, atr),
            "close_above_cluster_ratio_10": share(close > center),
            "close_below_cluster_ratio_10": share(close < center),
            "close_inside_cluster_ratio_10": share((close >= lower) & (close <= upper)),
            "cluster_penetration_count_10": full(F.sum, F.col("_crossed"), 10, w),
            "failed_reclaim_count_10": full(F.sum, flag(holds((high >= lower) & (close < center))), 10, w),
            "max_consecutive_close_above_10": F.when(F.size(runs) == 10, F.array_max(F.transform(runs, lambda s, i: F.least(s, i + 1)))).cast("double"),
            "return_20": ratio(close, F.lag("close", 20).over(w)) - 1,
            "return_60": ratio(close, F.lag("close", 60).over(w)) - 1,
            "linear_slope_60": ratio(F.when(F.count(close).over(w.rowsBetween(-59, 0)) == 60, F.regr_slope(close, F.col("pos")).over(w.rowsBetween(-59, 0))), atr),
            "distance_from_high_60_atr": ratio(F.col("_high60") - close, atr),
            "price_location_in_range_60": ratio(close - F.col("_low60"), F.col("_high60") - F.col("_low60")),
            "body_ratio": ratio(F.abs(close - F.col("open")), high - low),
            "range_atr": ratio(high - low, atr),
            "atr_ratio_5_20": ratio(F.col("tr_mean_5"), F.col("tr_mean_20")),
            "volume_zscore_20": F.when(F.count(volume).over(w.rowsBetween(-19, 0)) == 20, ratio(volume - F.avg("volume").over(w.rowsBetween(-19, 0)), deviation)),
            "distance_to_low_20_atr": ratio(close - F.col("_low20"), atr),
        }
    )
    return made.withColumn("short_long_slope_gap", F.col("ema20_slope_5") - F.col("sma120_slope_20")).drop("_side", "_run", "_high60", "_low60", "_low20", "_crossed")


def add_trigger_inputs(rows: DataFrame, w: WindowSpec, local_low_window: int = 10) -> DataFrame:
    """What triggers need of earlier bars: prev_dispersion, slope_down, prior_local_low (the current bar left out)."""
    return rows.withColumns(
        {
            "prev_dispersion": F.lag("ma_dispersion_atr").over(w),
            "slope_down": holds(F.col("ema_20") < F.lag("ema_20", 5).over(w)),
            "prior_local_low": full(F.min, F.col("low"), local_low_window, w, before=1),
        }
    )


def add_outcomes(rows: DataFrame, w: WindowSpec, horizon: int) -> DataFrame:
    """What labels need of later bars: next_open, least low, greatest high and last close of the next ``horizon`` bars."""
    frame = w.rowsBetween(1, horizon)
    return rows.withColumns(
        {
            "next_open": F.lead("open").over(w),
            "future_low": F.min("low").over(frame),
            "future_high": F.max("high").over(frame),
            "future_close": F.lead("close", horizon).over(w),
        }
    )


def wide_bars(bars: DataFrame, horizon: int = 24, local_low_window: int = 10, features: bool = True, digits: int | None = None) -> DataFrame:
    """Bars with every indicator, feature, trigger input and outcome: one exchange, however long a series is.

    ``digits`` rounds ma_dispersion_atr, for comparisons across engines.
    """
    w = series_window()
    rows = add_cluster(add_indicators(blocked(bars, BACK, max(horizon, 1)), w))
    rows = add_outcomes(add_trigger_inputs(rows, w, local_low_window), w, horizon)
    rows = own(add_features(rows, w) if features else rows)
    if digits is None:
        return rows
    return rows.withColumns({c: F.round(c, digits) for c in ("ma_dispersion_atr", "prev_dispersion")})
