"""Thresholds, streaks, scan triggers, and strict platforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import carried
from candlewright.functions.exprs import holds, ratio
from candlewright.functions.ranks import exact_quantiles
from candlewright.functions.salting import salted_join

TRIGGERS = ("zone_start", "dispersion_exit", "price_breakout")


def freeze_thresholds(bars: DataFrame, train_end: Column, quantiles: Sequence[float], keys: Sequence[str] = ("symbol",), digits: int | None = None) -> DataFrame:
    """(keys, quantile, threshold, n_train): exact quantiles of ma_dispersion_atr over positions before ``train_end``.

    Missing values are left out; a series without any has no row.
    """
    train = bars.filter(F.col("pos") < train_end).select(*keys, "ma_dispersion_atr")
    q = exact_quantiles(train, keys, "ma_dispersion_atr", quantiles)
    threshold = F.col("value") if digits is None else F.round("value", digits)
    return q.select(*keys, F.col("q").alias("quantile"), threshold.alias("threshold"), F.col("n").alias("n_train"))


def with_thresholds(bars: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every bar once for each threshold of its series (``keys``); extra columns of ``thresholds`` come along."""
    return salted_join(bars, thresholds, keys, "pos")


def add_streaks(rows: DataFrame, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """below, above; streak and above_run (bars in a row up to this one), prev_streak (streak at the bar before).

    Unknown dispersion is neither below nor above, and ends both runs. All come from positions
    where runs break.
    """
    disp, thr = F.col("ma_dispersion_atr"), F.col("threshold")
    below, above = holds(disp < thr), holds(disp >= thr)
    before = holds(F.col("prev_dispersion") < thr)
    flagged = rows.withColumns({"below": below, "above": above, "_before": before})
    marked = carried(flagged, keys, {"_nb": ~F.col("below"), "_na": ~F.col("above"), "_nb1": ~F.col("_before")})
    pos = F.col("pos")
    # the run ending at the bar before began after the last bar whose predecessor was not below
    return marked.withColumns(
        {
            "streak": (pos - F.coalesce("_nb", F.lit(-1))).cast("bigint"),
            "above_run": (pos - F.coalesce("_na", F.lit(-1))).cast("bigint"),
            "prev_streak": F.when(F.col("_before"), pos - F.coalesce("_nb1", F.lit(0))).otherwise(0).cast("bigint"),
        }
    ).drop("_nb", "_na", "_nb1", "_before")


def candidates(rows: DataFrame, trigger: str, min_duration: int = 3) -> DataFrame:
    """Raw candidate bars of one trigger with the zone length confirmed at each (``rows`` have streaks)."""
    long_before = F.col("prev_streak") >= min_duration
    if trigger == "zone_start":
        return rows.filter(F.col("streak") >= min_duration).withColumn("zone_length", F.col("streak"))
    if trigger == "dispersion_exit":
        return rows.filter(F.col("above") & long_before).withColumn("zone_length", F.col("prev_streak"))
    if trigger == "price_breakout":
        outside = holds((F.col("close") > F.col("ma_upper")) | (F.col("close") < F.col("ma_lower")))
        return rows.filter(outside & long_before).withColumn("zone_length", F.col("prev_streak"))
    raise ValueError(f"unknown trigger {trigger!r}")


def merge_close(raw: DataFrame, cooldown: int = 5, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """Candidates with ``kept``: the first of each group whose bars follow each other within ``cooldown``.

    Every raw candidate extends its group. The candidate before is found from block to block.
    """
    ends = raw.groupBy(*keys, F.floor(F.col("pos") / 8192).alias("_blk")).agg(F.max("pos").alias("_end"))
    over = Window.partitionBy(*keys).orderBy("_blk")
    carry = ends.select(*keys, "_blk", F.lag("_end").over(over).alias("_carry"))
    blk = raw.withColumn("_blk", F.floor(F.col("pos") / 8192))
    inside = Window.partitionBy(*keys, "_blk").orderBy("pos")
    prev = F.coalesce(F.lag("pos").over(inside), F.col("_carry"))
    return blk.join(carry, [*keys, "_blk"]).withColumn("kept", prev.isNull() | (F.col("pos") - prev > cooldown)).drop("_blk", "_carry")


def scan(rows: DataFrame, trigger: str, min_duration: int = 3, cooldown: int = 5, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """Events of one trigger: keys, trigger, decision_pos, decision_ts, zone_length."""
    kept = merge_close(candidates(rows, trigger, min_duration), cooldown, keys).filter("kept")
    return kept.select(*keys, F.lit(trigger).alias("trigger"), F.col("pos").alias("decision_pos"), F.col("timestamp").alias("decision_ts"), "zone_length")


def scan_all(rows: DataFrame, min_duration: int = 3, cooldown: int = 5, keys: Sequence[str] = ("symbol", "quantile"), triggers: Sequence[str] = TRIGGERS) -> DataFrame:
    """``scan`` of several triggers in one pass over the bars."""
    long_before = F.col("prev_streak") >= min_duration
    outside = holds((F.col("close") > F.col("ma_upper")) | (F.col("close") < F.col("ma_lower")))
    tests = {
        "zone_start": (F.col("streak") >= min_duration, F.col("streak")),
        "dispersion_exit": (F.col("above") & long_before, F.col("prev_streak")),
        "price_breakout": (outside & long_before, F.col("prev_streak")),
    }
    hit = [F.when(tests[t][0], F.struct(F.lit(t).alias("t"), tests[t][1].alias("z"))) for t in triggers]
    raw = rows.select(*keys, "pos", "timestamp", F.explode(F.array_compact(F.array(*hit))).alias("_h")).select(*keys, F.col("_h.t").alias("trigger"), "pos", "timestamp", F.col("_h.z").alias("zone_length"))
    kept = merge_close(raw, cooldown, [*keys, "trigger"]).filter("kept")
    return kept.select(*keys, "trigger", F.col("pos").alias("decision_pos"), F.col("timestamp").alias("decision_ts"), "zone_length")


def scan_stats(rows: DataFrame, trigger: str, min_duration: int = 3, cooldown: int = 5, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """(keys, trigger, raw_candidate_count, dedup_event_count); series without a candidate are absent."""
    merged = merge_close(candidates(rows, trigger, min_duration), cooldown, keys)
    return merged.groupBy(*keys).agg(F.lit(trigger).alias("trigger"), F.count(F.lit(1)).alias("raw_candidate_count"), F.count_if("kept").alias("dedup_event_count"))


def platforms(rows: DataFrame, keys: Sequence[str] = ("symbol", "quantile"), least: int = 4, most: int = 12, max_range: float = 3.0, max_drift: float = 0.5) -> DataFrame:
    """Maximal runs of bars below the threshold, each with the first reason that rejects it (NULL = accepted).

    Reasons in order: too_short, too_long, range (height in ATRs of the last bar), drift (of the 20-bar mean). An
    unknown ATR rejects for neither, as no comparison holds.
    """
    start = F.col("pos") - F.col("streak") + 1
    runs = rows.filter("below").groupBy(*keys, start.alias("core_start")).agg(
        F.max("pos").alias("core_end"),
        F.count(F.lit(1)).alias("core_len"),
        F.max("high").alias("_hi"),
        F.min("low").alias("_lo"),
        F.max_by("atr_14", "pos").alias("_atr"),
        F.max_by("sma_20", "pos").alias("_s1"),
        F.min_by("sma_20", "pos").alias("_s0"),
        F.min("ma_dispersion_atr").alias("min_dispersion"),
        F.max_by("timestamp", "pos").alias("end_ts"),
    )
    sized = runs.withColumns({"range_atr": ratio(F.col("_hi") - F.col("_lo"), F.col("_atr")), "sma20_drift_atr": ratio(F.abs(F.col("_s1") - F.col("_s0")), F.col("_atr"))})
    reason = (
        F.when(F.col("core_len") < least, "too_short")
        .when(F.col("core_len") > most, "too_long")
        .when(holds(F.col("range_atr") >= max_range), "range")
        .when(holds(F.col("sma20_drift_atr") >= max_drift), "drift")
    )
    return sized.withColumn("reject", reason).drop("_hi", "_lo", "_atr", "_s0", "_s1")


def evenly_spaced(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """At most ``k`` rows evenly spaced along ``order``: places floor(i (n - 1) / (k - 1)), i = 0..k-1.

    Rows are numbered by range partition, the counts of which reach the driver (one number a partition).
    """
    from candlewright.functions.numbering import number_rows

    numbered, n = number_rows(rows, order)
    take = min(k, n)
    wanted = sorted({i * (n - 1) // (take - 1) for i in range(take)}) if take > 1 else [0] * (n > 0)
    return numbered.filter(F.col("_number").isin(wanted)).drop("_number")
