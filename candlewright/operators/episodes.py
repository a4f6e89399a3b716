"""Compression episodes as a set-reset latch, and their first triggered bar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.blocks import carried
from candlewright.functions.exprs import holds

#: Trigger names, in the order in which they are joined.
TRIGGER_NAMES = ("compression_exit_down", "failed_reclaim", "local_low_break")


def scan_episodes(rows: DataFrame, min_duration: int = 3, exit_confirm: int = 2, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """(keys, episode_start_pos, episode_qualified_pos, episode_end_pos, episode_closed), from bars with streaks.

    A qualifying bar (the streak reaches ``min_duration``) opens an episode if none is open; the episode
    ends at the next bar where ``exit_confirm`` bars in a row lie at or above the threshold, or,
    unclosed, at the last bar of the series.
    """
    qualify = F.col("streak") == min_duration
    leave = F.col("above_run") == exit_confirm
    signals = rows.select(*keys, "pos", "n_bars", qualify.alias("_q"), leave.alias("_e"))
    marked = carried(signals, keys, {"_last_e": F.col("_e")}, {"_next_e": F.col("_e")})
    # of the qualifying bars between two exits (they share the last exit before them) the first opens the episode
    opened = marked.filter("_q").groupBy(*keys, F.coalesce("_last_e", F.lit(-1)).alias("_since")).agg(
        F.min("pos").alias("episode_qualified_pos"), F.min_by("_next_e", "pos").alias("_end"), F.first("n_bars").alias("n_bars")
    )
    return opened.select(
        *keys,
        (F.col("episode_qualified_pos") - (min_duration - 1)).alias("episode_start_pos"),
        "episode_qualified_pos",
        F.coalesce("_end", F.col("n_bars") - 1).alias("episode_end_pos"),
        F.col("_end").isNotNull().alias("episode_closed"),
    )


def bars_of_episodes(episodes: DataFrame, rows: DataFrame, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """Each episode's bars. Episodes of a series don't overlap, so this is at most one row a bar: an equi-join on positions."""
    spread = episodes.withColumn("pos", F.explode(F.sequence("episode_start_pos", "episode_end_pos")))
    return spread.join(rows.drop("n_bars"), [*keys, "pos"])


def episode_table(episodes: DataFrame, rows: DataFrame, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """Episodes with their times, duration, and least, mean and qualifying dispersion (unknown values left out)."""
    at = lambda name: F.max(F.when(F.col("pos") == F.col(name), F.col("timestamp")))
    names = ["episode_start_pos", "episode_qualified_pos", "episode_end_pos", "episode_closed"]
    inside = bars_of_episodes(episodes, rows.select(*keys, "pos", "timestamp", "ma_dispersion_atr"), keys)
    return inside.groupBy(*keys, *names).agg(
        at("episode_start_pos").alias("episode_start_ts"),
        at("episode_qualified_pos").alias("episode_qualified_ts"),
        at("episode_end_pos").alias("episode_end_ts"),
        (F.first("episode_end_pos") - F.first("episode_start_pos") + 1).alias("episode_duration_bars"),
        F.min("ma_dispersion_atr").alias("min_dispersion"),
        F.avg("ma_dispersion_atr").alias("mean_dispersion"),
        F.max(F.when(F.col("pos") == F.col("episode_qualified_pos"), F.col("ma_dispersion_atr"))).alias("qualified_dispersion"),
    )


def add_triggers(rows: DataFrame) -> DataFrame:
    """failed_reclaim, compression_exit_down, local_low_break per bar; a comparison with an unknown value is false."""
    close, lower, thr = F.col("close"), F.col("ma_lower"), F.col("threshold")
    return rows.withColumns(
        {
            "failed_reclaim": holds((F.col("high") >= lower) & (close < lower)) & F.col("slope_down"),
            "compression_exit_down": holds((F.col("prev_dispersion") < thr) & (F.col("ma_dispersion_atr") >= thr) & (close < lower)) & F.col("slope_down"),
            "local_low_break": holds((close < F.col("prior_local_low")) & (close < F.col("cluster_center"))) & F.col("slope_down"),
        }
    )


def anchored_events(episodes: DataFrame, rows: DataFrame, keys: Sequence[str] = ("symbol", "quantile")) -> DataFrame:
    """One event per episode: its first triggered bar from the qualifying bar to the end, both included.

    Episodes without a triggered bar give none. ``rows`` have streaks and triggers.
    """
    needed = rows.select(*keys, "pos", "timestamp", "ma_dispersion_atr", "below", *TRIGGER_NAMES)
    inside = bars_of_episodes(episodes, needed, keys)
    fired = F.col("failed_reclaim") | F.col("compression_exit_down") | F.col("local_low_break")
    ident = [*keys, "episode_start_pos"]
    first = inside.groupBy(*ident).agg(F.min(F.when(fired & (F.col("pos") >= F.col("episode_qualified_pos")), F.col("pos"))).alias("decision_pos")).filter("decision_pos IS NOT NULL")
    upto = inside.join(first, ident).filter(F.col("pos") <= F.col("decision_pos"))
    here = lambda c: F.max(F.when(F.col("pos") == F.col("decision_pos"), F.col(c)))
    disp = here("ma_dispersion_atr")
    events = upto.groupBy(*ident, "episode_qualified_pos", "decision_pos").agg(
        here("timestamp").alias("decision_ts"),
        F.count_if("below").alias("compression_duration_at_decision"),
        *[here(t).cast("int").alias(f"trigger_{t}") for t in TRIGGER_NAMES],
        disp.alias("ma_dispersion_atr_at_decision"),
        F.min("ma_dispersion_atr").alias("episode_min_dispersion_so_far"),
    )
    label = F.concat_ws("+", *[F.when(F.col(f"trigger_{t}") == 1, t) for t in TRIGGER_NAMES])
    return events.withColumns(
        {
            "episode_age_at_decision": F.col("decision_pos") - F.col("episode_start_pos"),
            "trigger_type": label,
            "dispersion_change_from_min": F.col("ma_dispersion_atr_at_decision") - F.col("episode_min_dispersion_so_far"),
            "zone_length": F.col("compression_duration_at_decision"),
        }
    )
