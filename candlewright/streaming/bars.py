"""Bars, causal means and merged triggers on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, series: Column, price: Column, minutes: int = 15, late: str = "10 minutes", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Bars of a stream of events, final once the watermark has passed a slot; later events are dropped.

    ``time`` may lack a zone (it is taken as UTC): watermarks need one.
    """
    rows = events.select(series.alias("symbol"), F.col(time).cast("timestamp").alias("at"), F.col(tie).alias("_tie"), price.alias("_x")).withWatermark("at", late)
    order = F.struct("at", "_tie")
    slots = rows.groupBy("symbol", F.window("at", f"{minutes} minutes")).agg(
        F.min_by("_x", order).alias("open"), F.max("_x").alias("high"), F.min("_x").alias("low"), F.max_by("_x", order).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return slots.select("symbol", F.unix_millis("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_sessions(triggers: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Triggers (symbol, at) merged while each follows the last within ``gap``: first time and count per session."""
    rows = triggers.withWatermark("at", late)
    return rows.groupBy("symbol", F.session_window("at", gap)).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).drop("session_window")


def stream_mean(bars: DataFrame, span: int = 20) -> DataFrame:
    """Exponential mean of close per symbol over a stream of bars, kept in state: (symbol, ts, close, mean, seen).

    Bars of a micro-batch are taken in order of ts; a bar at or before the last one seen is dropped as
    late, and of two with the same ts the first stands. ``mean`` is NULL until ``span`` bars were seen.
    """
    alpha = 2.0 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, seen, last = state.get if state.exists else (0.0, 0, -(2**62))
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable").drop_duplicates("ts")
        rows = rows[(rows["ts"] > last) & rows["close"].notna()]
        # the state stands for all bars before
        whole = pd.concat([pd.Series([value] if seen else [], dtype="float64"), rows["close"].astype("float64")], ignore_index=True)
        means = whole.ewm(alpha=alpha, adjust=False).mean().to_numpy()[1 if seen else 0 :]
        count = seen + np.arange(1, len(rows) + 1)
        if len(rows):
            value, seen, last = means[-1], count[-1], rows["ts"].iloc[-1]
        state.update((float(value), int(seen), int(last)))
        yield pd.DataFrame({"symbol": key[0], "ts": rows["ts"].to_numpy(), "close": rows["close"].to_numpy(), "mean": np.where(count >= span, means, np.nan), "seen": count})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts bigint, close double, mean double, seen bigint", "value double, seen bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
