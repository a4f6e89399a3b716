"""Data checks over a feed of many series, as one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.blocks import WEEK_MS
from candlewright.functions.exprs import holds
from candlewright.functions.salting import salted_join
from candlewright.sources.feed import PRICES, first_delivery


def _steps(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """First deliveries with their series' step and the time since the bar before (``_gap``), found per time bucket."""
    given = steps.select(F.col("symbol"), (F.col("bar_minutes") * 60_000).cast("bigint").alias("step_ms"))
    bars = first_delivery(rows.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())).withColumn("_b", F.floor(F.col("ts") / WEEK_MS)).repartition("symbol", "_b")
    ends = bars.groupBy("symbol", "_b").agg(F.max("ts").alias("_end"))
    over = Window.partitionBy("symbol").orderBy("_b")
    carry = ends.select("symbol", "_b", F.lag("_end").over(over).alias("_carry"), F.min("_b").over(Window.partitionBy("symbol")).alias("_b0"))
    prev = F.coalesce(F.lag("ts").over(Window.partitionBy("symbol", "_b").orderBy("ts")), F.col("_carry"))
    lagged = bars.join(carry, ["symbol", "_b"]).withColumn("prev_ts", prev)
    return salted_join(lagged, given, "symbol", "ts", how="left").drop("_carry", "_b0", "_b")


def check_report(feed: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a series: row counts, duplicates, NULLs, broken bounds, negative volumes, bars off the grid, gaps, start, end, passed.

    Counts other than rows_raw and duplicates are over first deliveries. The grid phase is that of the
    series' first bar; ``steps`` gives bar_minutes a series (NULL grid and gap counts where it
    does not).
    """
    raw = feed.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    bars = _steps(raw, steps)
    null = F.lit(False)
    for c in [*PRICES, "volume"]:
        null = null | F.col(c).isNull() | holds(F.isnan(c))
    o, h, lo, c = (F.col(x) for x in PRICES)
    bounds = holds(h < lo) | holds(h < o) | holds(h < c) | holds(lo > o) | holds(lo > c) | holds(lo <= 0)
    first = bars.groupBy("symbol").agg(F.min("ts").alias("_first"))
    phased = salted_join(bars, first, "symbol", "ts")
    report = phased.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows_final"),
        F.count_if(null).alias("null_rows"),
        F.count_if(bounds).alias("bound_violations"),
        F.count_if(holds(F.col("volume") < 0)).alias("negative_volumes"),
        F.when(F.max("step_ms").isNotNull(), F.count_if(holds(F.pmod(F.col("ts") - F.col("_first"), F.col("step_ms")) != 0))).alias("off_grid"),
        F.when(F.max("step_ms").isNotNull(), F.count_if(holds(F.col("ts") - F.col("prev_ts") != F.col("step_ms")))).alias("n_gaps"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )
    counts = raw.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_raw"))
    clean = (F.col("null_rows") + F.col("bound_violations") + F.col("negative_volumes") + F.coalesce("off_grid", F.lit(0))) == 0
    return report.join(counts, "symbol").withColumns({"duplicates": F.col("rows_raw") - F.col("rows_final"), "passed": clean})


def gap_census(feed: DataFrame, steps: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` gaps of each series: (symbol, after_ts, before_ts, gap_bars)."""
    bars = _steps(feed, steps).filter(F.col("ts") - F.col("prev_ts") != F.col("step_ms"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    top = bars.withColumn("_r", rank).filter(F.col("_r") <= most)
    return top.select("symbol", F.col("prev_ts").alias("after_ts"), F.col("ts").alias("before_ts"), ((F.col("ts") - F.col("prev_ts")) / F.col("step_ms")).alias("gap_bars"))


def require(report: DataFrame) -> None:
    """Raise ValueError naming what a series failed, as a strict load does."""
    counts = ["null_rows", "bound_violations", "negative_volumes", "off_grid"]
    bad = report.filter("NOT passed").agg(F.count(F.lit(1)).alias("n"), F.min("symbol").alias("s"), *[F.sum(c).alias(c) for c in counts]).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} series fail, {bad['s']} first: " + ", ".join(f"{c} {bad[c] or 0}" for c in counts))
    if report.isEmpty():
        raise ValueError("no rows before the boundary")
