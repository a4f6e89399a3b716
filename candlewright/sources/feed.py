"""Bars from files and from event streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewright.functions.blocks import WEEK_MS, with_positions

PRICES = ["open", "high", "low", "close"]
BAR_COLUMNS = ["ts", *PRICES, "volume"]
CSV_SCHEMA = T.StructType([T.StructField("ts", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in [*PRICES, "volume"]]])


def read_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one CSV file (or folder of them) with a header.

    Columns are found by name; others are ignored. A missing column raises ValueError, text in a
    number column fails the scan. ``ingest_seq`` orders rows by file name and, within a file, as they stand in it.
    """
    header = spark.read.option("header", True).csv(path)
    missing = [c for c in BAR_COLUMNS if c not in header.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    # every value is read as text and cast under ANSI rules, which raise on bad text
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CSV_SCHEMA]
    # splits are read in any order: a row's place is its file's, its split's first byte, and its number within the task, which a split's bytes bound
    plain = lambda path: re.sub(r"^(\w+):/+", r"\1:/", path)  # noqa: E731  a scheme may be followed by one slash or three
    files = F.array(*[F.lit(plain(f)) for f in sorted(header.inputFiles())])
    number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    place = F.shiftleft(F.array_position(files, F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):/+", "$1:/")), 43) + F.col("_metadata.file_block_start") + number
    return header.select(F.lit(symbol).alias("symbol"), *typed, place.alias("ingest_seq"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A cached bar table (Parquet)."""
    return spark.read.parquet(path)


def before(rows: DataFrame, boundary: str | None) -> DataFrame:
    """Rows strictly before ``boundary`` (UTC where it names no zone); applied first, so that it reaches the scan."""
    if boundary is None:
        return rows
    return rows.filter(F.col("ts") < F.unix_millis(F.lit(boundary).cast("timestamp")))


def first_delivery(rows: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """One row per (symbol, ts): the one delivered first."""
    bucketed = rows.withColumn("_b", F.floor(F.col("ts") / WEEK_MS)).repartition("symbol", "_b")
    rank = F.row_number().over(Window.partitionBy("symbol", "_b", "ts").orderBy(order))
    return bucketed.withColumn("_r", rank).filter("_r = 1").drop("_r", "_b")


def sound() -> Column:
    """Does a bar satisfy the bounds: all values known, 0 < low <= open, close <= high, volume >= 0?"""
    known = F.lit(True)
    for c in [*PRICES, "volume"]:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    o, h, lo, c = (F.col(x) for x in PRICES)
    return known & (h >= lo) & (h >= o) & (h >= c) & (lo <= o) & (lo <= c) & (lo > 0) & (F.col("volume") >= 0)


def bars_of_feed(feed: DataFrame, boundary: str | None = None, order: str = "ingest_seq") -> DataFrame:
    """Clean bars of a feed of many series: (symbol, pos, n_bars, ts, timestamp, open, high, low, close, volume).

    The first delivery of a bar counts; bars that break the bounds are left out (``checks`` counts
    them, ``checks.require`` raises on them). Gaps stay gaps: positions count rows, not time.
    """
    rows = before(feed, boundary).filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("symbol", *BAR_COLUMNS, order)
    clean = first_delivery(rows, order).filter(sound()).drop(order)
    return with_positions(clean).withColumn("timestamp", F.timestamp_millis("ts"))


def bars_of_events(events: DataFrame, series: Column, price: Column, minutes: int = 15, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Bars from single events: per series and time slot the first, greatest, least and last price and the count.

    Open and close go by (time, tie). Slots without events give no bar. Partial aggregates are taken
    before the exchange.
    """
    step = minutes * 60_000
    at = F.unix_millis(F.col(time).cast("timestamp"))
    rows = events.select(series.alias("symbol"), (at - F.pmod(at, F.lit(step))).alias("ts"), F.struct(at.alias("a"), F.col(tie).alias("t")).alias("_o"), price.alias("_x"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("_x", "_o").alias("open"),
        F.max("_x").alias("high"),
        F.min("_x").alias("low"),
        F.max_by("_x", "_o").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )
