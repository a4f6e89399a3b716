"""Samples that follow target proportions, from mergeable per-bucket reservoirs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.session import materialise

#: Reservoirs of so many partitions at most meet in one task before the last step.
LANES = 64
_PART = "bucket_id bigint, pos bigint, priority bigint, quota bigint, n bigint"


def bucket_pool(bars: DataFrame, targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """(bucket_id, symbol, pos): the distinct bars each bucket may draw from.

    A bar belongs to a bucket by symbol, month of ``timestamp`` and atr_lo <= atr_14 < atr_hi (a NULL
    or NaN bound is open), has atr_14 > 0 (not NaN), and is no decision of the symbol. Bars loaded twice
    count once. One exchange of the bars that fall in some bucket, on (symbol, pos).
    """
    bar = bars.select(
        F.col("symbol").alias("symbol"),
        F.col("pos").alias("pos"),
        F.date_format("timestamp", "yyyy-MM").alias("_month"),
        F.col("atr_14").alias("_atr"),
    ).filter((F.col("_atr") > 0) & ~F.isnan("_atr") & F.col("pos").isNotNull())
    want = targets.select(
        F.col("symbol").alias("_s"),
        F.col("month").alias("_m"),
        F.nanvl(F.col("atr_lo"), F.lit(None).cast("double")).alias("_lo"),
        F.nanvl(F.col("atr_hi"), F.lit(None).cast("double")).alias("_hi"),
        "bucket_id",
    )
    fits = (
        (F.col("symbol") == F.col("_s"))
        & (F.col("_month") == F.col("_m"))
        & F.coalesce(F.col("_atr") >= F.col("_lo"), F.lit(True))
        & F.coalesce(F.col("_atr") < F.col("_hi"), F.lit(True))
    )
    pool = bar.join(want, fits).select("bucket_id", "symbol", "pos").repartition("symbol", "pos")
    decided = decisions.select("symbol", F.col("decision_pos").alias("pos")).distinct()
    return pool.distinct().join(decided, ["symbol", "pos"], "left_anti").select("bucket_id", "symbol", "pos")


def _reservoirs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket of one partition: the ``quota`` rows of least priority (n 0), and one row with the count n (priority -1).

    Takes pool rows (n 1) and earlier reservoirs alike: they merge by keeping the least priorities of
    their union and adding counts. What is held is cut down whenever twice its volume has come in.
    """
    kept: list[pd.DataFrame] = []
    counts: dict[int, int] = {}
    rows = limit = 0

    def trim(parts: list[pd.DataFrame]) -> pd.DataFrame:
        every = pd.concat(parts, ignore_index=True).sort_values(["bucket_id", "priority", "pos"], kind="stable", ignore_index=True)
        return every[every.groupby("bucket_id").cumcount() < every["quota"]]

    for pdf in batches:
        ids, at = np.unique(pdf["bucket_id"].to_numpy(), return_inverse=True)
        for i, k in zip(ids, np.bincount(at, pdf["n"].to_numpy())):
            counts[i] = counts.get(i, 0) + int(k)
        kept.append(pdf[pdf["priority"] >= 0])
        rows += len(kept[-1])
        if rows > max(limit, 100_000):
            kept = [trim(kept)]
            rows = len(kept[0])
            limit = 2 * rows
    if kept:
        yield trim(kept).assign(n=0)
        ids = list(counts)
        yield pd.DataFrame({"bucket_id": ids, "pos": 0, "priority": -1, "quota": 0, "n": [counts[i] for i in ids]})


def priority(symbol: Column, pos: Column, seed: int) -> Column:
    """60 bits of an md5 of seed, symbol and pos: the same in every bucket, run and engine."""
    text = F.concat_ws("|", F.lit(str(seed)), symbol, pos.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def quotas(targets: DataFrame) -> DataFrame:
    """(request_id, bucket_id, symbol, target_share, sample_size, least, quota) of each bucket.

    least: min_rows. quota: greatest(min_rows, round(target_share * sample_size)). Missing parts count as 0; a
    target given twice counts once.
    """
    zero = F.lit(0).cast("bigint")
    share = F.round(F.coalesce(F.nanvl("target_share", F.lit(0.0)), F.lit(0.0)) * F.coalesce("sample_size", F.lit(0)))
    least = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), zero)
    return targets.select("request_id", "bucket_id", "symbol", "target_share", F.greatest(F.coalesce("sample_size", F.lit(0)).cast("bigint"), zero).alias("sample_size"), least.alias("least"), F.greatest(least, share.cast("bigint")).alias("quota")).distinct()


def feasible(counted: DataFrame) -> DataFrame:
    """``counted`` (quotas and pool) with ``drawn``, the rows each bucket gives.

    A bucket gives its quota, or its pool where that is smaller. Where a request's buckets would then
    exceed its sample_size, because minima lift some above their share, the others are trimmed uniformly: each loses the same
    share of what it has above its own minimum, whole rows by largest remainder (ties to the smaller
    bucket_id). If the minima alone exceed sample_size, they are what is drawn.
    """
    request = Window.partitionBy("request_id")
    gives = F.least("pool", "quota")
    above = gives - F.least("pool", "least")
    sized = counted.withColumns({"_gives": gives, "_above": above})
    sized = sized.withColumns({"_over": F.greatest(F.sum("_gives").over(request) - F.col("sample_size"), F.lit(0)), "_room": F.sum("_above").over(request)})
    sized = sized.withColumn("_cut", F.least("_over", "_room"))
    # cut * above / room in whole numbers: no rounding decides a tie
    whole, rest = F.expr("_cut * _above div _room"), F.expr("_cut * _above % _room")
    part = sized.withColumns({"_whole": F.when(F.col("_room") > 0, whole).otherwise(F.lit(0)), "_rest": F.when(F.col("_room") > 0, rest).otherwise(F.lit(0))})
    place = F.row_number().over(request.orderBy(F.desc("_rest"), "bucket_id"))
    more = (place <= F.col("_cut") - F.sum("_whole").over(request)).cast("bigint")
    trimmed = part.withColumn("_more", more).withColumn("drawn", F.col("_gives") - F.col("_whole") - F.col("_more"))
    return trimmed.drop("_gives", "_above", "_over", "_room", "_cut", "_whole", "_rest", "_more")


def draw(bars: DataFrame, targets: DataFrame, decisions: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The sample and its report: ``(drawn, report)``.

    drawn: (request_id, bucket_id, symbol, pos). report, one row a bucket: request_id, bucket_id,
    symbol, target_share, quota, pool, drawn, reached_share (of the request's drawn rows), exhausted (the pool is smaller
    than the quota), trimmed (rows given up so that the request keeps its size), oversized (the request's minima alone exceed its size).

    One pass over the pool builds, per partition and bucket, a reservoir of the bucket's own quota of rows of
    least ``priority`` and a count. They are merged in levels (``LANES``), written once, and trimmed to the
    feasible quotas that the final counts allow (``feasible``). No row of another bucket stands in for missing
    ones. A bucket no bar fits has pool 0; empty targets give empty results.
    """
    want = quotas(targets)
    sizes = want.select(F.col("bucket_id").alias("_b"), "quota")
    pool = bucket_pool(bars, targets, decisions).join(sizes, F.col("bucket_id") == F.col("_b")).select(
        "bucket_id", F.col("pos").cast("bigint").alias("pos"), priority(F.col("symbol"), F.col("pos"), seed).alias("priority"), "quota", F.lit(1).cast("bigint").alias("n")
    )
    parts = pool.mapInPandas(_reservoirs, _PART).withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    merged = materialise(parts.repartition("bucket_id", "_lane").drop("_lane").mapInPandas(_reservoirs, _PART))
    counts = merged.groupBy("bucket_id").agg(F.sum("n").alias("pool"))
    counted = want.join(counts, "bucket_id", "left").withColumn("pool", F.coalesce("pool", F.lit(0).cast("bigint")))
    final = feasible(counted)
    order = Window.partitionBy("bucket_id").orderBy("priority", "pos")
    ranked = merged.filter("priority >= 0").select("bucket_id", "pos", "priority").withColumn("_rank", F.row_number().over(order))
    chosen = ranked.join(final.select("request_id", "bucket_id", "symbol", "drawn"), "bucket_id").filter(F.col("_rank") <= F.col("drawn"))
    request = Window.partitionBy("request_id")
    report = final.select(
        "request_id",
        "bucket_id",
        "symbol",
        "target_share",
        "quota",
        "pool",
        "drawn",
        F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(request)).alias("reached_share"),
        (F.col("pool") < F.col("quota")).alias("exhausted"),
        (F.least("pool", "quota") - F.col("drawn")).alias("trimmed"),
        (F.sum("least").over(request) > F.col("sample_size")).alias("oversized"),
    )
    return chosen.select("request_id", "bucket_id", "symbol", "pos"), report
