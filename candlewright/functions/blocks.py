"""Ordered series cut into blocks, so that a series of any length spreads over many tasks.

A window over a whole series would put it into one task. Here positions come from counts per
time bucket; windows of bounded reach run over blocks of positions that carry copies of their
neighbours' edges; and what reaches back without bound ("the last bar where ...") is
carried from block to block through one summary row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WEEK_MS = 7 * 86_400_000
BLOCK = 8192


def with_positions(rows: DataFrame, key: str = "symbol", ts: str = "ts", bucket_ms: int = WEEK_MS) -> DataFrame:
    """``rows`` with ``pos`` (0-based, by ``ts`` within ``key``) and ``n_bars``; one row per (key, ts) expected.

    Rows are numbered within time buckets, and a bucket starts at the count of the ones before.
    Rows with a NULL key or time are dropped.
    """
    bucketed = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("_b", F.floor(F.col(ts) / bucket_ms)).repartition(key, "_b")
    counts = bucketed.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_k"))
    over = Window.partitionBy(key).orderBy("_b")
    offsets = counts.select(
        key,
        "_b",
        F.coalesce(F.sum("_k").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_k").over(Window.partitionBy(key)).alias("n_bars"),
    )
    within = F.row_number().over(Window.partitionBy(key, "_b").orderBy(ts))
    return bucketed.join(offsets, [key, "_b"]).withColumn("pos", (F.col("_off") + within - 1).cast("bigint")).drop("_b", "_off")


def blocked(rows: DataFrame, back: int, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Rows with ``_blk`` and ``_own``: each block also gets ``back`` rows before it and ``ahead`` rows after it.

    Copies go only to blocks that exist, so a series shorter than ``size`` is not copied at all.
    """
    if back > size or ahead > size:
        raise ValueError("a block must be longer than what it sees of its neighbours")
    blk = F.floor(F.col("pos") / size).cast("bigint")
    inside = F.col("pos") - blk * size
    places = [F.struct(blk.alias("b"), F.lit(True).alias("own"))]
    if back:
        places.append(F.when((inside >= size - back) & ((blk + 1) * size < F.col("n_bars")), F.struct((blk + 1).alias("b"), F.lit(False).alias("own"))))
    if ahead:
        places.append(F.when((inside < ahead) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(False).alias("own"))))
    return rows.withColumn("_p", F.explode(F.array_compact(F.array(*places)))).withColumns({"_blk": F.col("_p.b"), "_own": F.col("_p.own")}).drop("_p")


def own(rows: DataFrame) -> DataFrame:
    """The rows themselves, without their copies."""
    return rows.filter("_own").drop("_own", "_blk")


def series_window(keys: Sequence[str] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys, "_blk").orderBy("pos")


def carried(rows: DataFrame, keys: Sequence[str], last: dict[str, Column] | None = None, following: dict[str, Column] | None = None, size: int = BLOCK) -> DataFrame:
    """Positions of the last (up to and with this row) and next (after this row) row where a predicate holds.

    ``last[name]`` and ``following[name]`` are predicates; the columns get the position or NULL. A NULL
    predicate does not hold. Rows of a series must come once each (no copies). The running part is per block;
    one row a block is carried over the series.
    """
    last, following = last or {}, following or {}
    at = {n: F.when(F.coalesce(p, F.lit(False)), F.col("pos")) for n, p in {**last, **following}.items()}
    blk = rows.withColumn("_blk", F.floor(F.col("pos") / size).cast("bigint")).repartition(*keys, "_blk")
    summary = blk.groupBy(*keys, "_blk").agg(*[F.max(at[n]).alias(n) for n in last], *[F.min(at[n]).alias(n) for n in following])
    # what follows is read in falling order: a frame that ends at the last row would be summed anew for each row
    over, back = Window.partitionBy(*keys).orderBy("_blk"), Window.partitionBy(*keys).orderBy(F.col("_blk").desc())
    carry = summary.select(
        *keys,
        "_blk",
        *[F.max(n).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}") for n in last],
        *[F.min(n).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{n}") for n in following],
    )
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    rw = Window.partitionBy(*keys, "_blk").orderBy(F.col("pos").desc())
    done = blk.join(carry, [*keys, "_blk"]).withColumns(
        {
            **{n: F.coalesce(F.max(at[n]).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"_c_{n}")) for n in last},
            **{n: F.coalesce(F.min(at[n]).over(rw.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_c_{n}")) for n in following},
        }
    )
    return done.drop("_blk", *[f"_c_{n}" for n in {**last, **following}])
