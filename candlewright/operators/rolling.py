"""Totals and averages over trailing calendar windows (event-contribution deltas)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Amounts are summed as whole multiples of a power of two, one for each 32 binary orders of magnitude: a running sum
#: of doubles would not come back to zero.
WHOLE = "decimal(38,0)"
SPAN, DIGITS = 32, 54


def known(x: Column) -> Column:
    """The reading; NaN and infinities count as missing, like NULL."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def magnitude(x: Column) -> Column:
    """Which span of 32 binary orders of magnitude a reading belongs to (0 for 0 and for missing ones)."""
    return F.coalesce(F.when(x != 0, F.floor(F.log2(F.abs(known(x))) / SPAN)), F.lit(0)).cast("int")


def whole(x: Column, span: Column) -> Column:
    """The reading as a multiple of its span's unit, 2 ** (32 span - 54): any finite double, in two steps lest the factor overflow."""
    up = F.lit(DIGITS) - span * SPAN
    half = F.floor(up / 2)
    return (known(x) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), up - half)).cast(WHOLE)


def scaled_back(total: Column, span: Column) -> Column:
    down = span * SPAN - DIGITS
    half = F.floor(down / 2)
    return total.cast("double") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), down - half)


def latest_load(bars: DataFrame, values: Sequence[str], key: str = "symbol", pos: str = "pos", loaded: str = "loaded_at") -> DataFrame:
    """One row per ``(key, pos)`` with ``values`` of the load that came last.

    Copies of one load count once; where one load states a bar twice with different values,
    the greatest reading of each column stands. A NULL load time is older than any other.
    One exchange, on (key, pos): a key of any size is spread over all tasks.
    """
    age = F.coalesce(F.col(loaded).cast("timestamp"), F.timestamp_micros(F.lit(-(2**62))))
    slim = bars.select(key, pos, age.alias("_age"), *values).repartition(F.col(key), F.col(pos))
    one_load = slim.groupBy(key, pos, "_age").agg(*[F.max(c).alias(c) for c in values])
    # max_by passes over no NULL reading: the last load stands even where it has none
    return one_load.groupBy(key, pos).agg(*[F.max_by(c, "_age").alias(c) for c in values])


def daily_amounts(rows: DataFrame, key: str, ts: str, columns: Sequence[str], active: Column) -> DataFrame:
    """Per key, UTC day, and magnitudes of its readings (``_m_<column>``): rows ``n``, active rows, and sum and count of each column.

    A day whose readings are of one magnitude each is one row. Partial sums are taken before the exchange. Rows without a time are left out.
    """
    spans = {f"_m_{c}": magnitude(F.col(c)) for c in columns}
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(active, F.lit(False))).alias("n_active")]
    for c in columns:
        aggs += [F.sum(whole(F.col(c), F.col(f"_m_{c}"))).cast(WHOLE).alias(f"sum_{c}"), F.count(known(F.col(c))).alias(f"cnt_{c}")]
    placed = rows.filter(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts)).withColumns(spans)
    return placed.groupBy(key, "day", *spans).agg(*aggs)


def trailing_windows(daily: DataFrame, key: str, names: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Trailing totals for every calendar day from a key's first day to its last.

    Each daily amount enters as ``+x`` on its day and as ``-x`` window days later; the running
    sum of these deltas is the trailing total. A total holds until the next delta, so the
    days between two deltas are filled from it and no calendar is joined. All sums are of
    whole numbers, one running sum for each magnitude that occurs: a window without activity totals exactly zero, and a huge
    reading leaves no trace once it has left.

    Columns: key, day, window_days, n, n_active, total_<name>, avg_<name> (NULL without a
    reading), first_active, last_active (days, NULL for a key that never was active). Keys may be NULL
    (one group); an empty input gives no rows. The one ordered group is a key's days, which the
    calendar bounds, not the number of its rows; one exchange, on key and window.
    """
    of_key = Window.partitionBy(key)
    active_day = F.when(F.col("n_active") > 0, F.col("day"))
    edged = daily.withColumns({"_last": F.max("day").over(of_key), "first_active": F.min(active_day).over(of_key), "last_active": F.max(active_day).over(of_key)})
    edges = ["_last", "first_active", "last_active"]
    none = F.lit(0).cast("bigint")
    part = lambda name, span, x, k, n, act: F.struct(F.lit(name).alias("name"), span.alias("span"), x.cast(WHOLE).alias("x"), k.alias("k"), n.alias("n"), act.alias("n_active"))
    parts = [part("", F.lit(0), F.lit(0), none, F.col("n"), F.col("n_active"))]
    parts += [part(c, F.col(f"_m_{c}"), F.coalesce(F.col(f"sum_{c}"), F.lit(0).cast(WHOLE)), F.col(f"cnt_{c}"), none, none) for c in names]
    long = edged.select(key, *edges, "day", F.explode(F.array(*parts)).alias("p")).select(key, *edges, "day", "p.*").filter("name = '' OR k > 0")
    measures = ["x", "k", "n", "n_active"]
    group = [key, "window_days", "name", "span"]
    sign = F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign")
    deltas = long.select("*", F.explode(F.array(*[F.lit(w) for w in windows])).alias("window_days")).select("*", sign)
    deltas = deltas.withColumn("day", F.when(F.col("_sign") > 0, F.col("day")).otherwise(F.date_add("day", F.col("window_days")))).filter(F.col("day") <= F.col("_last"))
    signed = [F.sum(F.when(F.col("_sign") > 0, F.col(m)).otherwise(-F.col(m))).cast(WHOLE if m == "x" else "bigint").alias(m) for m in measures]
    one = deltas.repartition(key, "window_days").groupBy(*group, "day").agg(*[F.first(e).alias(e) for e in edges], *signed)
    step = Window.partitionBy(*group).orderBy("day")
    run = step.rowsBetween(Window.unboundedPreceding, 0)
    totals = one.select(
        *group,
        *edges,
        "day",
        F.coalesce(F.date_sub(F.lead("day").over(step), 1), F.col("_last")).alias("_until"),
        *[F.sum(m).over(run).cast(WHOLE if m == "x" else "bigint").alias(m) for m in measures],
    )
    days = totals.select(*group, "first_active", "last_active", *measures, F.explode(F.sequence("day", "_until", F.expr("interval 1 day"))).alias("day"))
    mine = lambda c, x: F.when(F.col("name") == c, x)
    aggs = [F.first("first_active").alias("first_active"), F.first("last_active").alias("last_active"), F.sum("n").alias("n"), F.sum("n_active").alias("n_active")]
    for c in names:
        aggs += [F.sort_array(F.collect_list(mine(c, F.struct("span", scaled_back(F.col("x"), F.col("span")).alias("x"))))).alias(f"_{c}"), F.coalesce(F.sum(mine(c, F.col("k"))), F.lit(0)).alias(f"cnt_{c}")]
    whole_days = days.groupBy(key, "window_days", "day").agg(*aggs)
    out = [key, "day", "window_days", "n", "n_active"]
    for c in names:
        total = F.aggregate(F.transform(f"_{c}", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x)
        out += [total.alias(f"total_{c}"), F.try_divide(total, F.col(f"cnt_{c}").cast("double")).alias(f"avg_{c}")]
    return whole_days.select(*out, "first_active", "last_active")


def rolling_bar_totals(bars: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Trailing volume, close and atr_14 per symbol and UTC day of a bar table (see ``trailing_windows``).

    Every bar counts once however often it was loaded. Columns besides those used are ignored,
    whatever their names.
    """
    bar = latest_load(bars, ["timestamp", "volume", "close", "atr_14"])
    daily = daily_amounts(bar, "symbol", "timestamp", ["volume", "close", "atr_14"], F.col("volume") > 0)
    return trailing_windows(daily, "symbol", ["volume", "close", "atr_14"], windows)


def silent_windows(rolled: DataFrame) -> DataFrame:
    """Days between a symbol's first and last active day whose whole trailing window is inactive."""
    return rolled.filter((F.col("n_active") == 0) & (F.col("day") > F.col("first_active")) & (F.col("day") < F.col("last_active"))).select(
        "symbol", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("window_days").cast("int").alias("window_days")
    )
