"""Repeated consecutive events: each run of (near-)identical neighbours becomes one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.session import materialise


def near(column: str, tolerance: float, previous: str) -> Column:
    """Do both readings lie within ``tolerance``, or are both missing (NULL or NaN)?

    Doubles are compared with a slack of 1e-9, so that 0.52 - 0.5 counts as 0.02.
    """
    a, b = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.nanvl(F.col(previous).cast("double"), F.lit(None).cast("double"))
    close = F.abs(a - b) <= F.lit(tolerance + 1e-9)
    return F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(close, F.lit(False)))


def canonicalised(rows: DataFrame, group: Sequence[str], order: Sequence[Column], values: dict[str, float]) -> DataFrame:
    """``rows`` with their canonical event: ``_c0``, ``_c1``, ... and ``_variant``.

    Along the order within ``group``, an event whose values all lie within their tolerances of the event directly before it takes that
    event's canonical values, any other its own. Where a canonical event is followed at once by another with the same values
    (a drift that jumped back), ``_variant`` tells the two apart.
    """
    names = list(values)
    within = Window.partitionBy(*group).orderBy(*order)
    before = rows.withColumns({"_first": F.row_number().over(within) == 1, **{f"_p{i}": F.lag(n).over(within) for i, n in enumerate(names)}})
    repeats = ~F.col("_first")
    for i, n in enumerate(names):
        repeats = repeats & near(n, values[n], f"_p{i}")
    own = F.when(~repeats, F.struct(*[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)]))
    led = before.withColumn("_own", own).withColumn("_canon", F.last("_own", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    again = F.col("_own").isNotNull() & F.col("_own").eqNullSafe(F.lag("_canon").over(within)) & ~F.col("_first")
    marked = led.withColumn("_again", again.cast("int")).withColumn("_variant", F.sum("_again").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.select(*rows.columns, "_canon.*", "_variant")


def islands(rows: DataFrame, group: Sequence[str], event: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``_number``, their row number within ``group``, and ``_island``: it minus the row number within group and ``event``.

    The difference is constant as long as the same event follows itself, and grows with each other event in between.
    """
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    of_event = F.row_number().over(Window.partitionBy(*group, *event).orderBy(*order))
    return rows.withColumn("_number", number).withColumn("_island", F.col("_number") - of_event)


def collapse_runs(events: DataFrame, entity: Sequence[str], at: str, tie: str, values: dict[str, float]) -> DataFrame:
    """Runs of consecutive events of an entity of which each repeats the one directly before it.

    Order within an entity: ``at``, then ``tie`` (NULL times first). ``values`` maps each compared
    column to the difference that still counts as the same; NULL (or NaN) repeats NULL only. Returns one row a
    run, single events included: entity columns, first_<tie>, last_<tie>, n_events, started,
    ended, seconds (NULL where no time is known).

    Events are canonicalised along their order (``canonicalised``); row number within the entity minus row number
    within entity and canonical event is then constant along a run (``islands``), and so groups it.

    Rows are ranged over tasks by entity and order, written once to the shared folder so that these pieces stay, and runs are found in
    each piece of an entity. A run that goes on in the next piece is joined by comparing the last record of one
    with the first of the next; only these (one row a piece) are ordered per entity. So an entity, a day or NULL times may hold any
    part of the rows. Rows equal in every column, ``tie`` included, follow each other in no given order, which changes
    no count or time. Entity columns may be NULL. An empty input gives no rows; other columns are ignored.
    """
    ent = [f"_e{i}" for i in range(len(entity))]
    names = {f"_v{i}": tolerance for i, tolerance in enumerate(values.values())}
    rows = events.select(
        *[F.col(c).alias(e) for e, c in zip(ent, entity)],
        F.col(at).cast("timestamp").alias("_at"),
        F.col(tie).alias("_tie"),
        *[F.col(c).alias(n) for n, c in zip(names, values)],
    )
    ranged = materialise(rows.repartitionByRange(*ent, "_at", "_tie", *names).withColumn("_piece", F.spark_partition_id()))
    piece, order = [*ent, "_piece"], [F.col("_at").asc_nulls_first(), F.col("_tie"), *[F.col(n) for n in names]]
    event = [*[f"_c{i}" for i in range(len(names))], "_variant"]
    found = islands(canonicalised(ranged, piece, order, names), piece, event, order)
    ends = F.struct("_number", "_at", "_tie", *names)
    parts = found.groupBy(*piece, *event, "_island").agg(F.count(F.lit(1)).alias("_n"), F.min(ends).alias("_lo"), F.max(ends).alias("_hi"), F.min("_at").alias("_started"))
    parts = parts.withColumn("_own", F.struct("_piece", F.col("_lo._number").alias("number")))

    # does the first run of a piece go on from the piece before, and which run is still open at its end
    edges = parts.groupBy(*piece).agg(F.min("_lo").alias("_head"), F.max("_hi").alias("_tail"), F.count(F.lit(1)).alias("_runs"), F.max_by("_own", "_hi._number").alias("_open"))
    over = Window.partitionBy(*ent).orderBy("_piece")
    met = edges.withColumn("_before", F.lag("_tail").over(over))
    goes_on = F.col("_before").isNotNull()
    flat = met.withColumns({f"_h_{n}": F.col(f"_head.{n}") for n in names} | {f"_t_{n}": F.col(f"_before.{n}") for n in names})
    for n, tolerance in names.items():
        goes_on = goes_on & near(f"_h_{n}", tolerance, f"_t_{n}")
    flat = flat.withColumn("_goes_on", goes_on)
    begun = F.when(~(F.col("_goes_on") & (F.col("_runs") == 1)), F.col("_open"))
    joins = flat.withColumn("_from", F.last(begun, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))).filter("_goes_on").select(*piece, "_from")

    same = F.col("l._piece") == F.col("r._piece")
    for e in ent:
        same = same & F.col(f"l.{e}").eqNullSafe(F.col(f"r.{e}"))
    keyed = parts.alias("l").join(joins.alias("r"), same & (F.col("l._lo._number") == 1), "left").select("l.*", F.coalesce("r._from", "l._own").alias("_run"))
    ordered = lambda end: F.struct("_piece", end)
    whole = keyed.groupBy(*ent, "_run").agg(F.sum("_n").alias("n_events"), F.min(ordered("_lo")).alias("_lo"), F.max(ordered("_hi")).alias("_hi"), F.min("_started").alias("started"))
    return whole.select(
        *[F.col(e).alias(c) for e, c in zip(ent, entity)],
        F.col("_lo._lo._tie").alias(f"first_{tie}"),
        F.col("_hi._hi._tie").alias(f"last_{tie}"),
        "n_events",
        "started",
        F.col("_hi._hi._at").alias("ended"),
        ((F.unix_micros("_hi._hi._at") - F.unix_micros("started")) / 1e6).alias("seconds"),
    )


EPISODE_TOLERANCES = {"episode_start_pos": 2, "episode_end_pos": 2, "ma_dispersion_atr": 0.02}


def collapse_episodes(episodes: DataFrame) -> DataFrame:
    """Runs of the episode log, per (symbol, cell)."""
    return collapse_runs(episodes, ["symbol", "cell"], "emitted_at", "row_id", EPISODE_TOLERANCES)
