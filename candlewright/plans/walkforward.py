"""Walk-forward experiments: thresholds, events, model and control anew in each fold, any event source through one harness."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join
from candlewright.operators import episodes as epi
from candlewright.operators import evaluate as ev
from candlewright.operators import indicators as ind
from candlewright.operators import islands as isl
from candlewright.operators import model
from candlewright.operators import outcomes as out
from candlewright.plans.pipeline import EVENT_INPUTS, Pipeline
from candlewright.session import materialise

#: A series' fold at one threshold.
KEYS = ("symbol", "fold", "quantile")
#: A cell trains one model on the events of all series.
CELL = ("trigger", "quantile", "fold")
#: Least events of a cell in train, val and test.
GATE = {"train": 40, "val": 10, "test": 10}
FEATURES = [f for f in ind.FEATURES if f != "compression_duration"]

#: From bars with streaks per ``KEYS`` to events: KEYS, trigger (the arm's name), decision_pos, decision_ts, zone_length.
EventBuilder = Callable[[DataFrame], DataFrame]


def scan_arm(min_duration: int, cooldown: int, triggers: Sequence[str] = isl.TRIGGERS) -> EventBuilder:
    return lambda rows: isl.scan_all(rows, min_duration, cooldown, KEYS, triggers)


def anchored_arm(min_duration: int, exit_confirm: int) -> EventBuilder:
    """First triggered bar of each episode; the bars below the threshold so far stand for the zone's length."""

    def build(rows: DataFrame) -> DataFrame:
        found = epi.anchored_events(epi.scan_episodes(rows, min_duration, exit_confirm, KEYS), epi.add_triggers(rows), KEYS)
        return found.select(*KEYS, F.lit("anchored").alias("trigger"), "decision_pos", "decision_ts", "zone_length")

    return build


def fold_bars(p: Pipeline) -> DataFrame:
    """Bars before each fold's end, once for each fold and threshold, with streaks: only the columns that event sources read."""
    thresholds = p.fold_thresholds.drop("n_train").join(p.folds.select("symbol", "fold", "test_hi"), ["symbol", "fold"])
    rows = isl.with_thresholds(p.kept.select(*EVENT_INPUTS), thresholds, ("symbol",)).filter(F.col("pos") < F.col("test_hi")).drop("test_hi")
    return isl.add_streaks(rows, KEYS)


def fold_events(p: Pipeline, builder: EventBuilder, rows: DataFrame | None = None) -> DataFrame:
    """Events of one arm with labels and their role in the fold."""
    events = builder(fold_bars(p) if rows is None else rows)
    labelled = out.at_positions(events, p.labelled_bars, ["label_drop", "ma_dispersion_atr", *out.LABELS]).filter("label_drop IS NULL")
    placed = labelled.join(p.folds.drop("n_bars"), ["symbol", "fold"])
    return placed.withColumn("split", out.fold_split(F.col("decision_pos"), p.s.horizon, p.s.gap))


def fold_dataset(p: Pipeline, events: DataFrame) -> DataFrame:
    """Events of a fold's splits with every feature known; zone_length stands for compression_duration."""
    rows = out.at_positions(events.filter("split <> 'dropped'"), p.featured, [f for f in FEATURES if f != "ma_dispersion_atr"])
    return rows.withColumn("compression_duration", F.col("zone_length").cast("double")).filter(out.complete(rows, FEATURES))


def passing(dataset: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Counts per cell, and whether they pass the gate."""
    return model.gate(dataset, CELL, GATE if least is None else least)


def run_cells(dataset: DataFrame, cells: Sequence[dict], seed: int = 42, **settings: int) -> tuple[DataFrame | None, list[dict]]:
    """(test events with ``prediction``, one info per cell): a model per passing cell, trained, stopped early and applied within the fold.

    ``cells`` come from ``passing``: as many as arms x thresholds x folds, whatever the data's size. Without a passing cell there are no predictions.
    """
    parts, infos = [], []
    for c in cells:
        if not c["passes_gate"]:
            continue
        one = reduce(lambda d, k: d.filter(F.col(k) == c[k]), CELL, dataset)
        fitted, info = model.train(one.filter("split = 'train'"), one.filter("split = 'val'"), ind.FEATURES, seed=seed, **settings)
        parts.append(model.predict(fitted, one.filter("split = 'test'"), ind.FEATURES))
        infos.append({**{k: c[k] for k in CELL}, "best_iteration": info["best_iteration"]})
    return (reduce(DataFrame.unionByName, parts) if parts else None), infos


def fold_control_means(p: Pipeline, test: DataFrame) -> DataFrame:
    """(cell, control_gross, control_n): mean gross return of the matched control of each cell's test events, drawn within the series' fold."""
    bars = salted_join(p.labelled_bars, p.folds.select("symbol", "fold", "test_lo", "test_hi"), "symbol", "pos").withColumn("symbol", F.concat_ws("#", "symbol", "fold"))
    place = F.concat_ws("#", "symbol", F.col("fold").cast("string"))
    control = ev.matched_control(bars, test.select(place.alias("symbol"), "decision_pos").distinct(), p.s.horizon, F.col("test_lo") + p.s.gap, F.col("test_hi"), ["gross_return"], draws=p.s.draws, seed=p.s.seed, digits=p.s.digits)
    drawn = test.select(*CELL, place.alias("_at"), "decision_pos").join(control.select(F.col("symbol").alias("_at"), F.col("event_pos").alias("decision_pos"), F.col("gross_return").alias("g")), ["_at", "decision_pos"])
    return drawn.groupBy(*CELL).agg(F.avg("g").alias("control_gross"), F.count("g").alias("control_n"))


def pool_cells(p: Pipeline, test: DataFrame, score: str) -> DataFrame:
    """Pooled results per (trigger, quantile) of the folds whose test events are given; none, no rows."""
    return ev.pool_folds(test, score, fold_control_means(p, test), ["trigger", "quantile"])


def evaluate_arm(dataset: DataFrame, bars: DataFrame, horizon: int, lo, hi, seed: int = 42, least: dict[str, int] | None = None, **settings: int) -> dict:
    """Train an arm's model, evaluate it on its test events, and set it against their matched control (ML-7).

    Returns counts, low_sample (below ``model.LEAST_COMPARED``), best_iteration, and the frames: predictions, correlations, groups, control. None
    of the frames where the counts do not reach ``least`` (default ``GATE``).
    """
    counts = {r["split"]: r["n"] for r in dataset.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a split
    result: dict = {"counts": {s: counts.get(s, 0) for s in GATE}, "low_sample": any(counts.get(s, 0) < n for s, n in model.LEAST_COMPARED.items())}
    if any(counts.get(s, 0) < n for s, n in (GATE if least is None else least).items()):
        return result | {"skipped": True}
    fitted, info = model.train(dataset.filter("split = 'train'"), dataset.filter("split = 'val'"), ind.FEATURES, seed=seed, **settings)
    test = model.predict(fitted, dataset.filter("split = 'test'"), ind.FEATURES)
    correlations, groups = ev.evaluate_score(test, ["split"], "prediction", ["symbol", "decision_pos"])
    control = ev.matched_control(bars, test.select("symbol", "decision_pos").distinct(), horizon, lo, hi, out.LABELS, seed=seed)
    return result | {"skipped": False, "best_iteration": info["best_iteration"], "predictions": test, "correlations": correlations, "groups": groups, "control": control}
