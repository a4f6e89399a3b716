"""The chain from feed to labelled, split and scored events, with the settings of the registered queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join
from candlewright.operators import episodes as epi
from candlewright.operators import evaluate as ev
from candlewright.operators import indicators as ind
from candlewright.operators import islands as isl
from candlewright.operators import outcomes as out
from candlewright.session import materialise, read_table
from candlewright.sources import feed


#: What scans, episodes and triggers read of a bar.
EVENT_INPUTS = ["symbol", "pos", "n_bars", "ts", "timestamp", "close", "high", "low", "ma_dispersion_atr", "prev_dispersion", "ma_upper", "ma_lower", "cluster_center", "slope_down", "prior_local_low"]


@dataclass(frozen=True)
class Settings:
    """Series here are a few hundred bars long: horizon and gap are shorter than the published 24 and 164."""

    quantiles: tuple[float, ...] = (0.3, 0.45)
    platform_quantile: float = 0.1
    train: float = 0.7
    val: float = 0.15
    horizon: int = 6
    gap: int = 12
    min_duration: int = 3
    cooldown: int = 5
    exit_confirm: int = 2
    local_low_window: int = 10
    mae_penalty: float = 0.7
    cost: float = 0.001
    costs: tuple[float, ...] = (0.001, 0.002)
    draws: int = 20
    seed: int = 42
    n_folds: int = 4
    initial: float = 0.4
    inner_val: float = 0.15
    #: thresholds compare rounded dispersions, so that engines agree on ties
    digits: int = 8


def read_settings(path: str | Path) -> Settings:
    """Settings from a JSON file, or a YAML file where PyYAML is installed: names as in ``Settings``, lists for tuples. ValueError for an unknown name."""
    text = Path(path).read_text()
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("PyYAML is not installed: write the settings as JSON") from e
        given = yaml.safe_load(text) or {}
    else:
        given = json.loads(text)
    unknown = sorted(set(given) - {f.name for f in fields(Settings)})
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


@dataclass
class Pipeline:
    spark: SparkSession
    sf_dir: str
    s: Settings = field(default_factory=Settings)
    #: are features asked for? Then ``kept`` has them, and nothing is computed twice.
    features: bool = False

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def bars(self) -> DataFrame:
        return feed.bars_of_feed(self.table("klines"))

    @cached_property
    def wide(self) -> DataFrame:
        return ind.wide_bars(self.bars, self.s.horizon, self.s.local_low_window, features=self.features, digits=self.s.digits)

    @property
    def featured(self) -> DataFrame:
        if not self.features:
            raise ValueError("this pipeline was made without features")
        return self.kept

    @cached_property
    def kept(self) -> DataFrame:
        """``wide``, written once: thresholds, streaks and labels all read it."""
        return materialise(self.wide)

    def thresholds(self, quantiles: tuple[float, ...]) -> DataFrame:
        train_end, _ = out.boundaries(F.col("n_bars"), self.s.train, self.s.val)
        return isl.freeze_thresholds(self.kept, train_end, quantiles, digits=self.s.digits)

    def streaks_of(self, bars: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
        # one row a series and quantile, written so that the planner knows its size
        return isl.add_streaks(isl.with_thresholds(bars, materialise(self.thresholds(quantiles)).drop("n_train")))

    @cached_property
    def streaks(self) -> DataFrame:
        """Bars with streaks once for each quantile, with the columns that event sources read."""
        return materialise(self.streaks_of(self.kept.select(*EVENT_INPUTS), self.s.quantiles))

    @cached_property
    def platform_rows(self) -> DataFrame:
        return materialise(self.streaks_of(self.kept.select(*EVENT_INPUTS, "atr_14", "sma_20"), (self.s.platform_quantile,)))

    def events(self, trigger: str) -> DataFrame:
        return isl.scan(self.streaks, trigger, self.s.min_duration, self.s.cooldown)

    @cached_property
    def episodes(self) -> DataFrame:
        return epi.scan_episodes(self.streaks, self.s.min_duration, self.s.exit_confirm)

    @cached_property
    def anchored(self) -> DataFrame:
        return epi.anchored_events(self.episodes, epi.add_triggers(self.streaks))

    @cached_property
    def labelled_bars(self) -> DataFrame:
        return out.add_labels(self.kept, self.s.horizon, self.s.mae_penalty, self.s.cost)

    def labelled(self, events: DataFrame) -> DataFrame:
        columns = ["n_bars", "label_drop", *out.LABELS]
        return out.at_positions(events, self.labelled_bars, columns).filter("label_drop IS NULL")

    def split(self, events: DataFrame) -> DataFrame:
        a, b = out.boundaries(F.col("n_bars"), self.s.train, self.s.val)
        return events.withColumn("split", out.split_of(F.col("decision_pos"), a, b, self.s.gap))

    @cached_property
    def scored(self) -> DataFrame:
        """Labelled anchored events with their split and the baseline score, minus dispersion."""
        return materialise(self.split(self.labelled(self.anchored)).withColumn("score", -F.col("ma_dispersion_atr_at_decision")))

    @cached_property
    def folds(self) -> DataFrame:
        return out.fold_table(out.split_table(self.bars, self.s.train, self.s.val), self.s.n_folds, self.s.initial, self.s.inner_val)

    @cached_property
    def fold_thresholds(self) -> DataFrame:
        """Thresholds frozen on each fold's inner training bars, per series and fold."""
        bars = salted_join(self.kept.select("symbol", "pos", "ma_dispersion_atr"), self.folds.select("symbol", "fold", "inner_val_start"), "symbol", "pos")
        return materialise(isl.freeze_thresholds(bars, F.col("inner_val_start"), self.s.quantiles, ("symbol", "fold"), self.s.digits))

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary views of the chain's frames, for SQL: bars, streaks, episodes, anchored, scored, labelled_bars, zone events. Returns their names."""
        frames = {"bars": self.kept, "streaks": self.streaks, "episodes": self.episodes, "anchored": self.anchored, "scored": self.scored, "labelled_bars": self.labelled_bars, "zone_events": self.events("zone_start")}
        for name, frame in frames.items():
            frame.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in frames]

    @cached_property
    def control(self) -> DataFrame:
        """Matched control of the anchored test events at the first quantile."""
        events = self.scored.filter((F.col("split") == "test") & (F.col("quantile") == self.s.quantiles[0]))
        _, val_end = out.boundaries(F.col("n_bars"), self.s.train, self.s.val)
        return ev.matched_control(self.labelled_bars, events, self.s.horizon, val_end + self.s.gap, F.col("n_bars"), out.LABELS, draws=self.s.draws, seed=self.s.seed, digits=self.s.digits)
