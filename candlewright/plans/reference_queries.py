"""One query per operator of the bar pipeline. Doubles are rounded, positions are BIGINT, times are epoch milliseconds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import checks
from candlewright.operators import episodes as epi
from candlewright.operators import evaluate as ev
from candlewright.operators import indicators as ind
from candlewright.operators import islands as isl
from candlewright.operators import model
from candlewright.operators import outcomes as out
from candlewright.plans import walkforward as wf
from candlewright.plans.pipeline import Pipeline
from candlewright.session import materialise
from candlewright.sources import feed, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Pipeline(spark, sf_dir))
    return f


def feature_query(f: Callable[[Pipeline], DataFrame]) -> Callable[[Pipeline], DataFrame]:
    """A query whose bars carry the features."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Pipeline(spark, sf_dir, features=True))
    return f


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    """Rounded by way of nine decimals, so that noise in the last place does not break ties either way."""
    return df.withColumns({c: F.round(F.round(c, 9), digits) for c in columns})


def millis(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_millis(c) for c in columns})


@query
def src_feed_bars(p: Pipeline) -> DataFrame:
    return p.bars.select("symbol", "pos", "ts", "open", "high", "low", "close", "volume", F.date_format("timestamp", "yyyy-MM").alias("month"))


@query
def src_5_holdout(p: Pipeline) -> DataFrame:
    cut = feed.bars_of_feed(p.table("klines"), "2024-01-01T00:00:00+00:00")
    return cut.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@query
def src_10_event_bars(p: Pipeline) -> DataFrame:
    return feed.bars_of_events(p.table("events"), F.col("event_type"), F.col("value") + 1, 15)


@query
def chk_report(p: Pipeline) -> DataFrame:
    return checks.check_report(p.table("klines"), p.table("symbols"))


@query
def chk_5_gaps(p: Pipeline) -> DataFrame:
    return rounded(checks.gap_census(p.table("klines"), p.table("symbols")), ["gap_bars"], 6)


@query
def ind_1_2_averages(p: Pipeline) -> DataFrame:
    return rounded(p.wide.select("symbol", "pos", *ind.MA_COLUMNS), ind.MA_COLUMNS, 4)


@query
def ind_3_5_true_range(p: Pipeline) -> DataFrame:
    columns = ["tr", "atr_14", "tr_mean_5", "tr_mean_20"]
    return rounded(p.wide.select("symbol", "pos", *columns), columns, 4)


@query
def clu_cluster(p: Pipeline) -> DataFrame:
    columns = ["ma_upper", "ma_lower", "cluster_center"]
    return rounded(rounded(p.wide.select("symbol", "pos", *columns, "ma_dispersion_atr"), columns, 4), ["ma_dispersion_atr"], 6)


@feature_query
def feat_27(p: Pipeline) -> DataFrame:
    rows = p.streaks_of(p.kept, p.s.quantiles[:1]).withColumn("compression_duration", F.col("streak").cast("double"))
    return rounded(rows.select("symbol", "pos", *ind.FEATURES), ind.FEATURES, 5)


@query
def thr_1_thresholds(p: Pipeline) -> DataFrame:
    return rounded(p.thresholds((*p.s.quantiles, p.s.platform_quantile)), ["threshold"], 6)


@query
def isl_1_streaks(p: Pipeline) -> DataFrame:
    return p.streaks.select("symbol", "quantile", "pos", "streak", "prev_streak", "above_run")


def _scan(p: Pipeline, trigger: str) -> DataFrame:
    return millis(p.events(trigger), "decision_ts")


@query
def scn_1_zone_start(p: Pipeline) -> DataFrame:
    return _scan(p, "zone_start")


@query
def scn_2_dispersion_exit(p: Pipeline) -> DataFrame:
    return _scan(p, "dispersion_exit")


@query
def scn_3_price_breakout(p: Pipeline) -> DataFrame:
    return _scan(p, "price_breakout")


@query
def scn_5_stats(p: Pipeline) -> DataFrame:
    parts = [isl.scan_stats(p.streaks, t, p.s.min_duration, p.s.cooldown) for t in isl.TRIGGERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def epi_episodes(p: Pipeline) -> DataFrame:
    table = millis(epi.episode_table(p.episodes, p.streaks), "episode_start_ts", "episode_qualified_ts", "episode_end_ts")
    return rounded(table, ["min_dispersion", "mean_dispersion", "qualified_dispersion"], 5)


@query
def trg_flags(p: Pipeline) -> DataFrame:
    flags = [F.col(t).cast("int").alias(t) for t in epi.TRIGGER_NAMES]
    return rounded(epi.add_triggers(p.streaks).select("symbol", "quantile", "pos", *flags, "prior_local_low"), ["prior_local_low"], 6)


@query
def anc_events(p: Pipeline) -> DataFrame:
    columns = ["ma_dispersion_atr_at_decision", "episode_min_dispersion_so_far", "dispersion_change_from_min"]
    return rounded(millis(p.anchored, "decision_ts"), columns, 5)


@query
def plt_1_platforms(p: Pipeline) -> DataFrame:
    found = isl.platforms(p.platform_rows)
    return rounded(millis(found, "end_ts").drop("quantile"), ["range_atr", "sma20_drift_atr", "min_dispersion"], 5)


@query
def plt_1_rejects(p: Pipeline) -> DataFrame:
    found = isl.platforms(p.platform_rows)
    return found.groupBy(F.coalesce("reject", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def plt_2_stats(p: Pipeline) -> DataFrame:
    rows = p.platform_rows
    share = rows.groupBy("symbol").agg(F.round(F.round(F.avg(F.col("below").cast("double")), 9), 6).alias("share_below"))
    sizes = isl.platforms(rows).filter("reject IS NULL").groupBy("symbol", "core_len").agg(F.count(F.lit(1)).alias("n"))
    return share.join(sizes, "symbol", "left")


@query
def plt_3_pick(p: Pipeline) -> DataFrame:
    found = isl.platforms(p.platform_rows).filter("reject IS NULL")
    return isl.evenly_spaced(found.select("end_ts", "symbol", "core_start", "core_len"), ["end_ts", "symbol", "core_start"], 50).select(F.unix_millis("end_ts").alias("end_ts"), "symbol", "core_start", "core_len")


@query
def lab_labels(p: Pipeline) -> DataFrame:
    rows = p.labelled(p.events("zone_start")).select("symbol", "quantile", "decision_pos", *out.LABELS)
    prices = ["entry_price", "atr_at_entry"]
    return rounded(rounded(rows, prices, 4), [c for c in out.LABELS if c not in prices], 5)


@query
def lab_8_9_drops(p: Pipeline) -> DataFrame:
    rows = out.at_positions(p.events("zone_start"), p.labelled_bars, ["label_drop"])
    return rows.groupBy("quantile", F.coalesce("label_drop", F.lit("labelled")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query
def spl_1_boundaries(p: Pipeline) -> DataFrame:
    return out.split_table(p.bars, p.s.train, p.s.val)


@query
def spl_2_counts(p: Pipeline) -> DataFrame:
    rows = p.split(p.labelled(p.events("zone_start")))
    return rows.groupBy("symbol", "quantile", "split").agg(F.count(F.lit(1)).alias("n"))


def published(p: Pipeline) -> Pipeline:
    """The pipeline at the published horizon (24 bars) and embargo (164: features reach back 139 bars)."""
    return Pipeline(p.spark, p.sf_dir, replace(p.s, horizon=24, gap=out.embargo(120, 24, 139)))


@query
def spl_2_published_counts(p: Pipeline) -> DataFrame:
    """``spl_2_counts`` at the published horizon and embargo; short series have no event left in some splits."""
    p = published(p)
    return p.split(p.labelled(p.events("zone_start"))).groupBy("symbol", "quantile", "split").agg(F.count(F.lit(1)).alias("n"))


@feature_query
def spl_3_dataset(p: Pipeline) -> DataFrame:
    features = [f for f in ind.FEATURES if f != "compression_duration"]
    rows = out.at_positions(p.split(p.labelled(p.events("zone_start"))), p.featured, features)
    rows = rows.withColumn("compression_duration", F.col("zone_length").cast("double")).filter(out.complete(rows, features))
    columns = ["short_utility", "net_return", "linear_slope_60", "volume_zscore_20", "sma120_slope_20", "max_consecutive_close_above_10"]
    return rounded(rows.select("symbol", "quantile", "decision_pos", "split", "compression_duration", *columns), columns, 5)


@feature_query
def flt_3_dropped(p: Pipeline) -> DataFrame:
    features = [f for f in ind.FEATURES if f != "compression_duration"]
    rows = out.at_positions(p.labelled(p.events("zone_start")), p.featured, features)
    return rows.groupBy("symbol").agg(F.count_if(~out.complete(rows, features)).alias("dropped"), F.count_if(out.complete(rows, features)).alias("kept"))


@query
def wf_1_folds(p: Pipeline) -> DataFrame:
    return p.folds.select("symbol", F.col("fold").cast("bigint").alias("fold"), "train_end", "test_lo", "test_hi", "inner_val_start")


@query
def wf_2_thresholds(p: Pipeline) -> DataFrame:
    return rounded(p.fold_thresholds.withColumn("fold", F.col("fold").cast("bigint")), ["threshold"], 6)


def _scanned(p: Pipeline) -> DataFrame:
    return wf.fold_events(p, wf.scan_arm(p.s.min_duration, p.s.cooldown))


def _as_bigint(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fold", F.col("fold").cast("bigint"))


@query
def wf_4_7_grid(p: Pipeline) -> DataFrame:
    """Events of every (trigger, quantile, series, fold) in each split, before features are asked for."""
    count = lambda s: F.count_if(F.col("split") == s)
    return _as_bigint(_scanned(p).groupBy("trigger", "quantile", "symbol", "fold").agg(count("train").alias("n_train"), count("val").alias("n_val"), count("test").alias("n_test")))


@feature_query
def wf_5_gate(p: Pipeline) -> DataFrame:
    """Events with all features known per cell (trigger, quantile, fold; all series), and the gate they pass or not."""
    return _as_bigint(wf.passing(wf.fold_dataset(p, _scanned(p))))


@feature_query
def wf_8_pool(p: Pipeline) -> DataFrame:
    """Pooled out-of-sample results of the baseline score per (trigger, quantile), over the folds whose cells pass the gate."""
    dataset = materialise(wf.fold_dataset(p, _scanned(p)))
    passed = wf.passing(dataset).filter("passes_gate").select(*wf.CELL)
    test = materialise(dataset.filter("split = 'test'").join(passed, list(wf.CELL), "left_semi").withColumn("score", -F.col("ma_dispersion_atr")))
    pooled = wf.pool_cells(p, test, "score")
    returns = ["gross_top_10pct", "gross_top_20pct", "gross_all", "control_mean_gross_return", "weighted_mean_spearman", "pooled_spearman"]
    return rounded(rounded(pooled, returns, 6), ["edge_all_vs_control_bp", "edge_top10_vs_control_bp"], 3)


def _walked(p: Pipeline) -> tuple[DataFrame, list, DataFrame | None, list[dict]]:
    """Both arms (scan of zone starts, anchored episodes) at the first quantile: dataset, cells, predictions of the passing ones, their infos."""
    rows = wf.fold_bars(p).filter(F.col("quantile") == p.s.quantiles[0])
    arms = [wf.scan_arm(p.s.min_duration, p.s.cooldown, ["zone_start"]), wf.anchored_arm(p.s.min_duration, p.s.exit_confirm)]
    parts = [wf.fold_dataset(p, wf.fold_events(p, a, rows)) for a in arms]
    dataset = materialise(parts[0].unionByName(parts[1]))
    cells = [r.asDict() for r in wf.passing(dataset).orderBy(*wf.CELL).collect()]  # one row a cell
    return (dataset, cells, *wf.run_cells(dataset, cells, p.s.seed))


@feature_query
def wf_6_9_folds(p: Pipeline) -> DataFrame:
    """A model per fold and arm: counts, gate, best round and rank correlation of its predictions with what followed."""
    _, cells, test, infos = _walked(p)
    schema = "trigger string, quantile double, fold bigint, n_train bigint, n_val bigint, n_test bigint, passes_gate boolean, best_iteration bigint"
    best = {(i["trigger"], i["quantile"], i["fold"]): i["best_iteration"] for i in infos}
    names = schema.replace(",", "").split(" ")[::2][:-1]
    rows = p.spark.createDataFrame([tuple(c[n] for n in names) + (best.get((c["trigger"], c["quantile"], c["fold"])),) for c in cells], schema)
    if test is None:
        return rows.withColumns({"n": F.lit(None).cast("bigint"), "spearman": F.lit(None).cast("double")})
    rho = ev.correlation(test, list(wf.CELL), "prediction", "short_utility").select(*wf.CELL, "n", "spearman")
    return rows.join(_as_bigint(rho), list(wf.CELL), "left")


@feature_query
def wf_8_9_model_pool(p: Pipeline) -> DataFrame:
    """``wf_8_pool`` of the models' predictions, for both arms; no rows where no fold passes the gate."""
    dataset, _, test, _ = _walked(p)
    if test is None:
        test = dataset.filter("false").withColumn("prediction", F.lit(None).cast("double"))
    return wf.pool_cells(p, materialise(test), "prediction")


@feature_query
def ml_7_arms(p: Pipeline) -> DataFrame:
    """Both arms of the plain split, trained, evaluated and set against their control, with the flag for few samples."""
    anchored = p.split(p.labelled(p.anchored)).filter(F.col("quantile") == p.s.quantiles[0]).withColumn("zone_length", F.col("compression_duration_at_decision"))
    arms = {"zone_start": _dataset(p), "anchored": _with_features(p, anchored)}
    _, val_end = out.boundaries(F.col("n_bars"), p.s.train, p.s.val)
    rows = []
    for name, dataset in arms.items():
        r = wf.evaluate_arm(dataset, p.labelled_bars, p.s.horizon, val_end + p.s.gap, F.col("n_bars"), p.s.seed)
        one = (name, *[r["counts"][s] for s in wf.GATE], r["low_sample"])
        if r["skipped"]:
            rows.append((*one, None, None, None, None))
            continue
        rho = r["correlations"].first()
        gross = r["predictions"].agg(F.avg("gross_return").alias("g")).first()["g"]
        rows.append((*one, r["best_iteration"], rho["spearman"] if rho else None, gross, r["control"].agg(F.avg("gross_return").alias("g")).first()["g"]))
    return p.spark.createDataFrame(rows, "arm string, n_train bigint, n_val bigint, n_test bigint, low_sample boolean, best_iteration bigint, spearman double, gross_return double, control_gross_return double")


@query
def agg_1_group_stats(p: Pipeline) -> DataFrame:
    stats = ev.group_stats(p.scored, ["quantile", "split"])
    return rounded(stats, [c for c in stats.columns if c.startswith(("mean", "median", "positive"))], 5)


@query
def agg_2_quartiles(p: Pipeline) -> DataFrame:
    return rounded(ev.quartiles(p.scored, ["quantile", "split"], "short_utility"), ["mean", "median", "p25", "p75"], 5)


@query
def agg_3_trigger_types(p: Pipeline) -> DataFrame:
    rows = p.scored.groupBy("quantile", "trigger_type").agg(F.count(F.lit(1)).alias("n"), F.avg("short_utility").alias("mean_utility"), F.avg("net_return").alias("mean_net"))
    return rounded(rows, ["mean_utility", "mean_net"], 5)


@query
def agg_6_7_correlations(p: Pipeline) -> DataFrame:
    corr, _ = ev.evaluate_score(p.scored, ["quantile", "split"], "score", ["symbol", "decision_pos"])
    return rounded(corr, ["pearson", "spearman"], 6)


@query
def agg_6_7_p_values(p: Pipeline) -> DataFrame:
    corr, _ = ev.evaluate_score(p.scored, ["quantile", "split"], "score", ["symbol", "decision_pos"])
    return ev.with_p_values(corr)


@query
def agg_9_terciles(p: Pipeline) -> DataFrame:
    from candlewright.functions.ranks import exact_quantiles

    pool = p.kept.filter("atr_14 > 0")
    return rounded(exact_quantiles(pool, ["symbol"], "atr_14", [1 / 3, 2 / 3]).withColumn("quantile", F.round("q", 6)).drop("q"), ["value"], 4)


@query
def agg_11_cost_sweep(p: Pipeline) -> DataFrame:
    return rounded(ev.cost_sweep(p.scored, ["quantile", "split"], p.s.costs), ["mean_net_return", "positive_ratio"], 6)


@query
def agg_13_semantics(p: Pipeline) -> DataFrame:
    columns = ["episode_age_at_decision", "compression_duration_at_decision", "ma_dispersion_atr_at_decision", "short_utility"]
    anchored = p.scored.select("quantile", F.lit("anchored").alias("arm"), *[F.col(c).cast("double").alias(c) for c in columns])
    legacy = p.labelled(out.at_positions(p.events("zone_start"), p.kept, ["ma_dispersion_atr"])).select(
        "quantile",
        F.lit("legacy").alias("arm"),
        (F.col("zone_length") - 1).cast("double").alias(columns[0]),
        F.col("zone_length").cast("double").alias(columns[1]),
        F.col("ma_dispersion_atr").alias(columns[2]),
        "short_utility",
    )
    long = anchored.unionByName(legacy).unpivot(["quantile", "arm"], columns, "measure", "v")
    return rounded(ev.quartiles(long, ["quantile", "arm", "measure"], "v"), ["mean", "median", "p25", "p75"], 5)


@query
def agg_14_episode_stats(p: Pipeline) -> DataFrame:
    with_event = p.anchored.select("symbol", "quantile", "episode_start_pos", F.lit(1).alias("_hit"))
    rows = p.episodes.join(with_event, ["symbol", "quantile", "episode_start_pos"], "left")
    duration = F.col("episode_end_pos") - F.col("episode_start_pos") + 1
    return rows.groupBy("quantile").agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.count("_hit").alias("with_trigger"),
        F.count_if(F.col("_hit").isNull()).alias("without_trigger"),
        F.count_if("episode_closed").alias("closed"),
        F.round(F.round(F.avg(duration), 9), 6).alias("mean_duration"),
        F.max(duration).alias("max_duration"),
    )


@query
def sort_1_top_groups(p: Pipeline) -> DataFrame:
    _, groups = ev.evaluate_score(p.scored, ["quantile", "split"], "score", ["symbol", "decision_pos"])
    return rounded(groups, [c for c in groups.columns if c.startswith(("mean", "median", "positive"))], 5)


@query
def sort_3_review_sets(p: Pipeline) -> DataFrame:
    rows = ev.review_sets(p.scored.filter("split = 'test'"), ["quantile"], "score", ["symbol", "decision_pos"], 10, 10, 10, p.s.seed)
    return rows.select("quantile", "review_set", "place", "symbol", "decision_pos")


@query
def sort_3_published_sets(p: Pipeline) -> DataFrame:
    """``sort_3_review_sets`` at the published 50 rows a set."""
    rows = ev.review_sets(p.scored.filter("split = 'test'"), ["quantile"], "score", ["symbol", "decision_pos"], seed=p.s.seed)
    return rows.select("quantile", "review_set", "place", "symbol", "decision_pos")


@query
def sort_4_pool(p: Pipeline) -> DataFrame:
    """Review pools per quantile and series, widened from test to val and train until they hold 30 rows."""
    return ev.widened_pool(p.scored, ["quantile", "symbol"], 30).groupBy("quantile", "symbol", "pool").agg(F.count(F.lit(1)).alias("n"))


@query
def flt_5_flags(p: Pipeline) -> DataFrame:
    """Groups of under ten rows among the trigger types, flagged."""
    return ev.with_few_flag(p.scored.groupBy("quantile", "split", "trigger_type").agg(F.count(F.lit(1)).alias("sample_count")))


@query
def flt_5_pools(p: Pipeline) -> DataFrame:
    """Control pools per series, and whether they are large enough."""
    _, val_end = out.boundaries(F.col("n_bars"), p.s.train, p.s.val)
    return ev.pool_sizes(p.kept, p.s.horizon, val_end + p.s.gap, F.col("n_bars"))


@query
def sort_7_context(p: Pipeline) -> DataFrame:
    rows = ev.context_bars(p.scored.filter("split = 'test' AND quantile = 0.3"), p.bars, 119, p.s.horizon)
    return rows.select("symbol", "decision_pos", "offset", "ts", "close")


@query
def win_percent_rank(p: Pipeline) -> DataFrame:
    rows = ev.percent_rank(p.scored, ["quantile", "split"], "score")
    return rounded(rows.select("quantile", "split", "symbol", "decision_pos", "score_pct"), ["score_pct"], 6)


@query
def smp_1_control(p: Pipeline) -> DataFrame:
    return rounded(p.control.select("symbol", "event_pos", "draw", "decision_pos", "fallback", "gross_return"), ["gross_return"], 6)


@query
def smp_1_report(p: Pipeline) -> DataFrame:
    events = p.scored.filter((F.col("split") == "test") & (F.col("quantile") == p.s.quantiles[0]))
    return ev.control_report(p.control, events, p.s.draws)


@query
def agg_12_edges(p: Pipeline) -> DataFrame:
    """Candidate minus control, in basis points, over all series."""
    test = p.scored.filter((F.col("split") == "test") & (F.col("quantile") == p.s.quantiles[0]))
    mean = lambda df, side: df.agg(F.lit(1).alias("k"), F.avg("gross_return").alias(f"{side}_gross"), F.avg("net_return").alias(f"{side}_net"))
    both = mean(test, "event").join(mean(p.control, "control"), "k").drop("k")
    edges = both.withColumns({"edge_gross_bp": (F.col("event_gross") - F.col("control_gross")) * 1e4, "edge_net_bp": (F.col("event_net") - F.col("control_net")) * 1e4})
    return rounded(rounded(edges, ["event_gross", "event_net", "control_gross", "control_net"], 6), ["edge_gross_bp", "edge_net_bp"], 3)


def _with_features(p: Pipeline, events: DataFrame) -> DataFrame:
    """Events with all features known; zone_length stands for compression_duration."""
    features = [f for f in ind.FEATURES if f != "compression_duration"]
    rows = out.at_positions(events, p.featured, features).withColumn("compression_duration", F.col("zone_length").cast("double"))
    return materialise(rows.filter(out.complete(rows, features)))


def _dataset(p: Pipeline) -> DataFrame:
    """The pooled event dataset of the first quantile with all features."""
    return _with_features(p, p.split(p.labelled(p.events("zone_start").filter(F.col("quantile") == p.s.quantiles[0]))))


def _trained(p: Pipeline) -> tuple:
    """Dataset, model and its info, with the published settings (300 rounds, patience 50, depth 5)."""
    rows = _dataset(p)
    fitted, info = model.train(rows.filter("split = 'train'"), rows.filter("split = 'val'"), ind.FEATURES, seed=p.s.seed)
    return rows, fitted, info


@feature_query
def ml_1_3_scores(p: Pipeline) -> DataFrame:
    """Predictions for every event outside training, from trees boosted on the training events."""
    rows, fitted, _ = _trained(p)
    return model.predict(fitted, rows.filter("split <> 'train'"), ind.FEATURES).select("symbol", "decision_pos", "split", "prediction", "short_utility")


@feature_query
def ml_5_importance(p: Pipeline) -> DataFrame:
    _, fitted, info = _trained(p)
    return p.spark.createDataFrame(list(info["importance"].items()), "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(10)


@feature_query
def ml_6_evaluation(p: Pipeline) -> DataFrame:
    rows, fitted, _ = _trained(p)
    scored = model.predict(fitted, rows.filter("split <> 'train'"), ind.FEATURES)
    corr, _ = ev.evaluate_score(scored, ["split"], "prediction", ["symbol", "decision_pos"])
    return ev.with_p_values(corr)


@feature_query
def smp_2_permutation(p: Pipeline) -> DataFrame:
    rows, fitted, _ = _trained(p)
    return model.permutation_importance(fitted, rows.filter("split <> 'train'"), ind.FEATURES, ["symbol", "decision_pos"], seed=p.s.seed)


@query
def prj_10_titles(p: Pipeline) -> DataFrame:
    rows = ev.review_sets(p.scored.filter("split = 'test'"), ["quantile"], "score", ["symbol", "decision_pos"], seed=p.s.seed)
    # digits beyond those shown are cut alike in every engine
    for c, digits in {"score": 3, "short_utility": 3, "mfe_short": 2, "mae_short": 2, "gross_return": 5, "net_return": 5}.items():
        rows = rounded(rows, [c], digits)
    named = rows.withColumns({"event_id": F.col("decision_pos"), "prediction": F.col("score"), "episode_age": F.col("episode_age_at_decision")})
    decision, outcome = sinks.review_titles()
    return named.select("quantile", "symbol", decision.alias("decision_title"), outcome.alias("outcome_title"))
