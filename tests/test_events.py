"""Streaks, triggers, episodes, labels, splits, folds, controls: closed forms and loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import episodes as epi
from candlewright.operators import evaluate as ev
from candlewright.operators import indicators as ind
from candlewright.operators import islands as isl
from candlewright.operators import outcomes as out
from candlewright.sources import feed

KEYS = ("symbol",)


def frame(spark, disp, threshold, **columns):
    n = len(disp)
    disp = [None if d is None or d != d else float(d) for d in disp]
    pdf = pd.DataFrame({"symbol": "A", "pos": np.arange(n), "n_bars": n, "threshold": threshold})
    pdf["timestamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(15 * np.arange(n), unit="min")
    base = {"close": 100.0, "high": 100.0, "low": 100.0, "ma_upper": 101.0, "ma_lower": 99.0, "cluster_center": 100.0, "ema_20": np.linspace(100, 90, n), "atr_14": 1.0, "sma_20": 100.0}
    for c, v in {**base, **columns}.items():
        pdf[c] = v
    prev = [None, *disp[:-1]]
    low = pd.Series(np.broadcast_to(np.asarray(pdf.low, float), n))
    pdf["prior_local_low"] = low.shift().rolling(10, min_periods=10).min()
    pdf["slope_down"] = (pdf.ema_20 < pdf.ema_20.shift(5)).fillna(False)
    df = spark.createDataFrame(pdf)
    both = spark.createDataFrame(list(zip(range(n), disp, prev)), "pos int, ma_dispersion_atr double, prev_dispersion double")
    df = df.join(both, "pos").withColumn("prior_local_low", F.when(~F.isnan("prior_local_low"), F.col("prior_local_low")))
    return isl.add_streaks(df, KEYS)


def test_streak_with_gap(spark):
    got = frame(spark, [1.0, 0.1, 0.1, 0.1, 1.0, 0.1, None, 0.1], 0.5).orderBy("pos").toPandas()
    assert got.streak.tolist() == [0, 1, 2, 3, 0, 1, 0, 1]
    assert got.prev_streak.tolist() == [0, 0, 1, 2, 3, 0, 1, 0]
    assert got.above_run.tolist() == [1, 0, 0, 0, 1, 0, 0, 0]


# This series and the positions and lengths expected of it below are those stated for the scan.
def zone(spark, **kw):
    disp = [0.5 if 10 <= i <= 19 else 2.0 for i in range(40)]
    for i, v in kw.pop("disp", {}).items():
        disp[i] = v
    close = [90.0 if i == 15 else 100.0 for i in range(40)]
    return frame(spark, disp, 1.0, close=close, **kw)


@pytest.mark.parametrize(("trigger", "pos", "length"), [("zone_start", [12], [3]), ("dispersion_exit", [20], [10]), ("price_breakout", [15], [5])])
def test_triggers(spark, trigger, pos, length):
    got = isl.scan(zone(spark), trigger, 3, 5, KEYS).orderBy("decision_pos").toPandas()
    assert got.decision_pos.tolist() == pos and got.zone_length.tolist() == length


def test_unknown_dispersion_is_no_exit(spark):
    assert isl.scan(zone(spark, disp={20: None}), "dispersion_exit", 3, 5, KEYS).count() == 0


def test_unknown_trigger(spark):
    with pytest.raises(ValueError):
        isl.candidates(zone(spark), "nope")


def test_cooldown_is_chained_by_every_candidate(spark):
    raw = spark.createDataFrame([("A", p) for p in (1, 5, 9, 13, 20, 26, 8190, 8194)], "symbol string, pos bigint")
    got = isl.merge_close(raw, 5, KEYS).filter("kept").orderBy("pos").toPandas()
    assert got.pos.tolist() == [1, 20, 26, 8190]


def loop_episodes(disp, thr, m, k):
    found, alive, streak, above, start = [], False, 0, 0, None
    for i, d in enumerate(disp):
        below, over = d is not None and d < thr, d is not None and d >= thr
        streak = streak + 1 if below else 0
        if not alive:
            if streak >= m:
                alive, above, start = True, 0, i
        elif over:
            above += 1
            if above >= k:
                found.append((start - m + 1, start, i, True))
                alive = False
        else:
            above = 0
    if alive:
        found.append((start - m + 1, start, len(disp) - 1, False))
    return found


@pytest.mark.parametrize("seed", range(4))
def test_episodes_equal_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    level = np.repeat(rng.random(30), 10)
    disp = [None if rng.random() < 0.05 else float(x) for x in level + rng.normal(0, 0.15, 300)]
    got = epi.scan_episodes(frame(spark, disp, 0.5), 3, 2, KEYS).orderBy("episode_start_pos").collect()
    assert [tuple(r)[1:] for r in got] == loop_episodes(disp, 0.5, 3, 2)


# This series and what is expected of its episodes below are those stated for the latch and its anchors.
def episode_frame(spark, **columns):
    disp = [0.5 if 10 <= i <= 24 else 2.0 for i in range(60)]
    for i, v in columns.pop("disp", {}).items():
        disp[i] = v
    return frame(spark, disp, 1.0, **columns)


def test_episode_table(spark):
    rows = episode_frame(spark, disp={18: 2.0})
    got = epi.episode_table(epi.scan_episodes(rows, 3, 2, KEYS), rows, KEYS).toPandas()
    assert got[["episode_start_pos", "episode_qualified_pos", "episode_end_pos", "episode_duration_bars"]].values.tolist() == [[10, 12, 26, 17]]
    assert got.min_dispersion[0] == got.qualified_dispersion[0] == 0.5


def test_first_trigger_wins_and_none_gives_no_event(spark):
    quiet = episode_frame(spark)
    assert epi.anchored_events(epi.scan_episodes(quiet, 3, 2, KEYS), epi.add_triggers(quiet), KEYS).count() == 0
    close, high = [100.0] * 60, [100.0] * 60
    close[15], high[15], close[20], high[20] = 90.0, 95.0, 98.0, 100.0
    rows = episode_frame(spark, close=close, high=high)
    got = epi.anchored_events(epi.scan_episodes(rows, 3, 2, KEYS), epi.add_triggers(rows), KEYS).toPandas()
    assert got.decision_pos.tolist() == [15] and got.trigger_type.tolist() == ["local_low_break"]
    assert got.compression_duration_at_decision.tolist() == [6] and got.episode_age_at_decision.tolist() == [5]


def test_platform_reasons(spark):
    disp = [0.1 if i in (1, 2) or 5 <= i <= 20 or 25 <= i <= 29 or 35 <= i <= 40 else 2.0 for i in range(50)]
    high = [110.0 if i == 27 else 100.5 for i in range(50)]
    got = isl.platforms(frame(spark, disp, 1.0, high=high), KEYS).orderBy("core_start").toPandas()
    assert got.reject.tolist() == ["too_short", "too_long", "range", None] and got.core_len.tolist() == [2, 16, 5, 6]
    empty = isl.platforms(frame(spark, [2.0] * 5, 1.0), KEYS)
    assert empty.count() == 0
    picked = isl.evenly_spaced(spark.range(101), ["id"], 5).orderBy("id")
    assert [r[0] for r in picked.collect()] == [0, 25, 50, 75, 100]


def test_threshold_is_frozen_on_training_bars(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": "A", "pos": np.arange(500), "ma_dispersion_atr": rng.random(500)})
    changed = pdf.copy()
    changed.loc[350:, "ma_dispersion_atr"] = 9.0
    a, b = (isl.freeze_thresholds(spark.createDataFrame(x), F.lit(350), [0.3, 0.45]).orderBy("quantile").toPandas() for x in (pdf, changed))
    np.testing.assert_allclose(a.threshold, pdf.ma_dispersion_atr[:350].quantile([0.3, 0.45]), rtol=1e-14)
    assert a.equals(b) and a.n_train.tolist() == [350, 350]


def test_labels(spark, make_walk):
    pdf = make_walk(100)
    bars = ind.wide_bars(feed.bars_of_feed(spark.createDataFrame(pdf)), 24, features=False)
    labels = out.add_labels(bars, 24)
    events = spark.createDataFrame([("A", 50), ("A", 50), ("A", 51), ("A", 90), ("A", 5)], "symbol string, decision_pos bigint")
    got = out.at_positions(events, labels, ["label_drop", *out.LABELS]).orderBy("decision_pos").toPandas()
    assert got.decision_pos.tolist() == [5, 50, 50, 51, 90]
    assert got.label_drop.fillna("ok").tolist() == ["bad_atr", "ok", "ok", "ok", "incomplete_horizon"]
    row, a = got.iloc[1], got.iloc[1].atr_at_entry
    entry = pdf.open[51]
    assert row.entry_price == entry
    assert row.mfe_short == pytest.approx((entry - pdf.low[51:75].min()) / a)
    assert row.mae_short == pytest.approx((pdf.high[51:75].max() - entry) / a)
    assert row.gross_return == pytest.approx((entry - pdf.close[74]) / entry)
    assert row.net_return == pytest.approx(row.gross_return - 0.001)
    assert out.horizon_bars(6, 15) == 24
    with pytest.raises(ValueError):
        out.horizon_bars(0.05, 15)


def test_splits_and_folds(spark):
    rows = spark.range(1000).withColumn("n", F.lit(1000))
    a, b = out.boundaries(F.col("n"))
    got = rows.withColumn("split", out.split_of(F.col("id"), a, b, 24)).orderBy("id").toPandas().split
    assert got.groupby((got != got.shift()).cumsum()).agg(["first", "size"]).values.tolist()[0][0] == "train"
    sizes = got.value_counts().to_dict()
    assert sizes["train"] in (699, 700) and sizes["dropped_gap"] == 48
    assert out.build_folds(1000) == [(400, 400, 550), (550, 550, 700), (700, 700, 850), (850, 850, 1000)]
    table = out.fold_table(spark.createDataFrame([("A", 1000)], "symbol string, n_bars bigint")).orderBy("fold").toPandas()
    assert table.test_hi.tolist() == [550, 700, 850, 1000] and table.inner_val_start.tolist() == [340, 467, 595, 722]
    assert out.embargo(120, 24, 139) == 164
    gates = spark.range(1300).select("id", F.lit(800).alias("inner_val_start"), F.lit(1000).alias("train_end"), F.lit(1000).alias("test_lo"), F.lit(1200).alias("test_hi"))
    fold = gates.withColumn("s", out.fold_split(F.col("id"), 24, 164)).groupBy("s").agg(F.min("id"), F.max("id")).toPandas().set_index("s")
    assert fold.loc["val"].tolist() == [964, 975] and fold.loc["test"].tolist() == [1164, 1199]


def test_control_draws_k_rows_an_event(spark, make_walk):
    bars = ind.wide_bars(feed.bars_of_feed(spark.createDataFrame(make_walk(600, 9))), 24, features=False)
    labels = out.add_labels(bars, 24)
    events = spark.createDataFrame([("A", p) for p in (160, 200, 230, 300, 330, 400, 500)], "symbol string, decision_pos bigint")
    control = ev.matched_control(labels, events, 24, F.lit(150), F.lit(560), out.LABELS)
    got = control.toPandas()
    assert len(got) == 140 and got.decision_pos.between(150, 559).all() and got.gross_return.notna().all()
    report = ev.control_report(control, events).first()
    assert report["unique_decision_pos_count"] + report["duplicate_draw_count"] == 140 == report["requested_sample_count"]


def test_correlations_and_p_values(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": 1, "a": rng.integers(0, 20, 80).astype(float), "b": rng.normal(size=80)})
    pdf["b"] += pdf.a / 5
    flat = pd.DataFrame({"k": 2, "a": [1.0] * 5, "b": rng.normal(size=5)})
    from candlewright.functions.ranks import correlation

    got = ev.with_p_values(correlation(spark.createDataFrame(pd.concat([pdf, flat])), ["k"], "a", "b")).orderBy("k").toPandas()
    assert got.pearson[0] == pytest.approx(pdf.a.corr(pdf.b)) and got.spearman[0] == pytest.approx(pdf.a.rank().corr(pdf.b.rank()))
    assert np.isnan(got.pearson[1]) and np.isnan(got.pearson_p[1])
    # closed form for four degrees of freedom: t = 2 gives p = 0.116117
    r = 2 / 8**0.5
    p = ev.with_p_values(spark.createDataFrame([(r, r, 6)], "pearson double, spearman double, n bigint")).first()["pearson_p"]
    assert p == pytest.approx(0.1161165, abs=1e-6)


def test_top_groups_and_review_sets(spark):
    rows = spark.createDataFrame([("g", float(i // 2), i, float(i), 1.0, 1.0, 0.1, 0.1) for i in range(25)], "k string, score double, i int, short_utility double, mfe_short double, mae_short double, gross_return double, net_return double")
    tagged = ev.top_groups(rows, ["k"], "score", ["i"]).groupBy("grp").agg(F.count("*").alias("n"), F.min("i").alias("lo")).toPandas().set_index("grp")
    assert tagged.n.to_dict() == {"all": 25, "top_10pct": 3, "top_20pct": 5} and tagged.lo["top_10pct"] == 22
    sets = ev.review_sets(rows, ["k"], "score", ["i"], 10, 3, 20).groupBy("review_set").count().toPandas().set_index("review_set")["count"]
    assert sets.to_dict() == {"top": 10, "bottom": 15}


def test_exact_quantiles_equal_numpy(spark):
    from candlewright.functions.ranks import exact_quantiles

    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], [1, 7, 2000]), "v": np.concatenate([[3.0], rng.normal(size=7), np.round(rng.normal(size=2000), 1)])})
    rows = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("a", None), ("a", float("nan")), ("z", None)], "k string, v double"))
    got = exact_quantiles(rows, ["k"], "v", [0.0, 1 / 3, 0.5, 1.0]).toPandas()
    assert set(got.k) == {"a", "b", "c"}
    for r in got.itertuples():
        assert r.value == pytest.approx(np.quantile(pdf.v[pdf.k == r.k], r.q))
