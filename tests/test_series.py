"""Positions, blocks, indicators, features: against pandas, and blind to the future."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.functions import blocks
from candlewright.operators import indicators as ind
from candlewright.sources import feed


def bars(spark, pdf):
    return feed.bars_of_feed(spark.createDataFrame(pdf))


def wide(spark, pdf, **kw):
    return ind.wide_bars(bars(spark, pdf), 24, **kw).orderBy("symbol", "pos").toPandas()


def test_positions_go_by_time_over_buckets(spark, make_walk):
    pdf = pd.concat([make_walk(3000, 1, "A"), make_walk(50, 2, "B")]).sample(frac=1, random_state=3)
    got = bars(spark, pdf).orderBy("symbol", "pos").toPandas()
    assert got.groupby("symbol").pos.apply(lambda s: (s.to_numpy() == np.arange(len(s))).all()).all()
    assert got.groupby("symbol").ts.apply(lambda s: s.is_monotonic_increasing).all()
    assert dict(got.groupby("symbol").n_bars.first()) == {"A": 3000, "B": 50}


def test_carried_equals_a_loop_over_small_blocks(spark):
    rng = np.random.default_rng(0)
    flag = rng.random(200) < 0.1
    rows = spark.createDataFrame(pd.DataFrame({"symbol": "A", "pos": np.arange(200), "f": flag}))
    got = blocks.carried(rows, ["symbol"], {"l": F.col("f")}, {"n": F.col("f")}, size=16).orderBy("pos").toPandas()
    last, want_last, want_next = None, [], []
    for i in range(200):
        last = i if flag[i] else last
        want_last.append(last)
        later = np.flatnonzero(flag[i + 1 :])
        want_next.append(i + 1 + later[0] if len(later) else None)
    clean = lambda s: [None if pd.isna(v) else int(v) for v in s]
    assert clean(got.l) == want_last and clean(got.n) == want_next


def test_averages_equal_pandas_across_a_block_edge(spark, make_walk):
    pdf = make_walk(9000, 11)
    got = wide(spark, pdf, features=False)
    for n in (20, 60, 120):
        np.testing.assert_allclose(got[f"sma_{n}"], pdf.close.rolling(n).mean(), rtol=1e-11)
        ema = pdf.close.ewm(span=n, adjust=False).mean()
        ema[: n - 1] = np.nan
        np.testing.assert_allclose(got[f"ema_{n}"], ema, rtol=1e-11)
    prev = pdf.close.shift()
    tr = pd.concat([pdf.high - pdf.low, (pdf.high - prev).abs(), (pdf.low - prev).abs()], axis=1).max(axis=1)
    tr[0] = np.nan
    atr = tr.ewm(alpha=1 / 14, adjust=False, ignore_na=True).mean()
    atr[:14] = np.nan
    np.testing.assert_allclose(got.atr_14, atr, rtol=1e-11)
    assert got.atr_14[:14].isna().all() and got.ema_20[18:20].isna().tolist() == [True, False]


def test_dispersion_exists_from_bar_19_on(spark, make_walk):
    got = wide(spark, make_walk(200), features=False)
    assert got.ma_dispersion_atr[:19].isna().all() and (got.ma_dispersion_atr[19:] >= 0).all()


def test_features_do_not_see_the_future(spark, make_walk):
    pdf = make_walk(300, 11)
    changed = pdf.copy()
    changed.loc[201:, ["open", "high", "low", "close"]] *= 3.0
    a, b = wide(spark, pdf), wide(spark, changed)
    names = [f for f in ind.FEATURES if f != "compression_duration"]
    pd.testing.assert_frame_equal(a.loc[:200, names], b.loc[:200, names], rtol=1e-12)
    assert a.loc[200, names].notna().all()


def test_longest_run_is_capped_by_the_window(spark):
    n = 60
    pdf = pd.DataFrame({"symbol": "A", "pos": np.arange(n), "_blk": 0, "close": [101.0 if 10 <= i <= 29 else 99.0 for i in range(n)]})
    for c in ("high", "low", "open"):
        pdf[c] = pdf.close
    for c in (*ind.MA_COLUMNS, "ma_upper", "ma_lower", "cluster_center"):
        pdf[c] = 100.0
    for c in ("atr_14", "tr_mean_5", "tr_mean_20", "ma_dispersion_atr", "volume"):
        pdf[c] = 1.0
    got = ind.add_features(spark.createDataFrame(pdf), blocks.series_window()).orderBy("pos").toPandas()
    assert got.max_consecutive_close_above_10[[29, 33, 45]].tolist() == [10.0, 6.0, 0.0]
    assert got.max_consecutive_close_above_10[:9].isna().all()


def test_row_median_and_zero_denominators(spark):
    from candlewright.functions.exprs import ratio, row_median

    df = spark.createDataFrame([(1.0, None, 4.0), (None, None, None), (3.0, 1.0, 2.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(row_median(F.col("a"), F.col("b"), F.col("c"))).collect()] == [2.5, None, 2.0]
    assert df.select(ratio(F.col("a"), F.lit(0.0))).first()[0] is None


def test_too_large_alpha_is_refused(spark):
    with pytest.raises(ValueError):
        ind.exponential_mean(F.col("close"), 0.9, 0, blocks.series_window())
