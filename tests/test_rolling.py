"""Trailing totals: against a brute force, and the edges."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from candlewright.operators import rolling

SCHEMA = "symbol string, pos bigint, timestamp timestamp, volume double, close double, atr_14 double, loaded_at timestamp, day string, window_days int"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def bar(symbol, pos, day, volume, close=1.0, atr=1.0, loaded=0):
    return (symbol, pos, DAY + dt.timedelta(days=day, hours=pos % 24), volume, close, atr, DAY + dt.timedelta(days=loaded), "clash", 99)


def roll(spark, rows):
    return rolling.rolling_bar_totals(spark.createDataFrame(rows, SCHEMA))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for s in ("A", None):
        for p in range(120):
            v = None if rng.random() < 0.1 else float(np.round(rng.choice([0, 1.1, 2.37]), 3))
            rows.append(bar(s, p, int(rng.integers(0, 60)) + 60 * (p > 110), v, None if rng.random() < 0.1 else 2.0, float("nan") if rng.random() < 0.1 else 0.3))
    rows += rows[:20]
    got = roll(spark, rows).toPandas()
    pdf = pd.DataFrame(rows[:-20], columns=[f.split()[0] for f in SCHEMA.split(", ")])
    pdf["d"] = pdf.timestamp.dt.date
    for s, name in (("A", "A"), (None, None)):
        mine = pdf[pdf.symbol.eq(s) if s else pdf.symbol.isna()]
        out = got[got.symbol.eq(s) if s else got.symbol.isna()]
        days = pd.date_range(mine.d.min(), mine.d.max()).date
        assert len(out) == 2 * len(days)
        for r in out.itertuples():
            w = mine[(mine.d <= r.day) & (mine.d > r.day - dt.timedelta(days=r.window_days))]
            assert r.n == len(w) and r.n_active == (w.volume > 0).sum()
            assert r.total_volume == pytest.approx(w.volume.sum()) and (w.volume.sum() != 0 or r.total_volume == 0.0)
            assert (np.isnan(r.avg_close) and w.close.notna().sum() == 0) or r.avg_close == pytest.approx(w.close.mean())
            assert (np.isnan(r.avg_atr_14) and w.atr_14.notna().sum() == 0) or r.avg_atr_14 == pytest.approx(w.atr_14.mean())


def test_silent_windows_lie_between_active_days(spark):
    rows = [bar("A", 0, 0, 0.0), bar("A", 1, 1, 5.0), bar("A", 2, 5, None), bar("A", 3, 20, 5.0), bar("A", 4, 40, 0.0), bar("B", 0, 3, 0.0)]
    got = rolling.silent_windows(roll(spark, rows)).orderBy("day").toPandas()
    assert got.window_days.unique().tolist() == [7] and got.day.tolist() == [f"2024-01-{d:02d}" for d in range(9, 21)]
    assert got.columns.tolist() == ["symbol", "day", "window_days"]


def test_last_load_counts_even_where_it_is_null(spark):
    rows = [bar("A", 0, 0, 5.0, loaded=0), bar("A", 0, 0, None, loaded=2), bar("A", 1, 0, 3.0, loaded=1), bar("A", 1, 0, 3.0, loaded=1)]
    got = roll(spark, rows).filter("window_days = 7").first()
    assert got["n"] == 2 and got["total_volume"] == 3.0


def test_empty_extreme_and_missing_times(spark):
    assert roll(spark, []).count() == 0
    rows = [("A", 0, None, 1.0, 1.0, 1.0, None, "x", 1), bar("A", 1, 0, 4.0), bar("A", 2, 0, float("inf")), bar("A", 3, 0, 2.0)]
    got = roll(spark, rows).filter("window_days = 7").first()
    assert got["n"] == 3 and got["total_volume"] == 6.0


def test_any_finite_reading_counts_and_leaves_no_trace(spark):
    """Readings of any magnitude, in one window or one after the other: each total is what the window's own readings give."""
    volumes = [1e300, 1e-300, 5e-324, 1.7e308, 0.1, 3.0, 1e20, -1e20, 1e-9, 2.5e-9, 1e22, 0.3]
    rows = [bar("A", i, 10 * i, v, close=v) for i, v in enumerate(volumes)] + [bar("A", 100, 200, 1e25), bar("A", 101, 201, 0.1), bar("A", 102, 203, 0.2), bar("A", 103, 210, None)]
    got = roll(spark, rows).filter("window_days = 7").toPandas().set_index("day")
    at = lambda d: got.loc[(DAY + dt.timedelta(days=d)).date()]
    for i, v in enumerate(volumes):
        assert at(10 * i).total_volume == v == at(10 * i).avg_close and at(10 * i + 6).total_volume == v and at(10 * i + 7).total_volume == 0.0
    assert at(203).total_volume == 1e25 and at(203 + 4).total_volume == pytest.approx(0.1 + 0.2, rel=1e-15)
    total = roll(spark, [bar("A", i, i % 7, 1e-9 * (i + 1), close=1e-9 * (i + 1)) for i in range(50)]).filter("window_days = 7").toPandas()
    assert total.avg_close.iloc[-1] == pytest.approx(25.5e-9, rel=1e-14)
