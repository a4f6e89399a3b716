"""Implausible readings: planted faults are found, ordinary extremes are not."""

import numpy as np
import pandas as pd

from candlewright.operators import implausible as imp

COLUMNS = ["ingest_seq", "symbol", "ts", "open", "high", "low", "close", "volume", "spike", "_scale"]


def series(symbol, n=1200, seed=1, vol=0.002, minutes=60, base=100.0, start=0):
    rng = np.random.default_rng(seed)
    close = base * np.exp(rng.normal(0, vol, n).cumsum())
    open_ = np.concatenate([[base], close[:-1]])
    high = np.maximum(open_, close) * np.exp(rng.exponential(vol / 2, n))
    low = np.minimum(open_, close) * np.exp(-rng.exponential(vol / 2, n))
    ts = 1_704_067_200_000 + np.arange(n, dtype=np.int64) * minutes * 60_000
    pdf = pd.DataFrame({"ingest_seq": start + np.arange(n), "symbol": symbol, "ts": ts, "open": open_, "high": high, "low": low, "close": close, "volume": np.exp(rng.normal(5, 0.6, n))})
    return pdf.assign(spike="clash", _scale=-1.0)


def flags(spark, pdf, steps=(("A", 60),)):
    table = spark.createDataFrame(list(steps), "symbol string, bar_minutes int")
    return imp.flag_implausible(spark.createDataFrame(pdf[COLUMNS]), table).toPandas()


def test_planted_faults(spark):
    pdf = series("A")
    want = set()

    def plant(i, **values):
        for k, v in values.items():
            pdf.loc[i, k] = v
        want.add(int(pdf.ingest_seq[i]))

    plant(100, high=pdf.low[100] * 0.99)
    plant(110, close=0.0)
    plant(120, volume=-3.0)
    plant(200, high=pdf.high[200] * 1.3)
    for i in (300, 301):
        plant(i, close=pdf.close[i] * 1.25, high=pdf.high[i] * 1.25)
    plant(400, **{c: pdf.loc[400, c] * 100 for c in ("open", "high", "low", "close")})
    plant(500, volume=pdf.volume[500] * 3000)
    for i in range(601, 612):
        plant(i, volume=pdf.volume[600])
    for i in range(701, 715):
        plant(i, **{c: pdf.close[700] for c in ("open", "high", "low", "close")})
    # a lasting move, a busy bar, and unknown readings are no cases
    pdf.loc[900:, ["open", "high", "low", "close"]] *= 1.5
    pdf.loc[950, "volume"] = np.exp(5 + 0.6 * 4)
    pdf.loc[[1000, 1001], ["close", "volume"]] = np.nan
    # deliveries: the bad bar again as it was, and corrected
    again = pdf.loc[[300, 300]].copy()
    again["ingest_seq"] = [5000, 5001]
    again.loc[again.ingest_seq == 5001, ["close", "high"]] /= 1.25
    want.add(5000)
    got = flags(spark, pd.concat([pdf, again]))
    assert set(got.ingest_seq) == want
    one = got.set_index("ingest_seq")
    assert one.impossible[[100, 110, 120]].all() and one.spike[[200, 300, 301, 400, 500, 5000]].all() and one.stuck[[601, 611, 701, 714]].all()


def test_relative_to_the_series(spark):
    wild, calm, thin = series("W", vol=0.05, seed=2), series("C", vol=1e-5, seed=3, start=10_000), series("T", seed=4, start=20_000)
    rng = np.random.default_rng(5)
    still = rng.random(len(thin)) < 0.7
    for i in np.flatnonzero(still):
        if i:
            thin.loc[i, ["open", "high", "low", "close"]] = thin.close[i - 1]
            thin.loc[i, "volume"] = 0.0
    calm.loc[600, "high"] *= 1.01
    got = flags(spark, pd.concat([wild, calm, thin]), [("W", 60), ("C", 60)])
    assert got.ingest_seq.tolist() == [10_600]


def stuck_at(spark, pdf, rules):
    table = spark.createDataFrame([("A", 60)], "symbol string, bar_minutes int")
    got = imp.flag_implausible(spark.createDataFrame(pdf[COLUMNS]), table, rules).toPandas()
    return sorted(got[got.stuck].ingest_seq)


def test_blocks_meet(spark):
    """Stretches over the edges of blocks are found whole: a short one, and one over several blocks with a gap and unknown closes."""
    rules = imp.SpikeRules(block_bars=384, edge_bars=16)
    pdf = series("A", 3000)
    step = 3_600_000
    edge = int((pdf.ts[0] // (step * 384) + 1) * 384 - pdf.ts[0] // step)
    prices = ["open", "high", "low", "close"]
    pdf.loc[edge - 5 : edge + 5, prices] = pdf.close[edge - 6]
    assert stuck_at(spark, pdf, rules) == list(range(edge - 5, edge + 6))
    pdf = series("A", 3000)
    long = range(edge + 100, edge + 1100)
    pdf.loc[long[0] : long[-1], prices] = pdf.close[long[0] - 1]
    unknown = [edge + 300, edge + 384, edge + 768, edge + 769]
    pdf.loc[unknown, "close"] = np.nan
    gone = range(edge + 400, edge + 800)
    got = stuck_at(spark, pdf.drop(index=[i for i in gone if i in pdf.index]), rules)
    assert got == [i for i in long if i not in unknown and i not in gone]


def test_quiet_series_over_an_edge(spark):
    """Where most bars are unmoved a stretch needs hundreds: 700 are found, over an edge too, and 300 are ordinary."""
    n = 20_000
    pdf = series("A", n, seed=8)
    rng = np.random.default_rng(9)
    moved = rng.random(n) > 0.97
    edge = int((pdf.ts[0] // (3_600_000 * 4096) + 1) * 4096 - pdf.ts[0] // 3_600_000)
    for lo, k in ((edge - 350, 700), (edge + 2000, 700), (edge + 3500, 300)):
        moved[lo : lo + k] = False
        moved[[lo - 1, lo + k]] = True
    start = np.maximum.accumulate(np.where(moved, np.arange(n), 0))
    close = pdf.close.to_numpy()[start]
    open_ = np.concatenate([[close[0]], close[:-1]])
    pdf["close"], pdf["open"], pdf["high"], pdf["low"] = close, open_, np.maximum(open_, close), np.minimum(open_, close)
    got = set(stuck_at(spark, pdf, imp.SpikeRules()))
    assert got >= set(range(edge - 350, edge + 350)) | set(range(edge + 2000, edge + 2700)) and not got & set(range(edge + 3500, edge + 3800))


def test_runs_join_over_blocks(spark):
    """Against one pass over the whole series, for blocks of many sizes."""
    rng = np.random.default_rng(3)
    for block in (384, 400, 1000):
        pdf = series("A", 2500, seed=block)
        pdf.loc[rng.random(2500) < 0.9, "volume"] = 7.0
        want, run = set(), []
        for i, v in enumerate([*pdf.volume, -1.0]):
            if v == 7.0:
                run.append(i)
            else:
                want |= set(run[1:]) if len(run) > 6 else set()
                run = []
        assert stuck_at(spark, pdf, imp.SpikeRules(block_bars=block, edge_bars=16)) == sorted(want)


def test_decomposition_decides(spark, monkeypatch):
    """A volume that is ordinary at the busy hour is a spike at a quiet one: only the low-rank profile tells."""
    pdf = series("A", 2400, seed=11)
    hour = (pdf.ts // 3_600_000) % 24
    rng = np.random.default_rng(12)
    pdf["volume"] = np.exp(3 + 6 * np.cos(hour / 24 * 2 * np.pi) ** 2 + rng.normal(0, 0.2, len(pdf)))
    quiet = [i for i in range(800, 1600) if hour[i] == 6][::8]
    pdf.loc[quiet, "volume"] = np.exp(7.0)
    assert set(flags(spark, pdf).ingest_seq) == set(quiet)
    m = np.full((1, 40, 24), np.nan)
    m[0] = np.log(pdf.volume.to_numpy()[:960].reshape(40, 24))
    low, cut = imp.decompose(m, 4, 1e-6)
    plain = imp.tail_cut((m - np.median(m, 2, keepdims=True)).ravel(), 1e-6)
    at = np.argwhere(np.abs(m - low) > imp.tail_cut((m - low).ravel(), 1e-6))
    assert len(at) == sum(q < 960 for q in quiet) and np.abs(m - np.median(m, 2, keepdims=True)).max() < plain


def test_large_tables_are_not_broadcast(spark, monkeypatch):
    """Beyond the counted bound the joins with per-series and per-block tables shuffle, salted, and give the same."""
    from candlewright.functions import salting

    pdf = pd.concat([series("A"), series("B", seed=5, start=50_000)])
    pdf.loc[pdf.ingest_seq.between(100, 140), "volume"] = 7.0
    pdf.loc[pdf.ingest_seq == 50_300, "high"] *= 3
    few = flags(spark, pdf, [("A", 60), ("B", 60)])
    monkeypatch.setattr(salting, "MOST_BROADCAST", 0)
    many = flags(spark, pdf, [("A", 60), ("B", 60)])
    key = ["ingest_seq", "impossible", "spike", "stuck"]
    assert few[key].sort_values("ingest_seq").values.tolist() == many[key].sort_values("ingest_seq").values.tolist() and len(few) == 41


def test_ordinary_noise_is_no_spike():
    """Neither heavy tails nor days of their own spread make spikes, nor do few days or few bars."""
    rng = np.random.default_rng(4)
    for days in (1, 2, 5, 60):
        m = rng.laplace(0, 1, (4, days, 24)) * rng.lognormal(0, 0.5, (4, days, 1))
        low, cut = imp.decompose(m, 4, 1e-6)
        assert (np.abs(m - low) < cut[:, None, None]).all()
    assert np.isinf(imp.decompose(rng.normal(0, 1, (1, 1, 10)), 4, 1e-6)[1][0])


def test_edges(spark):
    empty = spark.createDataFrame([], "ingest_seq bigint, symbol string, ts bigint, open double, high double, low double, close double, volume double")
    assert imp.flag_implausible(empty).count() == 0
    rows = [(1, None, 0, 1.0, 0.5, 1.0, 1.0, 1.0), (2, "X", None, 1.0, 1.0, 1.0, -1.0, 1.0), (3, "X", 5, None, None, None, None, None), (4, "X", None, 1.0, 1.0, 1.0, 1.0, 1.0), (5, "Y", 5, 1.0, 1.0, 1.0, float("nan"), 1.0)]
    got = imp.flag_implausible(spark.createDataFrame(rows, empty.schema)).toPandas()
    assert sorted(got.ingest_seq) == [1, 2] and got.impossible.all()
    huge = 2**62 + 1  # beyond what a double holds
    got = imp.flag_implausible(spark.createDataFrame([(huge, "X", 0, 1.0, 0.5, 1.0, 1.0, 1.0), (huge + 1, "X", 60_000, 1.0, 2.0, 1.0, 1.0, 1.0)], empty.schema)).toPandas()
    assert got.ingest_seq.tolist() == [huge]
    got = imp.flag_implausible(spark.createDataFrame([(None, "X", 0, 1.0, 0.5, 1.0, 1.0, 1.0), (huge, "X", 60_000, 1.0, 0.5, 1.0, 1.0, 1.0)], empty.schema)).collect()
    assert {g["ingest_seq"] for g in got} == {None, huge}
    twice = [(1, "X", 0, 1.0, 0.5, 1.0, 1.0, 1.0)] * 2
    assert imp.flag_implausible(spark.createDataFrame(twice, empty.schema)).count() == 2


def test_low_rank_part_keeps_spikes_out():
    rng = np.random.default_rng(0)
    normal = np.outer(rng.normal(1, 0.1, 40), np.sin(np.arange(24)))
    m = normal[None] + rng.normal(0, 0.01, (1, 40, 24))
    m[0, 5, 5] += 8
    m[0, 7, 7] = np.nan
    low, _ = imp.decompose(m, 6, 1e-6)
    assert abs(low[0, 5, 5] - normal[5, 5]) < 0.05 and abs(low[0, 7, 7] - normal[7, 7]) < 0.05
