"""Samples to target proportions: pools by brute force, uniform draws, and reports."""

import datetime as dt

import numpy as np
import pandas as pd

from candlewright.llm import sampling

BAR = "symbol string, pos bigint, timestamp timestamp, atr_14 double, bucket_id string, n int"
TARGET = "request_id bigint, bucket_id bigint, symbol string, month string, atr_lo double, atr_hi double, target_share double, min_rows int, sample_size int, pos string"
DECISION = "symbol string, decision_pos bigint, atr_14 double"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def bar(pos, day, atr, symbol="A"):
    return (symbol, pos, T0 + dt.timedelta(days=day), atr, "clash", 0)


def draw(spark, bars, targets, decisions=()):
    frames = [spark.createDataFrame(list(r), s) for r, s in ((bars, BAR), (targets, TARGET), (decisions, DECISION))]
    return sampling.draw(*frames)


def test_pools_and_quotas(spark):
    bars = [bar(i, i % 31, 1.0 + i / 100) for i in range(100)] * 2
    bars += [bar(200, 0, 0.0), bar(201, 0, float("nan")), bar(202, 0, None), bar(203, 0, 1.5, "B"), bar(None, 0, 1.2), bar(204, 40, 1.2), ("A", 205, None, 1.2, "", 0)]
    targets = [(1, 10, "A", "2024-01", None, 1.5, 0.5, 2, 41, "x"), (1, 11, "A", "2024-01", 1.5, None, 0.5, 60, 41, "x"), (1, 12, "A", "2024-05", None, None, 0.0, 1, 41, "x"), (2, 13, "B", "2024-01", float("nan"), None, None, None, None, "x")]
    drawn, report = draw(spark, bars, targets, [("A", 3, 1.0), ("A", 3, 1.0), ("B", 4, 1.0), (None, 1, 1.0)])
    r = report.toPandas().set_index("bucket_id")
    assert r.pool.to_dict() == {10: 49, 11: 50, 12: 0, 13: 1} and r.quota.to_dict() == {10: 21, 11: 60, 12: 1, 13: 0}
    assert r.exhausted.to_dict() == {10: False, 11: True, 12: True, 13: False} and r.drawn.to_dict() == {10: 2, 11: 50, 12: 0, 13: 0}
    assert r.oversized.to_dict() == {10: True, 11: True, 12: True, 13: False} and r.trimmed.to_dict() == {10: 19, 11: 0, 12: 0, 13: 0}
    d = drawn.toPandas()
    assert not d.duplicated(["bucket_id", "pos"]).any() and 3 not in set(d.pos) and d.groupby("bucket_id").size().to_dict() == {10: 2, 11: 50}


def test_draws_are_spread_evenly_and_repeatable(spark):
    bars = [bar(i, 0, 1.0) for i in range(4000)]
    targets = [(1, 1, "A", "2024-01", None, None, 1.0, 1, 1000, "x")]
    one, two = (draw(spark, b, targets)[0].toPandas().pos.sort_values().to_numpy() for b in (bars, bars[::-1]))
    assert len(one) == 1000 and (one == two).all()
    counts = np.histogram(one, bins=4, range=(0, 4000))[0]
    assert counts.min() > 200


def test_trimmed_within_the_size(spark):
    """A request keeps its size unless its minima exceed it; what is above the minima is cut in proportion."""
    rng = np.random.default_rng(1)
    rows = []
    for request in range(40):
        k = int(rng.integers(1, 7))
        share = rng.dirichlet(np.ones(k))
        size = int(rng.integers(0, 60))
        for i in range(k):
            least = int(rng.integers(0, 15))
            rows.append((request, request * 10 + i, "A", float(share[i]), size, least, max(least, round(share[i] * size)), int(rng.integers(0, 40))))
    schema = "request_id bigint, bucket_id bigint, symbol string, target_share double, sample_size bigint, least bigint, quota bigint, pool bigint"
    got = sampling.feasible(spark.createDataFrame(rows, schema)).toPandas()
    assert len(got) == len(rows)
    for _, r in got.groupby("request_id"):
        gives, floor = r[["pool", "quota"]].min(axis=1), r[["pool", "least"]].min(axis=1)
        size = r.sample_size.iloc[0]
        assert r.drawn.sum() == min(gives.sum(), max(size, floor.sum()))
        assert (r.drawn >= floor).all() and (r.drawn <= gives).all()
        cut, above = gives - r.drawn, gives - floor
        assert (np.abs(cut - cut.sum() * above / max(above.sum(), 1)) < 1).all()


def test_reservoirs_merge_like_one(spark):
    """Reservoirs of reservoirs, in any grouping, hold what one over all rows would hold: each bucket its own quota."""
    rng = np.random.default_rng(0)
    n = 500_000
    pdf = pd.DataFrame({"bucket_id": rng.integers(0, 3, n), "pos": np.arange(n), "priority": rng.integers(0, 10**9, n), "n": 1})
    pdf["quota"] = pdf["bucket_id"].map({0: 50, 1: 7, 2: 0})
    levels = [pd.concat(list(sampling._reservoirs(iter([pdf[i::8]])))) for i in range(8)]
    out = pd.concat(list(sampling._reservoirs(iter(levels))))
    counts = out[out.priority < 0].set_index("bucket_id").n.to_dict()
    assert counts == pdf.groupby("bucket_id").size().to_dict()
    kept = out[out.priority >= 0].sort_values(["bucket_id", "priority"])
    want = pdf.sort_values(["bucket_id", "priority"])
    want = want[want.groupby("bucket_id").cumcount() < want.quota]
    assert kept.pos.tolist() == want.pos.tolist() and len(kept) == 57


def test_empty_tables(spark):
    drawn, report = draw(spark, [], [])
    assert drawn.count() == 0 and report.count() == 0
    drawn, report = draw(spark, [], [(1, 1, "A", "2024-01", None, None, 1.0, 1, 10, "x")])
    assert drawn.count() == 0 and report.first()["exhausted"]
