"""Walk-forward: null features dropped and cells gated before anything is trained or pooled; arms through one harness."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.operators import indicators as ind
from candlewright.operators import model
from candlewright.plans import reference_queries as rq
from candlewright.plans import walkforward as wf
from candlewright.plans.pipeline import Pipeline
from candlewright.session import materialise
from candlewright.sources import feed


@pytest.fixture(scope="module")
def p(spark, make_walk):
    p = Pipeline(spark, "", features=True)
    klines = spark.createDataFrame(make_walk(8000, symbol="A")).unionByName(spark.createDataFrame(make_walk(600, seed=8, symbol="B")))
    p.__dict__["bars"] = materialise(feed.bars_of_feed(klines))
    p.__dict__["rows"] = materialise(wf.fold_bars(p))
    return p


def test_features_and_gate(p):
    events = materialise(wf.fold_events(p, wf.scan_arm(3, 5), p.rows))
    every = events.filter("split <> 'dropped'").toPandas()
    dataset = materialise(wf.fold_dataset(p, events))
    kept = dataset.toPandas()
    assert every.decision_pos.min() < 139 <= kept.decision_pos.min() and len(kept) == (every.decision_pos >= 139).sum()
    assert not kept[ind.FEATURES].isna().any().any()
    sizes = kept.groupby([*wf.CELL, "split"]).size().unstack(fill_value=0)
    got = wf.passing(dataset).toPandas().set_index(list(wf.CELL))
    for k, r in sizes.iterrows():
        assert tuple(got.loc[k]) == (r.train, r.val, r.test, r.train >= 40 and r.val >= 10 and r.test >= 10)
    assert 0 < got.passes_gate.sum() <= len(got)


def test_pool_of_passing_folds_only(p, spark, monkeypatch):
    monkeypatch.setattr(rq, "Pipeline", lambda *_, **__: p)
    gate = rq.QUERIES["wf_5_gate"](spark, "").toPandas()
    pooled = rq.QUERIES["wf_8_pool"](spark, "").toPandas().set_index(["trigger", "quantile"])
    passed = gate[gate.passes_gate].groupby(["trigger", "quantile"])
    assert pooled.n_folds_used.to_dict() == passed.size().to_dict() and pooled.n_oos_events.to_dict() == passed.n_test.sum().to_dict()
    monkeypatch.setattr(wf, "GATE", {"train": 10**6, "val": 10, "test": 10})
    assert rq.QUERIES["wf_8_pool"](spark, "").count() == 0
    monkeypatch.setattr(wf, "run_cells", lambda dataset, cells, *_: (None, []))
    assert rq.QUERIES["wf_8_9_model_pool"](spark, "").count() == 0


def test_a_model_per_cell(p):
    """Predictions stay within the fold's test bars, and each cell has its own model; any event source will do."""

    def every_tenth(rows):
        return rows.filter("pos % 10 = 0 AND quantile = 0.3 AND fold >= 2").select(*wf.KEYS, F.lit("own").alias("trigger"), F.col("pos").alias("decision_pos"), F.col("timestamp").alias("decision_ts"), F.lit(4).cast("bigint").alias("zone_length"))

    dataset = materialise(wf.fold_dataset(p, wf.fold_events(p, every_tenth, p.rows)))
    cells = [r.asDict() for r in wf.passing(dataset).orderBy("fold").collect()]
    test, infos = wf.run_cells(dataset, cells, rounds=6, patience=3, depth=2)
    assert [i["fold"] for i in infos] == [2, 3] and all(1 <= i["best_iteration"] <= 6 for i in infos)
    got = test.toPandas()
    assert got.groupby("fold").size().to_dict() == {c["fold"]: c["n_test"] for c in cells} and (got.decision_pos >= got.test_lo).all() and (got.decision_pos < got.test_hi).all()
    assert wf.run_cells(dataset, [{**c, "passes_gate": False} for c in cells]) == (None, [])
    low = wf.evaluate_arm(dataset.filter("split <> 'val'"), p.labelled_bars, p.s.horizon, F.lit(0), F.col("n_bars"))
    assert low["skipped"] and low["low_sample"] and low["counts"]["val"] == 0


def test_anchored_arm_gives_one_event_an_episode(p):
    events = wf.anchored_arm(3, 2)(p.rows).toPandas()
    assert len(events) and not events.duplicated([*wf.KEYS, "decision_pos"]).any() and (events.zone_length > 0).all()


def test_shuffled_is_a_random_permutation(spark):
    for n in (1, 2, 3, 10, 1000):
        got = spark.range(n).select("id", *[model.shuffled(F.col("id"), n, F.lit(k)).alias(f"k{k}") for k in range(3)]).toPandas()
        assert all(sorted(got[f"k{k}"]) == list(range(n)) for k in range(3))
    assert (got.k0 != got.k1).mean() > 0.99 and max(abs(np.corrcoef(got.id, got[f"k{k}"])[0, 1]) for k in range(3)) < 0.12
    assert abs(np.corrcoef(np.diff(got.k0)[:-1], np.diff(got.k0)[1:])[0, 1] + 0.5) < 0.1  # steps are not those of an affine map


def test_fewer_rounds_are_a_prefix(spark):
    """Growing rounds until patience decides, and cutting there, gives what a full fit cut there gives."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    rows = [(float(a), float(b), float(a + rng.normal(0, 2))) for a, b in x]
    df = spark.createDataFrame(rows, "a double, b double, short_utility double")
    fit, val = materialise(df.limit(200)), materialise(df.offset(200))
    cut, info = model.train(fit, val, ["a", "b"], rounds=40, patience=4, depth=2)
    n = info["best_iteration"]
    whole, _ = model.train(fit, val, ["a", "b"], rounds=n, patience=10**6, depth=2)
    one, two = (model.predict(m, val, ["a", "b"]).toPandas().prediction.to_numpy() for m in (cut, model.first_rounds(whole, whole.getNumTrees)))
    assert n < 40 and cut.getNumTrees == n
    if whole.getNumTrees == n:
        np.testing.assert_allclose(one, two)
