"""Settings from files, views, model files, sample requirements, review pools and flags."""

import json

import numpy as np
import pytest

from candlewright.operators import evaluate as ev
from candlewright.operators import model
from candlewright.plans.pipeline import Pipeline, Settings, read_settings
from candlewright.session import materialise
from candlewright.sources import feed, sinks


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"horizon": 24, "gap": 164, "quantiles": [0.2]}))
    assert read_settings(tmp_path / "a.json") == Settings(horizon=24, gap=164, quantiles=(0.2,))
    (tmp_path / "b.json").write_text(json.dumps({"horizons": 24}))
    with pytest.raises(ValueError, match="horizons"):
        read_settings(tmp_path / "b.json")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("n_folds: 5\ncosts: [0.001, 0.003]\n")
    assert read_settings(tmp_path / "c.yaml") == Settings(n_folds=5, costs=(0.001, 0.003))


def test_views(spark, make_walk):
    p = Pipeline(spark, "")
    p.__dict__["bars"] = materialise(feed.bars_of_feed(spark.createDataFrame(make_walk(800))))
    names = p.register_views("cw_")
    assert "cw_episodes" in names
    found = spark.sql("SELECT count(*) AS n FROM cw_zone_events e JOIN cw_bars b ON b.symbol = e.symbol AND b.pos = e.decision_pos").first()["n"]
    assert found == p.events("zone_start").count() > 0


def test_model_files_and_requirements(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = materialise(spark.createDataFrame([(float(a), float(2 * a + rng.normal())) for a in rng.normal(size=120)], "a double, short_utility double"))
    fitted, _ = model.train(df, df, ["a"], rounds=5, patience=2, depth=2)
    for _ in range(2):
        model.save_model(fitted, str(tmp_path / "m"))
    again = model.load_model(str(tmp_path / "m"))
    one, two = (model.predict(m, df, ["a"]).toPandas().prediction.tolist() for m in (fitted, again))
    assert one == two
    model.require({"train": 50, "val": 20, "test": 20}, model.LEAST_RUN)
    with pytest.raises(ValueError, match="val 19 of 20"):
        model.require({"train": 100, "val": 19, "test": 20}, model.LEAST_RUN)


def test_widened_pools(spark):
    rows = [(k, s, 10 * i) for k, sizes in {"a": (3, 2, 5), "b": (1, 4, 5), "c": (1, 1, 1)}.items() for s, n in zip(("test", "val", "train"), sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, split string, decision_pos long")
    got = ev.widened_pool(df, ["k"], 3).groupBy("k", "pool").count().toPandas().set_index("k")
    assert got.pool.to_dict() == {"a": "test", "b": "val+test", "c": "train+val+test"} and got["count"].to_dict() == {"a": 3, "b": 5, "c": 3}
    assert ev.widened_pool(df.limit(0), ["k"], 3).count() == 0
    few = ev.with_few_flag(df.groupBy("k").agg(ev.F.count("*").alias("sample_count"))).toPandas().set_index("k").few.to_dict()
    assert few == {"a": False, "b": False, "c": True}


def test_only_small_results_reach_the_driver(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_ROWS", 5)
    with pytest.raises(ValueError, match="write a table"):
        sinks.write_json(spark.range(6), tmp_path / "x.json")
    assert sinks.markdown_table(spark.range(5)).count("\n") == 6
    sinks.write_table(spark.range(1000).selectExpr("id", "'A' AS symbol"), str(tmp_path / "t"), files=4)
    assert 1 <= len(list((tmp_path / "t" / "symbol=A").glob("*.parquet"))) <= 4 and spark.read.parquet(str(tmp_path / "t")).count() == 1000


def test_p_values_against_closed_forms(spark):
    """Student's t with one, two and three degrees of freedom has its tails in closed form."""
    rows = [(n, r) for n in (3, 4, 5) for r in (-0.9, -0.3, 0.0, 0.1, 0.5, 0.99, 1.0)] + [(2, 0.5), (5, None)]
    df = spark.createDataFrame(rows, "n long, pearson double").withColumn("spearman", ev.F.col("pearson"))
    for g in ev.with_p_values(df).collect():
        if g["n"] < 3 or g["pearson"] is None:
            assert g["pearson_p"] is None
            continue
        k, r = g["n"] - 2, abs(g["pearson"])
        t = np.inf if r == 1 else r * np.sqrt(k / (1 - r * r))
        one = 2 / np.pi * np.arctan(t)
        two = 1.0 if np.isinf(t) else t / np.sqrt(2 + t * t)
        x = t / np.sqrt(3)
        three = 1.0 if np.isinf(t) else 2 / np.pi * (x / (1 + x * x) + np.arctan(x))
        assert g["pearson_p"] == g["spearman_p"] == pytest.approx(1 - {1: one, 2: two, 3: three}[k], abs=1e-12)
