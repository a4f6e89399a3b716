"""Digests: bounded and certified rank errors, exact merges of counts, and edges."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.llm import digest

SCHEMA = "symbol string, pos bigint, ma_dispersion_atr double, atr_14 double, loaded_at timestamp, column string, value double, weight double"
T0 = dt.datetime(2024, 1, 1)


def bars(spark, pdf):
    rows = [(r.symbol, int(r.pos), r.d, r.a, T0, "clash", 1.0, 1.0) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, SCHEMA)


def test_rank_errors(spark):
    rng = np.random.default_rng(1)
    n = 6000
    pdf = pd.DataFrame({"symbol": np.repeat(["A", "B"], [n, 300]), "pos": np.r_[:n, :300]})
    pdf["d"] = np.where(rng.random(len(pdf)) < 0.3, 1.0, rng.lognormal(0, 2, len(pdf)))  # many ties
    pdf["a"] = rng.normal(size=len(pdf))
    pdf.loc[::50, "a"] = np.nan
    got = digest.bar_percentiles(bars(spark, pdf).unionByName(bars(spark, pdf.iloc[:500])), part_rows=1000, fan_in=3).toPandas()
    assert len(got) == 3 * 2 * 7 and got.within_bound.all() and (got.rank_error < 0.01).all()
    for r in got.itertuples():
        v = pdf[r.column == "atr_14" and ["a"] or ["d"]].iloc[:, 0][(pdf.symbol == r.symbol) | r.overall].dropna()
        assert r.n == len(v)
        below, upto = (v < r.value).mean(), (v <= r.value).mean()
        assert r.rank_error == pytest.approx(max(0, r.quantile - upto, below - r.quantile), abs=1e-12)


def test_merging_keeps_weight_and_ends(spark):
    rng = np.random.default_rng(2)
    values = spark.createDataFrame([(int(i % 7), float(x)) for i, x in enumerate(rng.normal(size=3000))], "part int, value double").withColumn("g", F.lit("x"))
    parts = digest.digest_parts(values, ["g", "part"], 100)
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 101
    merged = digest.cluster(parts.drop("part"), ["g"], 100)
    s = merged.agg(F.sum("weight"), F.min("lo"), F.max("hi"), F.count("*")).first()
    want = values.agg(F.min("value"), F.max("value")).first()
    assert s[0] == 3000 and (s[1], s[2]) == tuple(want) and s[3] <= 101


def test_small_and_missing(spark):
    pdf = pd.DataFrame({"symbol": ["A", "A", None, "C"], "pos": [0, 1, 0, 0], "d": [5.0, 5.0, 2.0, np.nan], "a": [np.nan, None, np.nan, None]})
    got = digest.bar_percentiles(bars(spark, pdf)).toPandas()
    assert set(got.column) == {"ma_dispersion_atr"} and got.within_bound.all()
    assert (got[got.symbol == "A"].value == 5.0).all() and (got[got.symbol.isna() & ~got.overall].value == 2.0).all()
    assert got[got.overall].n.unique().tolist() == [3]
    assert digest.bar_percentiles(bars(spark, pdf.iloc[:0])).count() == 0


def test_infinities_are_readings(spark):
    rng = np.random.default_rng(3)
    d = np.r_[rng.normal(size=880), np.full(60, np.inf), np.full(60, -np.inf)]
    pdf = pd.DataFrame({"symbol": "A", "pos": np.arange(1000), "d": rng.permutation(d), "a": np.where(np.arange(1000) % 2, np.inf, 1.0)})
    got = digest.bar_percentiles(bars(spark, pdf), part_rows=300).filter("NOT overall").toPandas()
    assert got.within_bound.all() and (got.n == 1000).all() and not got.value.isna().any()
    v = got[got.column == "ma_dispersion_atr"].set_index("quantile").value
    assert v[0.01] == v[0.05] == -np.inf and v[0.99] == v[0.95] == np.inf and abs(v[0.5]) < 0.1
    assert set(got[got.column == "atr_14"].value) == {1.0, np.inf}
