"""Mixes: budgets, repeats, shortfalls, and weighted choice."""

import numpy as np
from pyspark.sql import functions as F

from candlewright.llm import mixing

DOC = "doc_id bigint, text string, source string, votes int, is_accepted boolean, budget string, _key double"
TARGET = "source string, target_share double, max_repeats int, tokens string"


def doc(i, words, source, votes=0, accepted=False):
    return (i, "alpha " * words if words else None, source, votes, accepted, "clash", 0.0)


def mix(spark, docs, targets, **kw):
    mixed, report = mixing.mix(spark.createDataFrame(docs, DOC), spark.createDataFrame(targets, TARGET), **kw)
    return mixed.toPandas(), report.toPandas().set_index("source")


def test_budgets(spark):
    docs = [doc(i, 20, "big") for i in range(400)] + [doc(1000 + i, 20, "small") for i in range(10)] + [doc(2000 + i, 20, "tiny") for i in range(3)] + [doc(3000, 20, None), doc(3001, 0, "small"), doc(3002, 20, "other")]
    targets = [("big", 0.5, 3, ""), ("small", 0.1, 8, ""), ("tiny", 0.3, 2, ""), ("absent", 0.1, 5, ""), ("zero", 0.0, 1, "")]
    mixed, report = mix(spark, docs, targets, cuts=2)
    size = sum(20 * (d[1] is not None) for d in docs) * len("a") and report.tokens["small"] / 10
    total = size * 415
    assert report.budget["big"] == 0.5 * total and report.exhausted.to_dict() == {"big": False, "small": False, "tiny": True, "absent": True, "zero": False}
    assert abs(report.reached["big"] - 0.5 * total) <= size / 2 and abs(report.reached["small"] - 0.1 * total) <= size / 2
    assert report.reached["tiny"] == 2 * 3 * size and report.reached["absent"] == 0
    assert abs(report.share.sum() - 1) < 1e-9 and report.share_of_size["tiny"] == report.reached["tiny"] / total < report.share["tiny"]
    uses = mixed[mixed.tokens > 0].groupby("source").uses.agg(["min", "max"])
    assert uses.loc["big"].tolist() == [1, 1] and uses.loc["tiny"].tolist() == [2, 2] and uses.loc["small", "max"] - uses.loc["small", "min"] <= 1 and uses["max"].max() <= 8
    assert set(mixed.source) == {"big", "small", "tiny"}
    again, _ = mix(spark, docs[::-1], targets, cuts=64)
    assert set(again[again.source == "big"].doc_id) == set(mixed[mixed.source == "big"].doc_id)


def test_weights_raise_the_chance(spark):
    docs = [doc(i, 20, "s", votes=200 * (i % 2), accepted=bool(i % 2)) for i in range(1000)]
    mixed, _ = mix(spark, docs, [("s", 0.3, 1, "")])
    assert 290 <= len(mixed) <= 310 and (mixed.doc_id % 2).mean() > 0.75


def test_buckets_do_not_depend_on_the_scale_of_weights(spark):
    """Weights a million times as large choose alike, and no bucket holds much of a source."""
    docs = [doc(i, 20, "s", votes=i % 7) for i in range(1500)]
    one, _ = mix(spark, docs, [("s", 0.3, 1, "")])
    two, _ = mix(spark, docs, [("s", 0.3, 1, "")], weight=mixing.post_quality() * 1e6)
    assert set(one.doc_id) == set(two.doc_id) and len(one) == 450


def test_keys_follow_the_weighted_law(spark):
    keys = spark.range(4000).select(mixing.sampling_key(F.col("id"), F.lit(2.0), 1)).toPandas().iloc[:, 0]
    assert abs(keys.mean() - 0.5) < 0.03 and abs(np.exp(-2 * keys).mean() - 0.5) < 0.02


def test_edges(spark):
    mixed, report = mix(spark, [], [("a", 1.0, 1, "")])
    assert len(mixed) == 0 and not report.exhausted["a"] and np.isnan(report.share["a"])
    mixed, report = mix(spark, [doc(1, 5, "a", votes=None)], [("a", None, None, "")])
    assert len(mixed) == 0 and report.budget["a"] == 0
    mixed, report = mix(spark, [doc(1, 5, "a")], [])
    assert len(mixed) == 0 and len(report) == 0
    mixed, report = mix(spark, [doc(7, 5, "a"), doc(7, 5, "a")], [("a", 1.0, 3, "")])
    assert mixed.uses.tolist() == [1, 1]
