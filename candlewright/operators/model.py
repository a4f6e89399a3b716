"""A boosted ranker over event datasets, its early stopping, importances, and gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.functions.numbering import number_rows
from candlewright.functions.ranks import correlation
from candlewright.session import materialise

TARGET = "short_utility"
# Least events in each split for a run to go on, and for two arms to be compared.
LEAST_RUN = {"train": 50, "val": 20, "test": 20}
LEAST_COMPARED = {"train": 100, "val": 20, "test": 20}


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with a ``features`` vector; rows with an unknown feature are left out."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows)


def first_rounds(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first ``n`` rounds."""
    java, context = model._java_obj, SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml.regression
    trees, weights = context._gateway.new_array(ml.DecisionTreeRegressionModel, n), context._gateway.new_array(context._jvm.double, n)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:n], list(java.treeWeights())[:n])):
        trees[i], weights[i] = tree, weight
    return model._copyValues(GBTRegressionModel(ml.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())))


def train(train_rows: DataFrame, val_rows: DataFrame, features: Sequence[str], rounds: int = 300, patience: int = 50, depth: int = 5, step: float = 0.03, row_share: float = 0.8, column_share: float = 0.8, seed: int = 42) -> tuple[GBTRegressionModel, dict]:
    """(model, info): gradient-boosted trees on short_utility, cut at the round of least validation error.

    The best round is the last before ``patience`` rounds without improvement. Trees grow level by level, so
    results are not those of a leaf-wise learner. info: best_iteration, n_features, importance
    (normalised, greatest first).
    """
    fit, val = materialise(assemble(train_rows, features).select("features", TARGET)), materialise(assemble(val_rows, features).select("features", TARGET))
    learner = GBTRegressor(featuresCol="features", labelCol=TARGET, maxDepth=depth, stepSize=step, subsamplingRate=row_share, featureSubsetStrategy=str(column_share), seed=seed)
    grown = min(rounds, patience + 25)
    while True:
        # a shorter fit is a prefix of a longer one, so no more rounds are grown than patience asks for
        full = learner.setMaxIter(grown).fit(fit)
        best, least, stopped = 0, math.inf, False
        for i, e in enumerate(full.evaluateEachIteration(val, "squared")):
            if e < least:
                best, least = i, e
            elif i - best >= patience:
                stopped = True
                break
        if stopped or grown == rounds:
            break
        grown = min(rounds, 2 * grown)
    model = full if best + 1 == grown else first_rounds(full, best + 1)
    gains = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda kv: (-kv[1], kv[0]))
    return model, {"best_iteration": best + 1, "n_features": len(features), "importance": dict(gains)}


def save_model(model: GBTRegressionModel, path: str) -> None:
    """The model as files in a folder that all executors share; what stood there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def require(counts: dict[str, int], least: dict[str, int]) -> None:
    """Raises ValueError, naming the splits, where one has fewer rows than it needs."""
    short = {s: counts.get(s, 0) for s, n in least.items() if counts.get(s, 0) < n}
    if short:
        raise ValueError("too few events: " + ", ".join(f"{s} {k} of {least[s]}" for s, k in short.items()))


def predict(model: GBTRegressionModel, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(rows, features)).drop("features")


def baseline_score() -> Column:
    """Tighter compression ranks higher."""
    return -F.col("ma_dispersion_atr")


def gate(counts: DataFrame, keys: Sequence[str], least: dict[str, int]) -> DataFrame:
    """Per group: its size in each split and whether all reach their minimum, from (keys, split) rows."""
    sizes = counts.groupBy(*keys).agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in least])
    ok = F.lit(True)
    for s, n in least.items():
        ok = ok & (F.col(f"n_{s}") >= n)
    return sizes.withColumn("passes_gate", ok)


def shuffled(number: Column, n: int, key: Column) -> Column:
    """Where ``number`` (0 to n - 1) goes in a pseudo-random permutation of these numbers; another ``key``, another permutation.

    A Feistel network of four rounds permutes a square of at least n numbers, and is applied until the result lies below n: each row
    finds its place by itself. The number of steps leaves a row outside with a probability under 1e-18.
    """
    side = math.isqrt(max(n - 1, 0)) + 1
    outside = 1 - n / side**2
    steps = max(1, math.ceil(math.log(1e-18) / math.log(outside))) if outside > 0 else 1

    def once(x: Column) -> Column:
        halves = F.struct(F.floor(x / side).cast("bigint").alias("l"), (x % side).cast("bigint").alias("r"))
        turn = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(F.xxhash64(key, i, s["r"]), F.lit(side)), F.lit(side)).cast("bigint").alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(4)]), halves, turn, lambda s: s["l"] * side + s["r"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), number.cast("bigint"), lambda x, i: F.when((i > 1) & (x < n), x).otherwise(once(x)))


def permutation_importance(model: GBTRegressionModel, rows: DataFrame, features: Sequence[str], order: Sequence[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, mean_drop, baseline): mean fall of the rank correlation when one feature's values are permuted.

    Rows are numbered once, and ``shuffled`` numbers say whose value each row gets, so that permuted
    values come by an equi-join on row numbers. All features and repeats are scored in one transform.
    """
    numbered, n = number_rows(assemble(rows, features).select(*order, TARGET, vector_to_array("features").alias("_v")), order)
    if n < 3:
        raise ValueError(f"too few rows ({n})")
    plans = [F.struct(F.lit(j).alias("j"), F.lit(r).alias("r")) for j in range(len(features)) for r in range(repeats)]
    spread = numbered.withColumn("_p", F.explode(F.array(*plans)))
    spread = spread.withColumn("_from", shuffled(F.col("_number"), n, F.xxhash64(F.lit(seed), "_p.j", "_p.r")))
    values = numbered.select(F.col("_number").alias("_from"), F.col("_v").alias("_w"))
    swapped = spread.join(values, "_from").withColumn("_v", F.transform("_v", lambda x, i: F.when(i == F.col("_p.j"), F.get(F.col("_w"), i)).otherwise(x)))
    scored = model.transform(swapped.select(TARGET, "_p.j", "_p.r", array_to_vector("_v").alias("features"))).drop("features")
    rho = correlation(scored, ["j", "r"], "prediction", TARGET)
    base = correlation(model.transform(numbered.select(TARGET, array_to_vector("_v").alias("features"))).withColumn("k", F.lit(1)), ["k"], "prediction", TARGET).first()["spearman"]
    names = F.array(*[F.lit(f) for f in features])
    drops = rho.groupBy("j").agg(F.avg(F.lit(base).cast("double") - F.coalesce("spearman", F.lit(0.0))).alias("mean_drop"))
    return drops.select(F.get(names, F.col("j")).alias("feature"), "mean_drop", F.lit(base).cast("double").alias("baseline"))
