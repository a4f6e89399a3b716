"""A mix of sources with target shares of the tokens, by weighted sampling without replacement per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.functions.salting import salted_join
from candlewright.llm.tokens import VOCABULARY, token_counter
from candlewright.session import materialise


def post_quality() -> Column:
    """Weight of a post: grows with the logarithm of its votes, half as much again if accepted; never below 1."""
    votes = F.greatest(F.coalesce(F.col("votes"), F.lit(0)), F.lit(0))
    return (1.0 + F.log1p(votes.cast("double"))) * F.when(F.coalesce(F.col("is_accepted"), F.lit(False)), 1.5).otherwise(1.0)


def sampling_key(ident: Column, weight: Column, seed: int) -> Column:
    """Exponential with rate ``weight``: -ln(u) / weight, u from a hash of ``ident``. The least keys are the sample."""
    u = (F.xxhash64(F.lit(seed), ident).bitwiseAND(F.lit(2**53 - 1)).cast("double") + 0.5) / float(2**53)
    return -F.ln(u) / weight


def mix(
    documents: DataFrame,
    targets: DataFrame,
    weight: Column | None = None,
    vocabulary: str = VOCABULARY,
    seed: int = 42,
    cuts: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """``(mixed, report)`` for a mix as large as the whole table.

    mixed: (doc_id, source, tokens, uses), documents used at least once. report, one row a target
    source: source, target_share, max_repeats, documents, tokens, budget, epochs, reached, share (of all reached
    tokens), share_of_size (of the intended size, what the budget asks for), exhausted.

    A source's budget is target_share times the tokens of all documents, those without a source
    included. It is used up in complete epochs (every document once) as often as they fit and max_repeats allows;
    the rest is filled by documents in order of their sampling keys, each taken if at least half of
    it lies within the budget. A source that falls short with max_repeats epochs is exhausted; one
    without documents is, unless its share is 0. NULL or empty texts have no tokens and are used in
    complete epochs only. A NULL share counts as 0, NULL max_repeats as 1; documents whose source is no
    target, or NULL, are left out of the mix. Repeated rows count each.

    Texts are tokenized once into the checkpoint folder. Tokens are summed per source and key
    bucket; only the one bucket where a budget ends is ordered, so no source is sorted as a whole. Buckets are a source's
    own: ``cuts`` sketched quantiles of its keys, and as many equal steps between two of them, so that they are alike
    whatever the weights' scale.
    """
    weight = post_quality() if weight is None else weight
    tokens = token_counter(documents.sparkSession, vocabulary)
    key = sampling_key(F.col("doc_id"), F.greatest(weight, F.lit(1e-9)), seed)
    sized = materialise(documents.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), key.alias("_key")))
    points = sized.groupBy("source").agg(F.percentile_approx("_key", [i / cuts for i in range(cuts + 1)], 10_000).alias("_points"))
    sized = salted_join(sized, points, "source", "doc_id")
    coarse = F.greatest(F.size(F.filter("_points", lambda q: q <= F.col("_key"))) - 1, F.lit(0))
    low, high = F.get("_points", coarse), F.coalesce(F.get("_points", coarse + 1), F.get("_points", F.lit(cuts)))
    step = F.coalesce(F.floor(F.try_divide(F.col("_key") - low, high - low) * cuts), F.lit(0))
    sized = sized.withColumn("_bucket", (coarse * cuts + F.greatest(F.lit(0), F.least(step, F.lit(cuts - 1)))).cast("int")).drop("_points")
    sums = sized.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_d"))
    size = sums.agg(F.sum("_t")).first()[0] or 0  # one number
    per_source = sums.groupBy("source").agg(F.sum("_t").alias("tokens"), F.sum("_d").alias("documents"))
    want = targets.select(
        F.col("source").alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"),
    )
    plan = want.join(per_source, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)), "documents": F.coalesce("documents", F.lit(0)), "budget": F.col("target_share") * F.lit(float(size))})
    plan = plan.withColumn("epochs", F.least("max_repeats", F.floor(F.coalesce(F.try_divide("budget", "tokens"), F.lit(0.0)))))
    plan = plan.withColumns(
        {
            "exhausted": F.col("max_repeats") * F.col("tokens") < F.col("budget"),
            "_rest": F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("tokens")).otherwise(0.0),
        }
    )
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = sums.join(plan.select("source", "epochs", "_rest"), "source").select(
        "source", "_bucket", "epochs", "_rest", "_t", F.coalesce(F.sum("_t").over(run), F.lit(0)).alias("_before")
    )
    steps = steps.withColumn("_state", F.when(F.col("_before") + F.col("_t") <= F.col("_rest"), 1).when(F.col("_before") >= F.col("_rest"), 0).otherwise(2)).drop("_t")
    placed = sized.join(steps, ["source", "_bucket"])
    whole = placed.filter(F.col("_state") < 2).withColumn("_picked", F.when(F.col("tokens") > 0, F.col("_state")).otherwise(0))
    order = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    half = F.col("_before") + F.sum("tokens").over(order) - F.col("tokens") / 2
    edge = placed.filter(F.col("_state") == 2).withColumn("_picked", F.when((half <= F.col("_rest")) & (F.col("tokens") > 0), 1).otherwise(0))
    used = whole.unionByName(edge).select("doc_id", "source", "tokens", (F.col("epochs") + F.col("_picked")).alias("uses"))
    mixed = used.filter(F.col("uses") > 0)
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("reached"))
    report = plan.join(reached, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    share = F.try_divide(F.col("reached").cast("double"), F.sum("reached").over(Window.partitionBy(F.lit(1))))  # one row a target source
    return mixed, report.select("source", "target_share", "max_repeats", "documents", "tokens", "budget", "epochs", "reached", share.alias("share"), F.try_divide(F.col("reached").cast("double"), F.lit(float(size))).alias("share_of_size"), "exhausted")
