"""Queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import digest, mixing, packing, residue, runs, sampling
from candlewright.session import read_table


def _draw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.draw(*[read_table(spark, sf_dir, t) for t in ("bars", "sample_targets", "anchored_events")])


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draw(spark, sf_dir)[0]


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draw(spark, sf_dir)[1].withColumn("reached_share", F.round("reached_share", 6))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draw(spark, sf_dir)[1].filter("exhausted").select("request_id", "bucket_id")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.bar_percentiles(read_table(spark, sf_dir, "bars"))


def p3_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ``p3_percentiles`` what SQL can say: the readings of each group, and that every rank, counted exactly, lies within its bound."""
    return p3_percentiles(spark, sf_dir).select("overall", "symbol", "column", "quantile", "n", "within_bound")


def p5_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_episodes(read_table(spark, sf_dir, "episodes")).select("symbol", "cell", "first_row_id", "last_row_id", "n_events", F.round("seconds", 3).alias("seconds"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_episodes(read_table(spark, sf_dir, "episodes")).filter("n_events > 1").select("first_row_id", "last_row_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_containers(spark, sf_dir).filter("piece = 1").select("doc_id")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1].filter("exhausted").select("source")


def p8_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_evidence(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_posts(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_sample": p2_sample,
    "p3_percentiles": p3_percentiles,
    "p3_certified": p3_certified,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p6_found": p6_found,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_evidence": p8_evidence,
}
