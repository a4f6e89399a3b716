"""Global row numbers without one task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewright.session import materialise


def number_rows(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``_number`` (0-based along ``order``, which must tell all rows apart), and their count.

    Rows are ranged into partitions and written to the checkpoint folder, so that the partitions stay what
    they are; within each they are numbered from the count of those before.
    """
    ranged = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    if not total:
        return ranged.drop("_part").withColumn("_number", F.lit(None).cast("bigint")), 0
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_part"))
    number = (start + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).cast("bigint")
    return ranged.withColumn("_number", number).drop("_part"), total
