"""Joins with a per-key table that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(rows: DataFrame, per_key: DataFrame, key: str | Sequence[str], spread_by: str, salts: int = 32, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key`` (few rows a key), NULL keys matching.

    Should the planner shuffle this join, a key's rows go to ``salts`` places by the hash of
    ``spread_by``; ``per_key`` is repeated that often, which is small beside ``rows``.
    Whether to broadcast is left to the planner, which knows sizes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int"))
    right = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = left["_salt"] == right["_salt2"]
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_key_{k}"])
    return left.join(right, same, how).drop("_salt", "_salt2", *[f"_key_{k}" for k in keys])


#: Rows of a narrow table (some 100 bytes each) that may be sent to every executor.
MOST_BROADCAST = 100_000


def sized_join(rows: DataFrame, per_key: DataFrame, key: str | Sequence[str], spread_by: str, n_rows: int, salts: int = 32, how: str = "inner") -> DataFrame:
    """``salted_join`` with a narrow table of ``n_rows`` rows, counted before: broadcast as it is up to ``MOST_BROADCAST``, never beyond.

    The planner goes by file sizes, which say little of a compressed table repeated for its salts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if n_rows > MOST_BROADCAST:
        return salted_join(rows, per_key.hint("merge"), keys, spread_by, salts, how)
    right = F.broadcast(per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys}))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(right[f"_key_{k}"])
    return rows.join(right, same, how).drop(*[f"_key_{k}" for k in keys])
