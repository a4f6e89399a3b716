"""Collapsed runs: against a loop, over bucket edges, and the edges of the input."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import runs

SCHEMA = "row_id bigint, symbol string, cell string, emitted_at timestamp, episode_start_pos bigint, episode_end_pos bigint, ma_dispersion_atr double, n_events string, _canon int"
T0 = dt.datetime(2024, 1, 1)


def loop(rows):
    key = lambda r: (r[3] is not None, r[3] or T0, r[0])
    found = []
    for e in {(r[1], r[2]) for r in rows}:
        last = None
        for r in sorted((r for r in rows if (r[1], r[2]) == e), key=key):
            def near(i, tol):
                a, b = last[i], r[i]
                return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= tol + 1e-9)

            if last is not None and near(4, 2) and near(5, 2) and near(6, 0.02):
                found[-1][1:3] = r[0], found[-1][2] + 1
            else:
                found.append([r[0], r[0], 1])
            last = r
    return sorted(map(tuple, found))


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        at = None if rng.random() < 0.03 else T0 + dt.timedelta(hours=int(rng.integers(0, 150)))
        disp = None if rng.random() < 0.2 else round(0.5 + 0.02 * int(rng.integers(0, 3)), 2)
        rows.append((i, ["A", "B", None][rng.integers(0, 3)], "q", at, int(rng.integers(0, 5)), int(rng.integers(0, 4)) + 10, disp, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    got = runs.collapse_episodes(df).select("first_row_id", "last_row_id", "n_events").collect()
    assert sorted(tuple(r) for r in got) == loop(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many pieces, so that runs cross their edges
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    pieces = runs.collapse_episodes(df).select("first_row_id", "last_row_id", "n_events").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(tuple(r) for r in pieces) == loop(rows)


def test_hot_entity_and_unknown_times(spark):
    """One entity, all times NULL, one run over all pieces but for a break in the middle."""
    rows = [(i, "A", "q", None, 5 if i != 2000 else 50, 10, 0.5, "x", 0) for i in range(4000)]
    got = runs.collapse_episodes(spark.createDataFrame(rows, SCHEMA)).select("first_row_id", "last_row_id", "n_events").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1999, 2000), (2000, 2000, 1), (2001, 3999, 1999)]


def test_difference_of_row_numbers_identifies_runs(spark):
    """An event that comes back later has the same canonical event; only the difference tells its runs apart."""
    starts = [0, 1, 9, 0, 0, 9, 9, 0, 2, 4, 0, 2, 0]  # the drift 0, 2, 4 jumps back to 0
    rows = [(i, "A", "q", T0 + dt.timedelta(hours=i), v, 10, 0.5, "x", 0) for i, v in enumerate(starts)]
    df = spark.createDataFrame(rows, SCHEMA)
    order, values = [F.col("emitted_at")], {"episode_start_pos": 2}
    canon = runs.canonicalised(df, ["symbol"], order, values)
    seen = [tuple(r) for r in canon.orderBy("row_id").select("_c0", "_variant").collect()]
    assert seen == [(0, 0)] * 2 + [(9, 0)] + [(0, 0)] * 2 + [(9, 0)] * 2 + [(0, 0)] * 3 + [(0, 1)] * 3
    found = runs.islands(canon, ["symbol"], ["_c0", "_variant"], order)
    assert found.groupBy("_c0", "_variant", "_island").count().count() == 6
    assert found.groupBy("_c0", "_variant").count().count() == 3
    got = runs.collapse_episodes(df).select("first_row_id", "last_row_id", "n_events").collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 6, 2), (7, 9, 3), (10, 12, 3)]


def test_drift_time_and_edges(spark):
    rows = [(i, "A", "q", T0 + dt.timedelta(hours=20 * i), 2 * i, 10, 0.5, "x", 0) for i in range(5)]
    got = runs.collapse_episodes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 1 and got[0]["seconds"] == 80 * 3600 and got[0]["n_events"] == 5
    assert runs.collapse_episodes(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [rows[0]] * 3
    got = runs.collapse_episodes(spark.createDataFrame(same, SCHEMA)).first()
    assert got["n_events"] == 3 and got["seconds"] == 0.0
    nan = [(0, "A", "q", T0, 1, 1, float("nan"), "", 0), (1, "A", "q", T0, 1, 1, None, "", 0), (2, "A", "q", None, None, 1, 0.1, "", 0)]
    got = {r["first_row_id"]: r for r in runs.collapse_episodes(spark.createDataFrame(nan, SCHEMA)).collect()}
    assert got[0]["n_events"] == 2 and got[2]["seconds"] is None
