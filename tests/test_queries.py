"""The registered queries: contract, and a part of them against DuckDB."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from candlewright.plans import general_queries, reference_queries, reference_sql

DATA = "/root/testdata/sf0.001"
CORE = reference_queries.QUERIES | general_queries.QUERIES
CORE_SQL = reference_sql.SQL | general_queries.SQL


def value(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, int, float)):
        return round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("name", ["src_feed_bars", "chk_report", "ind_1_2_averages", "feat_27", "scn_5_stats", "anc_events", "wf_1_folds", "agg_1_group_stats", "trg_flags", "p1_found", "p1_rolling_totals"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = CORE[name](spark, DATA)
    want = con.execute(CORE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    ours = rows(got.columns, got.collect())
    assert ours == rows(names, want.fetchall()) and ours


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_outside_the_folder_imports_llm():
    root = Path(entry.__file__).parent / "candlewright"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"candlewright\.llm|from \.llm|import llm", f.read_text()), f


def test_sinks_of_the_library_do_not_use_local_checkpoints():
    root = Path(entry.__file__).parent / "candlewright"
    assert not [f for f in root.rglob("*.py") if "localCheckpoint" in f.read_text()]
