"""The shared folder: named by the session, an error on a cluster without one, and empty after a clean-up."""

import os
from types import SimpleNamespace

import pytest

from candlewright import session
from candlewright.plans import general_queries


def test_cluster_without_a_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    other = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(other)
    named = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: "hdfs://x/shared/"))
    assert session.shared_folder(named) == "hdfs://x/shared"


def test_tables_are_dropped(spark):
    general_queries.p4_found(spark, "/root/testdata/sf0.001").count()
    folder = session.scratch_folder(spark).removeprefix("file:")
    assert os.listdir(folder)
    session.drop_tables(spark)
    assert not os.path.exists(folder)
