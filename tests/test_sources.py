"""Feeds, checks, sinks, titles and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import checks
from candlewright.sources import feed, sinks
from candlewright.streaming import bars as live


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv(spark, tmp_path):
    rows = "open_time,ts,open,high,low,close,volume,ts2\n" + "".join(f"x,{1_704_067_200_000 + i * 900_000},1,2,0.5,1.5,{i},0\n" for i in (2, 0, 1, 1))
    df = feed.read_csv(spark, write(tmp_path / "a.csv", rows), "S")
    got = feed.bars_of_feed(df).orderBy("pos").toPandas()
    assert got.pos.tolist() == [0, 1, 2] and got.volume.tolist() == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="close"):
        feed.read_csv(spark, write(tmp_path / "b.csv", "ts,open,high,low,volume\n1,1,1,1,1\n"), "S")
    with pytest.raises(Exception):
        feed.read_csv(spark, write(tmp_path / "c.csv", "ts,open,high,low,close,volume\n1,1,1,1,oops,1\n"), "S").collect()


def test_csv_order_over_files(spark, tmp_path):
    """The first delivery of a bar is the one in the file of the first name, however large the files are and however they are split."""
    head = "ts,open,high,low,close,volume\n"
    line = lambda i, v: f"{1_704_067_200_000 + i * 900_000},1,2,0.5,1.5,{v}\n"
    write(tmp_path / "1.csv", head + line(0, 100))
    write(tmp_path / "2.csv", head + "".join(line(i, i) for i in range(2000)))
    write(tmp_path / "3.csv", head + "".join(line(i, 7) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    df = feed.read_csv(spark, str(tmp_path), "S")
    got = feed.bars_of_feed(df).orderBy("pos").toPandas()
    order = df.orderBy("ingest_seq").toPandas()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.volume.tolist() == [100.0, *range(1, 2000), *[7.0] * 1000]
    assert order.volume.tolist() == [100.0, *range(2000), *[7.0] * 3000] and order.ingest_seq.is_unique


def test_boundary_and_duplicates(spark, make_walk):
    pdf = make_walk(200)
    double = pd.concat([pdf, pdf.iloc[:5].assign(close=1.0, low=0.5, ingest_seq=1000)]).sample(frac=1, random_state=1)
    got = feed.bars_of_feed(spark.createDataFrame(double)).orderBy("pos").toPandas()
    assert len(got) == 200 and got.close.tolist() == pdf.close.tolist()
    cut = feed.bars_of_feed(spark.createDataFrame(pdf), "2024-02-02T00:00:00+00:00")
    assert cut.count() == 96


def test_checks(spark, make_walk):
    pdf = make_walk(100).drop(index=[10, 11, 50])
    steps = spark.createDataFrame([("A", 15)], "symbol string, bar_minutes int")
    report = checks.check_report(spark.createDataFrame(pdf), steps)
    r = report.first()
    assert r["passed"] and r["n_gaps"] == 2 and r["rows_final"] == 97
    checks.require(report)
    gaps = checks.gap_census(spark.createDataFrame(pdf), steps).orderBy("after_ts").toPandas()
    assert gaps.gap_bars.tolist() == [3.0, 2.0]
    bad = pdf.copy()
    bad.loc[20, "high"], bad.loc[21, "volume"], bad.loc[22, "ts"] = 1.0, -1.0, bad.ts[22] + 7
    broken = checks.check_report(spark.createDataFrame(bad), steps)
    r = broken.first()
    assert (r["bound_violations"], r["negative_volumes"], r["off_grid"], r["passed"]) == (1, 1, 1, False)
    with pytest.raises(ValueError, match="bound_violations 1"):
        checks.require(broken)
    with pytest.raises(ValueError, match="no rows"):
        checks.require(report.limit(0))


def test_event_bars(spark):
    rows = [(1, "2024-01-01 00:01:00", 5.0), (2, "2024-01-01 00:01:00", 7.0), (3, "2024-01-01 00:14:59", 1.0), (4, "2024-01-01 00:15:00", 9.0)]
    df = spark.createDataFrame(rows, "event_id bigint, t string, value double").withColumn("ts", F.to_timestamp_ntz("t"))
    got = feed.bars_of_events(df, F.lit("x"), F.col("value")).orderBy("ts").toPandas()
    assert got[["open", "high", "low", "close", "volume"]].values.tolist() == [[5.0, 7.0, 1.0, 1.0, 3.0], [9.0] * 4 + [1.0]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 0.5), ("B", 2, None)], "symbol string, n bigint, x double")
    sinks.write_table(df, str(tmp_path / "t"))
    assert feed.read_bars(spark, str(tmp_path / "t")).count() == 2
    sinks.write_json(df.orderBy("n"), tmp_path / "m.json")
    assert sinks.read_json(tmp_path / "m.json")[0] == {"symbol": "A", "n": 1, "x": 0.5}
    report = tmp_path / "r.md"
    sinks.write_report("# one\n" + sinks.markdown_table(df.orderBy("n")), report, "<!-- keep -->")
    report.write_text(report.read_text() + "my notes")
    sinks.write_report("# two", report, "<!-- keep -->")
    assert "my notes" in report.read_text() and "# one" not in report.read_text()
    assert sinks.content_hash(df) == sinks.content_hash(df.orderBy(F.desc("n"))) != sinks.content_hash(df.limit(1))
    source = tmp_path / "m.json"
    first = sinks.cache_key({"a": 1}, [source])
    assert first != sinks.cache_key({"a": 2}, [source]) and first == sinks.cache_key({"a": 1}, [source])
    json.dumps(sinks.manifest({"t": df}, {}, {"a": 1}))


def test_decision_title_is_blind(spark):
    row = ("top", 1, 7, 0.5, "test", "local_low_break", None, 1.0, 2.0, 3.0, 0.01, 0.009)
    df = spark.createDataFrame([row], "review_set string, place int, event_id int, prediction double, split string, trigger_type string, episode_age int, short_utility double, mfe_short double, mae_short double, gross_return double, net_return double").withColumn("decision_ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    decision, outcome = df.select(*sinks.review_titles()).first()
    assert not any(w in decision for w in sinks.OUTCOME_WORDS) and all(w in outcome for w in sinks.OUTCOME_WORDS)
    assert decision == "top #1 id=7 pred=0.500 2024-01-01 10:00 (test) trig=local_low_break"


def run_stream(spark, df, name, folder):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(folder)).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).toPandas()


def test_stream_bars_equal_batch(spark, tmp_path, make_walk):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    got = run_stream(spark, live.stream_bars(source, F.col("event_type"), F.col("value")), "bars_out", tmp_path / "a")
    want = feed.bars_of_events(events, F.col("event_type"), F.col("value")).toPandas()
    both = got.merge(want, on=["symbol", "ts"])
    assert len(both) == len(got) > 0.9 * len(want) and (both.close_x == both.close_y).all() and (both.volume_x == both.volume_y).all()


def test_stream_mean_equals_pandas(spark, tmp_path, make_walk):
    pdf = make_walk(60)[["symbol", "ts", "close"]]
    for i, part in enumerate((pdf[:25], pdf[25:])):
        spark.createDataFrame(part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = spark.readStream.schema("symbol string, ts bigint, close double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = run_stream(spark, live.stream_mean(source, 20), "mean_out", tmp_path / "b").sort_values("ts")
    if len(got) == 60:
        want = pdf.close.ewm(span=20, adjust=False).mean()
        assert got["mean"].isna().sum() == 19
        assert (got["mean"].to_numpy()[19:] - want.to_numpy()[19:]).max() < 1e-9
    else:  # the later file came first: the earlier bars are late
        assert len(got) == 35
