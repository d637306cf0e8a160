"""Streams give the same rows whatever the order of rows and the cut into micro-batches."""

import glob
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alphaloom.streaming import io
from alphaloom.streaming import stateful as ST
from alphaloom.streaming import windows as WN

SF = "/root/testdata/sf0.001"


def _events(spark, path, files=None):
    return WN.ticks(io.file_stream(spark, path, files)).withColumnRenamed("event_id", "seq")


MACHINES = {
    "exits": ST.position_exits,
    "breaker": lambda e: ST.circuit_breaker(e, 0.10, 0.20),
    "health": ST.factor_health,
    "stale": lambda e: ST.staleness_alerts(e, 12.0, 24.0),
}


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """The events in four files by time, each reversed within; the paths of the files in order of time."""
    out = str(tmp_path_factory.mktemp("events") / "cut")
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for p in (1, 2, 3, 4):
        e.where(F.col("part") == p).drop("part").coalesce(1).sort(F.desc("ts")).write.parquet(f"{out}/{p}")
    return [f"{out}/{p}" for p in (1, 2, 3, 4)]


def _read_in_order(spark, cut, order, tmp_path):
    """A folder whose files have the modification times of the given order: the source takes the oldest first."""
    for k, p in enumerate(order):
        src = glob.glob(f"{cut[p]}/*.parquet")[0]
        dst = tmp_path / f"{k}.parquet"
        shutil.copy(src, dst)
        os.utime(dst, (1_700_000_000 + 10 * k,) * 2)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return WN.ticks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))).withColumnRenamed("event_id", "seq")


def _input(name, e):
    return {"breaker": e.select(F.col("ticker").alias("series_id"), "ts", "seq", (100 + F.col("price")).alias("value")),
            "health": e.select((F.col("ticker") % 3).cast("string").alias("factor"), "ts", "seq", (F.col("price") / 100 - 0.3).alias("ic_ir"), F.lit(6).alias("n"))}.get(name, e)


def _rows(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", list(MACHINES))
def test_order_does_not_matter(spark, cut, name, tmp_path):
    whole = _rows(ST.settled(_input(name, _events(spark, f"{SF}/events.parquet")), MACHINES[name], name))
    assert whole
    if name in ("breaker", "health"):
        assert len(whole) == spark.read.parquet(f"{SF}/events.parquet").count()
    for k, order in enumerate([(3, 2, 1, 0), (1, 3, 0, 2)][: 2 if name == "breaker" else 1]):
        (folder := tmp_path / str(k)).mkdir()
        changes = ST.run_to_end(_input(name, _read_in_order(spark, cut, order, folder)), MACHINES[name], name)
        assert _rows(ST.net(changes)) == whole
        assert ST.too_late(changes).count() == 0
        if name == "breaker":
            assert changes.where("op = '-'").count() > 0       # late rows have corrected decisions


def _stream(spark, folder, rows, schema="ticker long, ts timestamp, price double, seq long"):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"in/{k}"))
        for f in glob.glob(str(folder / f"in/{k}/*.parquet")):
            os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))


def _t(day, hour=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour)


def test_longest_holding_ends_without_a_tick(spark, tmp_path):
    """Another ticker's time passes the deadline; an earlier row that comes later takes the exit back."""
    files = [[(1, _t(0), 10.0, 1), (1, _t(1), 10.1, 2), (None, _t(1), 1.0, 9), (2, None, 1.0, 9)], [(2, _t(80), 5.0, 3)]]
    got = ST.settled(_stream(spark, tmp_path / "a", files), ST.position_exits).collect()
    assert [(r["ticker"], r["exit_ts"], r["exit_price"], r["reason"]) for r in got] == [(1, _t(60), 10.1, "max_hold")]
    files += [[(2, _t(81), 5.0, 5)], [(1, _t(5), 20.0, 4)]]
    changes = ST.run_to_end(_stream(spark, tmp_path / "b", files), ST.position_exits)
    assert [r["reason"] for r in changes.where("op = '-'").collect()] == ["max_hold"]
    assert [(r["exit_ts"], r["reason"]) for r in ST.net(changes).collect()] == [(_t(5), "profit_target")]


def test_rows_beyond_the_bound_are_handed_on(spark, tmp_path):
    files = [[(1, _t(0), 100.0, 1), (1, _t(10), 100.0, 2)], [(1, _t(20), 100.0, 3)], [(1, _t(30), 100.0, 4)], [(1, _t(28), 50.0, 5), (1, _t(1), 1.0, 6)]]
    e = _stream(spark, tmp_path, files).select(F.col("ticker").alias("series_id"), "ts", "seq", F.col("price").alias("value"))
    changes = ST.run_to_end(e, lambda x: ST.circuit_breaker(x, keep="5 days"))
    assert [r["late_ts"] for r in ST.too_late(changes).collect()] == [_t(1)]
    assert sorted((r["ts"], r["decision"]) for r in ST.net(changes).collect()) == [(_t(0), "ok"), (_t(10), "ok"), (_t(20), "ok"), (_t(28), "daily_loss"), (_t(30), "ok")]


def test_signals_wait_until_due(spark, tmp_path):
    from datetime import date
    bars = spark.createDataFrame([(1, date(2024, 1, d), float(d)) for d in range(1, 29)], "ticker long, d date, close double")
    for k, rows in enumerate([[(1, date(2024, 1, 1), date(2024, 1, 10), 0.5)], [(1, date(2024, 1, 2), date(2024, 2, 20), 0.1)], [(1, date(2024, 1, 3), date(2024, 1, 5), 0.2)]]):
        spark.createDataFrame(rows, "ticker long, signal_date date, fwd_due_date date, score double").coalesce(1).write.parquet(str(tmp_path / f"s/{k}"))
    s = spark.readStream.schema("ticker long, signal_date date, fwd_due_date date, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s/*"))
    ST.fill_due_signals(s, bars, F.lit("2024-01-20").cast("date"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["signal_date"].day for r in got.collect()) == [1, 3]
