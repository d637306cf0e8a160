"""Compaction of a bar store: what stays, what goes, and a reader that is open meanwhile."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from alphaloom.sources import readers as R

NOW = dt.datetime(2024, 1, 10, 12)


def store(spark, path, rows):
    """rows: (ticker, d, close, volume, hours ago or None)."""
    for r in rows:
        df = spark.createDataFrame([r[:4]], "ticker string, d date, close double, volume double")
        stamp = F.lit(None if r[4] is None else NOW - dt.timedelta(hours=r[4])).cast("timestamp")
        R.write_bars(df, path, stamp)


def test_stale_and_superseded_entries_go(spark, tmp_path):
    a, b = dt.date(2020, 1, 2), dt.date(2021, 3, 4)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    store(spark, old, [("A", a, 1.0, 5.0, 30), ("A", b, 2.0, 5.0, 5), ("A", b, 3.0, 6.0, 1), ("B", b, 4.0, None, 24),
                       ("C", a, 5.0, 1.0, 2), ("C", a, 6.0, 1.0, 2), ("D", a, None, None, 1), ("E", a, 1.0, 1.0, None)])
    reader = spark.read.parquet(old)                                # planned before, read after
    got = R.compact_bars(spark, old, new, F.lit(NOW)).select("ticker", "d", "close", "volume", "year").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("A", b, 3.0, 6.0, 2021), ("B", b, 4.0, None, 2021), ("C", a, 6.0, 1.0, 2020), ("D", a, None, None, 2020)], key=str)
    assert reader.count() == 8
    again = R.compact_bars(spark, new, str(tmp_path / "third"), F.lit(NOW))
    assert again.count() == 4
    with pytest.raises(Exception, match="(?i)exists"):
        R.compact_bars(spark, old, new, F.lit(NOW))


def test_all_stale(spark, tmp_path):
    old = str(tmp_path / "old")
    store(spark, old, [("A", dt.date(2020, 1, 2), 1.0, 5.0, 100)])
    assert R.compact_bars(spark, old, str(tmp_path / "new"), F.lit(NOW)).collect() == []
