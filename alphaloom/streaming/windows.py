"""Window, session, join and deduplication streams.

Timestamps must be TIMESTAMP (not TIMESTAMP_NTZ) before a watermark; see ``ticks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
                         F.col("value").alias("price"), "event_id")


def bars(t: DataFrame, every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Open, high, low, close and tick count per ticker and tumbling window."""
    g = t.withWatermark("ts", delay).groupBy(F.window("ts", every), "ticker").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"), F.count("*").alias("volume"))
    return g.select("ticker", F.col("window.start").alias("start"), "open", "high", "low", "close", "volume")


def rolling_monitor(t: DataFrame, span: str = "5 days", every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Mean and deviation of price per ticker over sliding windows."""
    g = t.withWatermark("ts", delay).groupBy(F.window("ts", span, every), "ticker").agg(
        F.avg("price").alias("avg_price"), F.stddev_pop("price").alias("vol"), F.count("*").alias("n"))
    return g.select("ticker", F.col("window.start").alias("start"), "avg_price", "vol", "n")


def sessions(t: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per key, closed after the inactivity gap."""
    g = t.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "ticker").agg(F.count("*").alias("n"))
    return g.select("ticker", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def match_fills(arrivals: DataFrame, fills: DataFrame, within: str = "2 hours", delay: str = "1 hour") -> DataFrame:
    """Stream-stream left join of orders with their fills; unfilled ones surface once the bound has passed.

    arrivals: trade_id, side, arrival_price, ts; fills: trade_id, fill_price, ts.
    """
    a = arrivals.withWatermark("ts", delay).alias("a")
    f = fills.withColumnRenamed("ts", "fill_ts").withColumnRenamed("trade_id", "fill_id").withWatermark("fill_ts", delay).alias("f")
    cond = (F.col("trade_id") == F.col("fill_id")) & (F.col("fill_ts") >= F.col("ts")) & (F.col("fill_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    j = a.join(f, cond, "leftOuter")
    ap, fp = F.col("arrival_price"), F.col("fill_price")
    diff = F.when(F.col("side") == "buy", fp - ap).otherwise(ap - fp)
    return j.select("trade_id", "side", "ts", F.when(ap > 0, F.try_divide(diff, ap) * 10_000).otherwise(0.0).alias("slippage_bps"), fp.isNotNull().alias("filled"))


def dedupe(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """Drop repeats of a key that arrive within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
