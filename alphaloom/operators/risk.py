"""Circuit breakers, drawdown and volatility scales, stops and the trade gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import drawdown_scale, regime_vol_multiplier

ANN = 252.0 ** 0.5


def _ws():
    return W.partitionBy("series_id").orderBy("d")


def daily_loss(curves: DataFrame, limit: float = 0.03) -> DataFrame:
    """Daily return of the value and whether it breaches the loss limit."""
    prev = F.lag("value").over(_ws())
    r = F.when(prev > 0, F.try_divide(F.col("value") - prev, prev))
    return curves.select("series_id", "d", "value", r.alias("daily_return"), F.coalesce(r < -limit, F.lit(False)).alias("breach"))


def drawdown_halt(curves: DataFrame, limit: float = 0.20) -> DataFrame:
    peak = F.max("value").over(_ws().rowsBetween(W.unboundedPreceding, 0))
    n = F.row_number().over(_ws())
    dd = (F.col("value") - peak) / (peak + 1e-10)
    return curves.select("series_id", "d", "value", dd.alias("drawdown"), ((n >= 2) & (dd < -limit)).alias("breach"),
                         F.when(n < 2, 1.0).otherwise(drawdown_scale(dd)).alias("dd_scale"))


def halt_intervals(breaches: DataFrame, days: int) -> DataFrame:
    """Halt windows [d, d + days) opened by breach rows."""
    return breaches.where("breach").select("series_id", F.col("d").alias("halt_from"), F.date_add("d", days).alias("halt_to"))


def halted_at(rows: DataFrame, halts: DataFrame) -> DataFrame:
    """Rows dated inside a halt window of their series (semi-join); overlapping windows are merged first."""
    own = W.partitionBy("series_id").orderBy("halt_from", "halt_to")
    before = F.max("halt_to").over(own.rowsBetween(W.unboundedPreceding, -1))
    runs = halts.select("series_id", "halt_from", "halt_to", F.when(F.col("halt_from") < before, 0).otherwise(1).alias("__new"))
    h = (runs.withColumn("__run", F.sum("__new").over(own)).groupBy(F.col("series_id").alias("__s"), "__run")
         .agg(F.min("halt_from").alias("halt_from"), F.max("halt_to").alias("halt_to")))
    return rows.join(h, (F.col("series_id") == F.col("__s")) & (F.col("d") > F.col("halt_from")) & (F.col("d") < F.col("halt_to")), "left_semi")


def trade_gate(curves: DataFrame, loss_limit: float = 0.03, dd_limit: float = 0.20, loss_days: int = 1, dd_days: int = 30) -> DataFrame:
    """Daily decision: halted, daily_loss, max_drawdown or ok, in this order.

    Checks are skipped while halted, so a halt never extends itself; the fold
    runs over one row per calendar date of a series.
    """
    a = daily_loss(curves, loss_limit).select("series_id", "d", F.col("breach").alias("loss"))
    b = drawdown_halt(curves, dd_limit).select("series_id", "d", F.col("breach").alias("dd"))
    seq = a.join(b, ["series_id", "d"]).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("d", "loss", "dd"))).alias("h"))
    zero = F.struct(F.lit("1900-01-01").cast("date").alias("until"),
                    F.array().cast("array<struct<d:date,decision:string>>").alias("log"))

    def step(s, e):
        halted = e.d < s.until
        until = (F.when(halted, s.until).when(e.loss, F.date_add(e.d, loss_days)).when(e.dd, F.date_add(e.d, dd_days)).otherwise(s.until))
        what = F.when(halted, "halted").when(e.loss, "daily_loss").when(e.dd, "max_drawdown").otherwise("ok")
        return F.struct(until.alias("until"), F.concat(s.log, F.array(F.struct(e.d.alias("d"), what.alias("decision")))).alias("log"))
    return seq.select("series_id", F.explode(F.aggregate("h", zero, step)["log"]).alias("e")).select("series_id", "e.d", "e.decision")


def dynamic_vol_scale(returns: DataFrame, target: float = 0.12, short: int = 21, long: int = 63) -> DataFrame:
    """Exposure scale from the larger of two realised volatilities and the regime.

    ``returns`` = (series_id, d, ret, regime).
    """
    w = _ws()
    n = F.row_number().over(w)
    sd = lambda k: F.stddev_samp("ret").over(w.rowsBetween(-(k - 1), 0)) * F.lit(ANN)
    x = returns.select("series_id", "d", "regime", n.alias("n"), sd(short).alias("vs"), sd(long).alias("vl"))
    vol = F.greatest(F.col("vs"), F.when(F.col("n") >= long, F.col("vl")).otherwise(F.col("vs")), F.lit(1e-4))
    scale = F.least(F.lit(target) / vol, F.lit(1.0)) * regime_vol_multiplier("regime")
    out = F.least(F.greatest(scale, F.lit(0.20)), F.lit(1.0))
    # needs one value more than the short window has returns
    return x.select("series_id", "d", F.when(F.col("n") < short + 1, 1.0).otherwise(out).alias("vol_scale"))


def vol_target_leverage(returns: DataFrame, target: float = 0.12, cap: float = 2.0) -> DataFrame:
    v = F.stddev_samp("ret") * F.lit(ANN) + 1e-8
    return returns.groupBy("series_id").agg(F.least(F.lit(target) / v, F.lit(cap)).alias("leverage"))


def stop_loss_breaches(entries: DataFrame, prices: DataFrame, limit: float = 0.08) -> DataFrame:
    """Positions down more than the limit; non-positive prices are ignored."""
    j = entries.join(prices.select("ticker", F.col("close").alias("price")), "ticker").where("entry_price > 0 and price > 0")
    dd = (F.col("price") - F.col("entry_price")) / F.col("entry_price")
    return j.withColumn("drawdown", dd).where(F.col("drawdown") < -limit)


def size_positions(weights: DataFrame, prices: DataFrame, scales: DataFrame, keys: list[str], capital: float = 100_000.0) -> DataFrame:
    """Notional and shares, scaled down when the risk scale asks for it.

    ``scales`` = (keys, dd_scale, vol_scale).
    """
    j = weights.join(prices, keys + ["ticker"], "left").join(scales, keys, "left")
    s = F.least(F.coalesce("dd_scale", F.lit(1.0)), F.coalesce("vol_scale", F.lit(1.0)))
    w = F.when(s < 0.99, F.col("weight") * s).otherwise(F.col("weight"))
    notional = F.round(w * capital, 2)
    return j.select(*keys, "ticker", w.alias("weight"), notional.alias("notional"), F.try_divide(notional, F.col("close")).alias("shares"))
