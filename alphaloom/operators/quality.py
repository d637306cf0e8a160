"""Quality gates, freshness, screening and row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.sources.storage import stacked


def quality_report(bars: DataFrame, min_bars: int = 60, max_missing: float = 0.05, min_price: float = 1.0,
                   spike: float = 0.40, min_adv: float = 1e6) -> DataFrame:
    """One row per ticker with every failed gate in ``reasons``."""
    w = W.partitionBy("ticker").orderBy("d")
    px = F.when(F.isnan("close"), None).otherwise(F.col("close"))
    x = bars.select("ticker", "d", px.alias("close"), "volume")
    # previous known price, so that a gap in the data is not read as a jump
    prev = F.last("close", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    rn = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("d")))
    x = x.select("*", F.abs((F.col("close") - prev) / (prev + 1e-10)).alias("jump"), rn.alias("rn"))
    g = x.groupBy("ticker").agg(
        F.count("*").alias("n"), F.avg(F.col("close").isNull().cast("double")).alias("missing"), F.min("close").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("d"))).alias("last"), F.max("jump").alias("max_jump"),
        F.avg(F.when(F.col("rn") <= 20, F.col("close") * F.col("volume"))).alias("adv"))
    gate = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(F.array(
        gate(F.col("n") < min_bars, "insufficient_history"), gate(F.col("missing") > max_missing, "too_many_nans"),
        gate(F.col("low") <= 0, "zero_or_negative_price"), gate(F.coalesce("last", F.lit(0.0)) < min_price, "penny_stock"),
        gate(F.col("max_jump") > spike, "price_spike"), gate((F.col("n") >= 20) & (F.col("adv") < min_adv), "low_adv")))
    return g.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def apply_quality_gates(bars: DataFrame, report: DataFrame) -> DataFrame:
    return bars.join(report.where("passed").select("ticker"), "ticker", "left_semi")


def rejection_report(report: DataFrame) -> DataFrame:
    """Failed gates with the number of tickers, plus totals."""
    why = report.where("not passed").select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    tot = report.select(F.explode(F.array(F.lit("total"), F.when(F.col("passed"), "passed").otherwise("rejected"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return stacked(why, tot)


def freshness(bars: DataFrame, now: Column) -> DataFrame:
    """Age of the last bar in hours; Mondays tolerate the weekend."""
    limit = F.when(F.weekday(now) == 0, 72.0).otherwise(36.0)
    g = bars.groupBy("ticker").agg(F.max("d").alias("last_date"))
    age = (F.unix_micros(now) - F.unix_micros(F.col("last_date").cast("timestamp"))) / 3.6e9
    return g.select("ticker", "last_date", F.round(age, 1).alias("age_hours"), (age > limit).alias("stale"))


def screen_universe(ref: DataFrame, min_cap: float = 5e9, min_dollar: float = 20e6, min_price: float = 3.0,
                    min_names: int = 15) -> DataFrame:
    """Size, liquidity and price screen; the whole list when too few pass.

    ref: (ticker, market_cap, avg_volume, price).  A name with neither cap nor
    volume known is kept.
    """
    cap, vol, px = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("market_cap", "avg_volume", "price"))
    ok = ((cap == 0) & (vol == 0)) | ((cap > min_cap) & (vol * px > min_dollar) & (px > min_price))
    x = ref.withColumn("__ok", ok)
    n = x.agg(F.count_if("__ok").alias("__n")).withColumn("__one", F.lit(1))
    return (x.withColumn("__one", F.lit(1)).join(n, "__one")
            .where(F.col("__ok") | (F.col("__n") < min_names)).drop("__ok", "__n", "__one"))


def validate_pnl(rows: DataFrame) -> DataFrame:
    """Append the list of validation errors of a P&L row."""
    v = F.col("net_return")
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("d").isNull(), "missing field: date"), F.when(bad, "net_return not finite"),
        F.when(~F.isnan(v) & (F.abs(v) > 0.50), "net_return implausibly large"))))


def validate_ic(rows: DataFrame) -> DataFrame:
    return rows.withColumn("errors", F.array_compact(F.array(
        F.when(F.col("factor").isNull(), "missing field: factor"), F.when(F.col("mean_ic").isNull(), "missing field: mean_ic"),
        F.when(F.abs("mean_ic") > 1.0, "mean_ic out of [-1,1]"))))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
