"""Equity curves, drawdowns and performance statistics.

A curve is (series_id, d, ...) with one row per date, so per-series windows are
bounded by the calendar and thousands of curves run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ANN = 252.0 ** 0.5


def _ws(id_col: str = "series_id"):
    return W.partitionBy(id_col).orderBy("d")


def equity_curve(returns: DataFrame, id_col: str = "series_id", ret: str = "ret") -> DataFrame:
    """Compounded growth of one: value = prod(1 + ret)."""
    run = F.exp(F.sum(F.log1p(F.col(ret))).over(_ws(id_col).rowsBetween(W.unboundedPreceding, 0)))
    return returns.select("*", run.alias("value"))


def drawdowns(curves: DataFrame, id_col: str = "series_id") -> DataFrame:
    peak = F.max("value").over(_ws(id_col).rowsBetween(W.unboundedPreceding, 0))
    return curves.withColumn("drawdown", (F.col("value") - peak) / (peak + 1e-10))


def rolling_sharpe(returns: DataFrame, n: int = 20, id_col: str = "series_id") -> DataFrame:
    fr = _ws(id_col).rowsBetween(-(n - 1), 0)
    full = F.count("ret").over(fr) >= n
    ratio = F.try_divide(F.avg("ret").over(fr), F.stddev_samp("ret").over(fr)) * F.lit(ANN)
    return returns.select("*", F.when(full, ratio).alias("rolling_sharpe"))


def longest_run(df: DataFrame, id_col: str, order: str, flag: Column, out: str) -> DataFrame:
    """Length of the longest run of consecutive true flags per id (gaps and islands)."""
    x = df.select(id_col, order, flag.alias("__f"))
    brk = F.sum(F.when(F.col("__f"), 0).otherwise(1)).over(
        W.partitionBy(id_col).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    runs = x.select(id_col, "__f", brk.alias("__g")).groupBy(id_col, "__g").agg(F.count_if("__f").alias("__n"))
    return runs.groupBy(id_col).agg(F.max("__n").alias(out))


def perf_metrics(curves: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Return, risk and win statistics per curve of values; needs ten points."""
    w = _ws(id_col)
    x = drawdowns(curves, id_col).withColumn("__r", F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)
    brk = F.sum(F.when(F.col("drawdown") < 0, 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("__isl", brk)
    # position inside the current drawdown island; the longest is the duration
    pos = F.sum(F.when(F.col("drawdown") < 0, 1).otherwise(0)).over(
        W.partitionBy(id_col, "__isl").orderBy("d").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("__dur", pos)
    r = F.col("__r")
    g = x.groupBy(id_col).agg(
        F.count("*").alias("n"), F.avg(r).alias("mu"), (F.stddev_pop(r) + 1e-10).alias("sig"),
        (F.coalesce(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)) + 1e-10).alias("down"),
        F.min("drawdown").alias("max_drawdown"),
        (F.max_by("value", "d") / F.min_by("value", "d") - 1).alias("total_return"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.max("__dur").alias("max_dd_duration")).where("n >= 10")
    years = F.greatest(F.col("n") / 252, F.lit(0.01))
    g = g.withColumn("cagr", F.pow(1 + F.col("total_return"), 1.0 / years) - 1)
    return g.select(
        id_col, "n", (F.col("mu") / F.col("sig") * ANN).alias("sharpe"), (F.col("mu") / F.col("down") * ANN).alias("sortino"),
        (F.col("cagr") / (F.abs("max_drawdown") + 1e-10)).alias("calmar"), "max_drawdown", "total_return", "cagr",
        (F.col("sig") * ANN).alias("ann_vol"), "win_rate", "avg_win", "avg_loss",
        (F.abs("avg_win") / (F.abs("avg_loss") + 1e-10)).alias("profit_factor"), "max_dd_duration")


def benchmark_metrics(returns: DataFrame, bench: DataFrame, id_col: str = "series_id") -> DataFrame:
    """Beta, alpha, tracking error and information ratio over common dates (> 20)."""
    j = returns.join(bench.select("d", F.col("ret").alias("b")), "d")
    act = F.col("ret") - F.col("b")
    g = j.groupBy(id_col).agg(
        F.count("*").alias("n_common"), (F.covar_samp("ret", "b") / (F.var_pop("b") + 1e-10)).alias("beta"),
        F.avg("ret").alias("p"), F.avg("b").alias("m"), F.stddev_pop(act).alias("s")).where("n_common > 20")
    return g.select(id_col, "n_common", "beta", ((F.col("p") - F.col("beta") * F.col("m")) * 252).alias("alpha_ann"),
                    (F.col("s") * ANN).alias("tracking_error"),
                    ((F.col("p") - F.col("m")) / (F.col("s") + 1e-10) * ANN).alias("info_ratio"))


def equal_weight_returns(bars: DataFrame) -> DataFrame:
    """Mean return of the universe per date (two-phase aggregate over dates)."""
    w = W.partitionBy("ticker").orderBy("d")
    r = bars.select("d", (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("r")).where("r is not null")
    return r.groupBy("d").agg(F.avg("r").alias("ret"))


def equal_weight_backtest(bars: DataFrame, rebalance_days: int = 21, cost: float = 0.001) -> DataFrame:
    """Daily mean return less a flat cost on rebalance days (not the first)."""
    r = equal_weight_returns(bars).withColumn("i", F.row_number().over(W.orderBy("d")) - 1)
    hit = (F.col("i") % rebalance_days == 0) & (F.col("i") > 0)
    r = r.select(F.lit("ew").alias("series_id"), "d", (F.col("ret") - F.when(hit, cost).otherwise(0.0)).alias("ret"))
    return equity_curve(r)


def turnover_summary(rebalances: DataFrame) -> DataFrame:
    return rebalances.agg(
        F.avg("raw_turnover").alias("avg_raw_turnover"), F.avg("filtered_turnover").alias("avg_filtered_turnover"),
        (F.avg("total_cost") * 10_000).alias("avg_cost_bps"), F.count("*").alias("n_rebalances"))


def by_regime(periods: DataFrame, ret: str = "period_return") -> DataFrame:
    """Count, mean and hit ratio per regime plus the overall row (grouping sets)."""
    x = periods.where(F.col(ret).isNotNull())
    return x.rollup("regime").agg(
        F.count("*").alias("n"), F.avg(ret).alias("avg_return"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate")
    ).withColumn("regime", F.coalesce("regime", F.lit("all")))


def stability_thirds(periods: DataFrame, order: str = "d", ret: str = "period_return") -> DataFrame:
    """Early, mid and late statistics of the ordered records (six or more).

    The records are rebalances, so the single ordered window is tiny.
    """
    x = periods.where(F.col(ret).isNotNull())
    x = x.select(order, ret, (F.row_number().over(W.orderBy(order)) - 1).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    x = x.where("n >= 6")
    third = F.when(F.col("i") < F.floor(F.col("n") / 3), "early").when(F.col("i") < F.floor(2 * F.col("n") / 3), "mid").otherwise("late")
    return x.groupBy(third.alias("period")).agg(
        F.count("*").alias("n"), F.avg(ret).alias("avg_return"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"),
        F.min(order).alias("start_date"), F.max(order).alias("end_date"))


def swing_verdict(n, win_rate, pf) -> Column:
    return (F.when(n < 20, F.format_string("EARLY — %d periods, need ≥20 swing periods to assess", n.cast("int")))
            .when((win_rate >= 0.55) & (pf >= 1.3), "STRONG SWING EDGE — consider live capital at $500-$1,000")
            .when((win_rate >= 0.52) & (pf >= 1.1), "MODERATE EDGE — paper trade 4 more weeks before capital")
            .when((win_rate >= 0.50) & (pf >= 1.0), "BREAKEVEN — signal weak, review factor weights")
            .otherwise("NO EDGE — win rate or profit factor below threshold"))


def swing_metrics(periods: DataFrame, rebalance_days: int = 5, id_col: str = "series_id", ret: str = "ret") -> DataFrame:
    """Period-level statistics with the swing verdict, per strategy."""
    r = F.col(ret)
    g = periods.groupBy(id_col).agg(
        F.count("*").alias("n_periods"), (F.avg(r) * 100).alias("avg_period_return"), (F.median(r) * 100).alias("median_period_return"),
        (F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)) / (F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))) + 1e-9)).alias("profit_factor"),
        (F.avg(r) / (F.stddev_pop(r) + 1e-9) * (252 / rebalance_days) ** 0.5).alias("signal_to_noise"),
        F.avg((r > 0).cast("double")).alias("win_rate"))
    loss = longest_run(periods, id_col, "d", r <= 0, "max_consecutive_losses")
    return g.join(loss, id_col).withColumn(
        "verdict", swing_verdict(F.col("n_periods"), F.round("win_rate", 3), F.round("profit_factor", 3)))


def nav_log(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Portfolio value per date: shares x price, 0 for a missing price."""
    return (positions.join(prices.select("ticker", "d", "close"), ["ticker", "d"], "left")
            .groupBy("series_id", "d").agg(F.sum(F.col("shares") * F.coalesce("close", F.lit(0.0))).alias("value")))


def capacity_curve(alpha: DataFrame, levels: list[float], ref: float = 100_000.0) -> DataFrame:
    """Net alpha at growing assets: cost grows with the square root of size.

    ``alpha`` = one row per strategy (series_id, alpha_daily, ret_std, cost_frac).
    """
    x = alpha.select("*", F.explode(F.array(*[F.lit(float(a)) for a in levels])).alias("aum"))
    cost = F.col("cost_frac") * F.sqrt(F.col("aum") / ref)
    net = F.col("alpha_daily") - cost / 252
    return x.select("series_id", "aum", (cost * 100).alias("cost_frac_pct"), (net * 252).alias("net_alpha_ann"),
                    (net / (F.col("ret_std") + 1e-9) * ANN).alias("adj_sharpe"), (net > 0).alias("viable"))


def capacity_limit(curve: DataFrame) -> DataFrame:
    return curve.groupBy("series_id").agg(F.coalesce(F.max(F.when(F.col("viable"), F.col("aum"))), F.lit(0.0)).alias("capacity_limit"))
