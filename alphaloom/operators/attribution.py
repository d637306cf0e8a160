"""Attribution of results to factors, sectors, selection and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def factor_contribution(contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of per-name contributions by factor."""
    return contributions.groupBy(*keys, "factor").agg(F.sum("contribution").alias("contribution"))


def factor_attribution(ic: DataFrame, exposures: DataFrame) -> DataFrame:
    """IC statistics and average weighted exposure per factor.

    ``exposures`` = (strategy, k, ticker, factor, z, weight).
    """
    i = ic.groupBy("factor").agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("std_ic"),
                                 F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"), F.count("*").alias("n_observations"))
    tot = exposures.select("strategy", "k", "ticker", "weight").distinct().groupBy("strategy", "k").agg(F.sum("weight").alias("__t"))
    e = exposures.join(tot, ["strategy", "k"]).groupBy("factor").agg(
        F.avg(F.col("z") * F.col("weight") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))).alias("avg_exposure"))
    j = i.join(e, "factor", "full_outer")
    c = lambda n, d: F.coalesce(n, F.lit(d))
    m, x = c("mean_ic", 0.0), c("avg_exposure", 0.0)
    return j.select("factor", m.alias("mean_ic"), (m / (c("std_ic", 1.0) + 1e-6)).alias("ic_ir"), c("hit_rate", 0.5).alias("hit_rate"),
                    x.alias("avg_exposure"), (m * x * 100 * 10_000).alias("est_contrib_bps"), c("n_observations", 0).alias("n_observations"))


def brinson_ticker(portfolio: DataFrame, benchmark: DataFrame, returns: DataFrame, bench_return: DataFrame, keys: list[str]) -> DataFrame:
    """Per-name effects with the benchmark return as every name's benchmark.

    Allocation is zero by construction in this form; see ``brinson_sector``.
    """
    p = portfolio.select(*keys, "ticker", F.col("weight").alias("wp"))
    b = benchmark.select(*keys, "ticker", F.col("weight").alias("wb"))
    j = p.join(b, keys + ["ticker"], "full_outer").join(returns.select(*keys, "ticker", F.col("ret").alias("r")), keys + ["ticker"], "left")
    j = j.join(bench_return.select(*keys, F.col("ret").alias("rb")), keys)
    wp, wb, r = F.coalesce("wp", F.lit(0.0)), F.coalesce("wb", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    rb = F.col("rb")
    return j.groupBy(*keys).agg(
        F.sum((wp - wb) * (rb - rb)).alias("allocation"), F.sum(wb * (r - rb)).alias("selection"),
        F.sum((wp - wb) * (r - rb)).alias("interaction"), (F.sum(wp * r) - F.max(rb)).alias("active_return"))


def brinson_sector(portfolio: DataFrame, benchmark: DataFrame, returns: DataFrame, sectors: DataFrame, keys: list[str]) -> DataFrame:
    """Allocation, selection and interaction per sector."""
    def side(w: DataFrame, a: str, b: str) -> DataFrame:
        x = (w.join(returns.select(*keys, "ticker", "ret"), keys + ["ticker"], "left")
             .join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown"))))
        r = F.coalesce("ret", F.lit(0.0))
        return x.groupBy(*keys, "sector").agg(F.sum("weight").alias(a), F.coalesce(F.try_divide(F.sum(F.col("weight") * r), F.sum("weight")), F.lit(0.0)).alias(b))
    j = side(portfolio, "wp", "rp").join(side(benchmark, "wb", "rb"), keys + ["sector"], "full_outer")
    z = {c: F.coalesce(c, F.lit(0.0)) for c in ("wp", "rp", "wb", "rb")}
    total = F.sum(z["wb"] * z["rb"]).over(W.partitionBy(*keys))
    return j.select(*keys, "sector", ((z["wp"] - z["wb"]) * (z["rb"] - total)).alias("allocation"),
                    (z["wb"] * (z["rp"] - z["rb"])).alias("selection"), ((z["wp"] - z["wb"]) * (z["rp"] - z["rb"])).alias("interaction"))


def factor_return_attribution(weights: DataFrame, z: DataFrame, factor_returns: DataFrame, portfolio_return: DataFrame, keys: list[str]) -> DataFrame:
    """Loading x factor return per factor, with the residual as alpha."""
    load = weights.join(z, keys + ["ticker"]).groupBy(*keys, "factor").agg(F.sum(F.col("weight") * F.col("z")).alias("loading"))
    c = load.join(factor_returns, keys + ["factor"]).withColumn("contribution", F.col("loading") * F.col("factor_return"))
    tot = c.groupBy(*keys).agg(F.sum("contribution").alias("explained")).join(portfolio_return, keys)
    tot = tot.select(*keys, "explained", (F.col("ret") - F.col("explained")).alias("alpha"), "ret")
    return c.join(tot, keys).withColumn("alpha_pct", F.col("alpha") / (F.abs("ret") + 1e-8) * 100)


def timing_contribution(portfolio: DataFrame, buy_hold: DataFrame) -> DataFrame:
    """Compounded strategy return less compounded buy-and-hold return per series."""
    total = lambda df, n: df.groupBy("series_id").agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias(n))
    j = total(portfolio, "strategy_return").join(total(buy_hold, "buy_hold_return"), "series_id")
    return j.withColumn("timing", F.col("strategy_return") - F.col("buy_hold_return"))


def period_report(daily: DataFrame, rebalances: DataFrame, freq: str = "month") -> DataFrame:
    """Compounded returns per calendar period against the benchmark.

    ``daily`` = (d, ret, bench); ``rebalances`` = (d, total_cost, dd_scale).
    Rebalance figures come per period and cumulated to its end (``*_cum``).
    """
    end = (lambda d: F.last_day(d)) if freq == "month" else (lambda d: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)))
    comp = lambda c: F.exp(F.sum(F.log1p(c))) - 1
    p = daily.groupBy(end(F.col("d")).alias("period")).agg(comp("ret").alias("ret"), comp("bench").alias("bench"), F.count("*").alias("n_days"))
    r = rebalances.groupBy(end(F.col("d")).alias("period")).agg(
        F.count("*").alias("n_rebalances"), F.sum("total_cost").alias("__c"), F.sum("dd_scale").alias("__d"))
    w = W.orderBy("period").rowsBetween(W.unboundedPreceding, 0)   # one row per period
    n, c, s = (F.coalesce(F.col(x), F.lit(0)) for x in ("n_rebalances", "__c", "__d"))
    avg = lambda a, b, d: F.coalesce(F.try_divide(a, b), F.lit(d))
    x = p.join(r, "period", "left").select("*", F.sum(n).over(w).alias("n_rebalances_cum"), F.sum(c).over(w).alias("__cc"), F.sum(s).over(w).alias("__dc"))
    return x.select(
        "period", "n_days", "ret", "bench", (F.col("ret") - F.col("bench")).alias("active"),
        (F.col("ret") > F.col("bench")).alias("outperformed"), n.alias("n_rebalances"),
        avg(c, n, 0.0).alias("avg_cost"), avg(s, n, 1.0).alias("avg_dd_scale"), "n_rebalances_cum",
        avg(F.col("__cc"), F.col("n_rebalances_cum"), 0.0).alias("avg_cost_cum"),
        avg(F.col("__dc"), F.col("n_rebalances_cum"), 1.0).alias("avg_dd_scale_cum"))


def portfolio_exposure(weights: DataFrame, z: DataFrame, keys: list[str], alternatives: DataFrame | None = None) -> DataFrame:
    """Weight-normalised exposure per factor.

    A missing or zero z falls back to ``alternatives`` (keys, ticker, factor, alt).
    """
    tot = weights.groupBy(*keys).agg(F.sum("weight").alias("__t"))
    j = weights.join(z, keys + ["ticker"])
    val = F.when(F.col("z") != 0, F.col("z"))
    if alternatives is not None:
        j = j.join(alternatives, keys + ["ticker", "factor"], "left")
        val = F.coalesce(val, "alt")
    g = j.groupBy(*keys, "factor").agg(F.sum(F.col("weight") * F.coalesce(val, F.lit(0.0))).alias("__a")).join(tot, keys)
    return g.select(*keys, "factor", (F.col("__a") / F.when(F.col("__t") == 0, 1.0).otherwise(F.col("__t"))).alias("exposure"))


def sector_rollup(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Gross weight and position count per sector and in total (rollup)."""
    return weights.groupBy(*keys, "sector").agg(F.sum("weight").alias("w"), F.count("*").alias("c")).rollup(*keys, "sector").agg(
        F.sum("w").alias("weight"), F.sum("c").alias("positions"), F.count("*").alias("sectors")).where(
        " and ".join(f"{k} is not null" for k in keys)).withColumn("sector", F.coalesce("sector", F.lit("all")))


def herfindahl(weights: DataFrame, keys: list[str]) -> DataFrame:
    return weights.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
