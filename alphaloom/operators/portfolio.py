"""Portfolio construction for many (portfolio, date) groups at once.

A portfolio holds at most ``top_n`` names, so windows and arrays per portfolio
are bounded by that parameter; covariances pair only those names.
Weights are rows (keys..., ticker, weight).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alphaloom.functions.expr import let, trade_cost
from alphaloom.sources.storage import stacked

TRADING_DAYS = 252


def window_vectors(picks: DataFrame, bars: DataFrame, days: DataFrame, lookback: int = 126) -> DataFrame:
    """Aligned vectors of daily returns of the picks over the days before each rebalance.

    ``picks`` = (keys..., ticker, idx) with idx the calendar position of the rebalance.  A day without a bar returns 0; the
    sample starts once every name of the portfolio has traded in the window.  Output (keys..., ticker, start, x), x from
    day ``start`` on.

    A ticker's returns stand in one row (as many as there are dates), so a pick meets one row and cuts its window out.
    """
    keys = [c for c in picks.columns if c not in ("ticker", "idx")]
    w = W.partitionBy("ticker").orderBy("d")
    held = bars.join(picks.select("ticker").distinct(), "ticker", "left_semi").join(days, "d")
    ret = held.select("ticker", F.col("idx").alias("t"), (F.try_divide(F.col("close"), F.lag("close").over(w)) - 1).alias("x"))
    series = ret.groupBy("ticker").agg(F.collect_list(F.struct("t", F.coalesce("x", F.lit(0.0)).alias("x"))).alias("__r"))
    hist = picks.join(series, "ticker").withColumn("__w", F.filter("__r", lambda e: (e.t >= F.col("idx") - lookback) & (e.t < F.col("idx")))).drop("__r")
    hist = hist.where(F.size("__w") > 0).withColumn("start", F.max(F.array_min("__w.t")).over(W.partitionBy(*keys)) + 1).where(F.col("start") <= F.col("idx") - 1)
    x = let(F.map_from_entries("__w"), lambda m: F.transform(F.sequence("start", F.col("idx") - 1), lambda t: F.coalesce(F.try_element_at(m, t), F.lit(0.0))))
    return hist.select(*keys, "ticker", "start", x.alias("x"))


def window_returns(picks: DataFrame, bars: DataFrame, days: DataFrame, lookback: int = 126) -> DataFrame:
    """The vectors of ``window_vectors`` as rows (keys..., ticker, t, x)."""
    return long_returns(window_vectors(picks, bars, days, lookback))


def long_returns(vectors: DataFrame) -> DataFrame:
    keys = [c for c in vectors.columns if c not in ("ticker", "start", "x")]
    x = vectors.select(*keys, "ticker", "start", F.posexplode("x").alias("__p", "x"))
    return x.select(*keys, "ticker", (F.col("start") + F.col("__p")).alias("t"), "x")


def vectors_of(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors of aligned rows (keys..., ticker, t, x)."""
    v = returns.groupBy(*keys, "ticker").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("__v"))
    return v.select(*keys, "ticker", F.array_min("__v.t").alias("start"), F.col("__v.x").alias("x"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _centred(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each portfolio: its names, at most top_n, with their centred vectors."""
    c = let(_sum(F.col("x")) / F.size("x"), lambda m: F.transform("x", lambda v: v - m))
    return vectors.select(*keys, "ticker", c.alias("c")).groupBy(*keys).agg(F.collect_list(F.struct("ticker", "c")).alias("names"))


def _gram(portfolios: DataFrame, keys: list[str], *more: Column, ddof: int = 0) -> DataFrame:
    """(keys, i, j, n, cov) and what else is taken from the portfolio's row: products of vectors, inside the row."""
    x = portfolios.select(*keys, "names", *more, F.explode("names").alias("a"))
    rest = [c for c in x.columns if c not in (*keys, "names", "a")]
    x = x.select(*keys, *rest, "a", F.explode("names").alias("b"))
    n = F.size("a.c").cast("long")
    return x.select(*keys, F.col("a.ticker").alias("i"), F.col("b.ticker").alias("j"), n.alias("n"), (_dot(F.col("a.c"), F.col("b.c")) / (n - ddof)).alias("cov"), *rest)


def covariance_long(returns: DataFrame, keys: list[str], ddof: int = 0) -> DataFrame:
    """Sample covariance rows (keys, i, j, n, cov) of the names of each portfolio."""
    return _gram(_centred(vectors_of(returns, keys), keys), keys, ddof=ddof)


def ledoit_wolf_of(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Shrunk covariance (keys, i, j, n, cov, shrinkage) of the vectors of each portfolio.

    Moments are taken once; the sums over pairs run where the portfolio's row is, without another exchange.
    """
    squares = F.aggregate("names", F.transform(F.element_at("names", 1)["c"], lambda v: F.lit(0.0)), lambda acc, e: F.zip_with(acc, e.c, lambda s, v: s + v * v))
    b_ = F.aggregate(squares, F.lit(0.0), lambda s, q: s + q * q)
    p, w = F.size("names"), W.partitionBy(*keys)
    s = _gram(_centred(vectors, keys), keys, p.alias("p"), b_.alias("b_"))
    s = s.withColumns({"tr": F.sum(F.when(F.col("i") == F.col("j"), F.col("cov"))).over(w), "d_": F.sum(F.col("cov") * F.col("cov")).over(w)})
    mu = F.col("tr") / F.col("p")
    beta = (F.col("b_") / F.col("n") - F.col("d_")) / (F.col("p") * F.col("n"))
    delta = (F.col("d_") - 2 * mu * F.col("tr") + F.col("p") * mu * mu) / F.col("p")
    shrink = F.when(F.least(beta, delta) == 0, 0.0).otherwise(F.coalesce(F.try_divide(F.least(beta, delta), delta), F.lit(0.0)))
    s = s.withColumns({"mu": mu, "shrinkage": shrink})
    shrunk = F.col("cov") * (1 - F.col("shrinkage")) + F.when(F.col("i") == F.col("j"), F.col("mu") * F.col("shrinkage")).otherwise(0.0)
    return s.select(*keys, "i", "j", "n", shrunk.alias("cov"), "shrinkage")


def ledoit_wolf(returns: DataFrame, keys: list[str]) -> DataFrame:
    """The same of aligned rows (keys..., ticker, t, x)."""
    return ledoit_wolf_of(vectors_of(returns, keys), keys)


def portfolio_variance(weights: DataFrame, cov: DataFrame, keys: list[str]) -> DataFrame:
    """Quadratic form w' S w per portfolio: (keys, variance)."""
    wi = weights.select(*keys, F.col("ticker").alias("i"), F.col("weight").alias("wi"))
    wj = weights.select(*keys, F.col("ticker").alias("j"), F.col("weight").alias("wj"))
    return cov.join(wi, keys + ["i"]).join(wj, keys + ["j"]).groupBy(*keys).agg(
        F.sum(F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))


def vol_target(weights: DataFrame, cov: DataFrame, keys: list[str], target: float = 0.12) -> DataFrame:
    """Scale each portfolio down to the target annual volatility (never up)."""
    v = portfolio_variance(weights, cov, keys)
    scale = F.least(F.lit(target) / F.sqrt(F.greatest(F.col("variance") * TRADING_DAYS, F.lit(1e-10))), F.lit(1.0))
    return weights.join(v, keys, "left").select(
        *[c for c in weights.columns if c != "weight"],
        (F.col("weight") * F.coalesce(scale, F.lit(1.0))).alias("weight"))


def _share(x: Column, keys: list[str], eps: float = 0.0) -> Column:
    return x / (F.sum(x).over(W.partitionBy(*keys)) + eps)


def risk_parity(vols: DataFrame, keys: list[str], vol: str = "vol", eps: float = 1e-6) -> DataFrame:
    """Inverse-volatility weights."""
    return vols.select(*keys, "ticker", _share(1.0 / (F.col(vol) + eps), keys).alias("weight"))


def signal_tilt(scores: DataFrame, cov: DataFrame, keys: list[str], min_days: int = 30) -> DataFrame:
    """60 % inverse volatility plus 40 % positive score share.

    Portfolios with under two names or too short a sample fall back to equal
    weights; ``fallback`` marks them.
    """
    diag = cov.where("i = j").select(*keys, F.col("i").alias("ticker"), "cov", "n")
    x = scores.join(diag, keys + ["ticker"], "left")
    w = W.partitionBy(*keys)
    names, days = F.count("cov").over(w), F.coalesce(F.max("n").over(w), F.lit(0))
    x = x.withColumn("fallback", (names < 2) | (days < min_days))
    inv = F.when(F.col("cov").isNotNull(), 1.0 / (F.sqrt("cov") + 1e-8))
    pos = F.when(F.col("cov").isNotNull(), F.greatest(F.col("cs_score"), F.lit(0.0)))
    raw = 0.60 * (inv / F.sum(inv).over(w)) + 0.40 * (pos / (F.sum(pos).over(w) + 1e-9))
    x = x.withColumn("__raw", raw)
    norm = F.col("__raw") / (F.sum("__raw").over(w) + 1e-9)
    return x.select(*keys, "ticker", "fallback",
                    F.when(F.col("fallback"), 1.0 / F.count("*").over(w)).otherwise(norm).alias("weight")).where("weight is not null")


def hhi_smooth(weights: DataFrame, keys: list[str], ratio: float = 2.5, max_steps: int = 50) -> DataFrame:
    """Mix towards equal weights until concentration is within ``ratio`` of equal.

    Each 80/20 step shrinks the excess concentration by 0.64, so the number of
    steps has a closed form.
    """
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    x = weights.withColumn("__n", n).withColumn("__h", F.sum(F.col("weight") * F.col("weight")).over(w))
    excess, room = F.col("__h") - 1 / F.col("__n"), (ratio - 1) / F.col("__n") + 1e-8
    steps = F.when(excess <= room, 0).otherwise(
        F.least(F.ceil(F.log(room / excess) / F.log(F.lit(0.64))), F.lit(max_steps)))
    f = F.pow(F.lit(0.8), steps)
    return x.withColumn("weight", f * F.col("weight") + (1 - f) / F.col("__n")).drop("__n", "__h")


def cap_positions(weights: DataFrame, keys: list[str], cap: float = 0.20, steps: int = 50,
                  tol: float = 1e-8, eps: float = 0.0) -> DataFrame:
    """Clip to the cap and renormalise until stable (a native fold on a short array)."""
    extra = [c for c in weights.columns if c not in (*keys, "weight")]
    g = weights.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ticker", "weight", *[c for c in extra if c != "ticker"]))).alias("__a"))
    start = F.struct(F.transform("__a", lambda e: e["weight"]).alias("w"), F.lit(False).alias("done"))

    def step(s, _i):
        low = F.transform(s["w"], lambda v: F.least(v, F.lit(cap)))
        tot = F.aggregate(low, F.lit(0.0), lambda a, v: a + v)
        nxt = F.when(tot < 1e-9, F.transform(low, lambda v: F.lit(1.0) / F.size(low))).otherwise(
            F.transform(low, lambda v: v / (tot + eps)))
        out = F.when(s["done"], s["w"]).otherwise(nxt)
        return F.struct(out.alias("w"), (F.array_max(out) <= cap + tol).alias("done"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["w"]
    z = g.select(*keys, F.explode(F.arrays_zip(F.col("__a").alias("a"), fold.alias("w"))).alias("e"))
    return z.select(*keys, *[F.col(f"e.a.{c}").alias(c) for c in extra], F.col("e.w").alias("weight"))


def min_position(weights: DataFrame, keys: list[str], floor: float = 0.03, renormalise: bool = True) -> DataFrame:
    kept = weights.where(F.col("weight") >= floor)
    if not renormalise:
        return kept
    tot = F.sum("weight").over(W.partitionBy(*keys))
    return kept.withColumn("weight", F.col("weight") / F.when(tot == 0, 1e-9).otherwise(tot))


def sector_cap_greedy(weights: DataFrame, keys: list[str], cap: float = 0.25) -> DataFrame:
    """Largest first, each sector up to its budget; the rest is dropped."""
    w = W.partitionBy(*keys, "sector").orderBy(F.desc("weight"), "ticker").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(w), F.lit(0.0))
    x = weights.withColumn("weight", F.least(F.col("weight"), F.greatest(F.lit(0.0), F.lit(cap) - before))).where("weight > 0")
    return x.withColumn("weight", _share(F.col("weight"), keys))


def _sector_loop(pdf: pd.DataFrame, cap: float, rounds: int = 20) -> pd.DataFrame:
    w, s = pdf["weight"].to_numpy(float), pdf["sector"].to_numpy()
    for _ in range(rounds):
        tot = pd.Series(w).groupby(s).transform("sum").to_numpy()
        over = tot > cap + 1e-5
        if not over.any():
            break
        w = np.where(over, w * cap / np.where(over, tot, 1.0), w)
        w = w / (w.sum() or 1e-9)
    return pdf.assign(weight=w)


def sector_constraints(weights: DataFrame, keys: list[str], cap: float = 0.35) -> DataFrame:
    """Scale over-weight sectors to the cap and renormalise, repeatedly."""
    return weights.groupBy(*keys).applyInPandas(lambda pdf: _sector_loop(pdf, cap), weights.schema)


def kelly(scores: DataFrame, keys: list[str], fraction: float = 0.25) -> DataFrame:
    """Fractional score-over-variance weights from (keys, ticker, score, sigma)."""
    w = W.partitionBy(*keys)
    s = F.col("sigma") + 1e-8
    raw = F.greatest(F.col("score"), F.lit(0.0)) / (s * s + 1e-8)
    n, tot = F.count("*").over(w), F.sum(raw).over(w)
    return scores.select(*keys, "ticker", F.when(tot < 1e-9, 1.0 / n).otherwise(
        F.try_divide(raw, tot) * fraction + (1 - fraction) / n).alias("weight"))


def cvar(returns: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    """Mean loss beyond the percentile per name (keys, ticker, n, cvar).

    Each name has at most one return per day, so the exact percentile is small.
    """
    g = keys + ["ticker"]
    cut = returns.groupBy(*g).agg(F.percentile("x", 1 - confidence).alias("__cut"), F.count("x").alias("n"))
    return returns.join(cut, g).groupBy(*g).agg(
        F.max("n").alias("n"), F.abs(F.avg(F.when(F.col("x") <= F.col("__cut"), F.col("x")))).alias("cvar"))


def cvar_weights(tail: DataFrame, keys: list[str]) -> DataFrame:
    v = F.when(F.col("n") < 20, 0.02).otherwise(F.greatest(F.coalesce("cvar", F.lit(0.02)), F.lit(1e-4)))
    return tail.select(*keys, "ticker", _share(1.0 / v, keys).alias("weight"))


def cvar_cap(n: Column, tail: Column, budget: float = 0.025) -> Column:
    """Largest weight whose tail loss stays in the budget, within [3 %, 20 %]."""
    raw = F.lit(budget) / (F.coalesce(tail, F.lit(0.02)) + 1e-6)
    return F.when(n < 20, 0.20).otherwise(F.least(F.greatest(raw, F.lit(0.03)), F.lit(0.20)))


def solved(rows: Column) -> Column:
    """Solution of a linear system with a positive definite matrix, given as augmented rows (the right side last).

    Gauss-Jordan elimination as an ordered fold over the pivots; null where a pivot is zero.
    """
    def eliminate(m, p):
        pivot = F.transform(m[p], lambda v: F.try_divide(v, m[p][p]))
        return let(pivot, lambda top: F.transform(m, lambda r, i: F.when(i == p, top).otherwise(F.zip_with(r, top, lambda a, b: a - r[p] * b))))
    done = F.aggregate(F.sequence(F.lit(0), F.size(rows) - 1), rows, eliminate)
    return F.transform(done, lambda r: F.element_at(r, -1))


def black_litterman(scores: DataFrame, cov: DataFrame, keys: list[str], tau: float = 0.05,
                    omega: float = 0.1, lam: float = 2.5) -> DataFrame:
    """Posterior mean-variance weights with the scores as views.

    With one view on each name, the posterior weights are the equal prior plus tau / lam times the solution y of
    (A + omega diag A) y = views - lam S prior, A being tau S: one system for each portfolio of at most top_n names, solved
    in the engine.  A portfolio without a solution keeps the prior.
    """
    s = scores.select(*keys, F.col("ticker").alias("i"), F.coalesce("score", F.lit(0.0)).cast("double").alias("view"))
    c = tau * F.col("cov") * F.when(F.col("i") == F.col("j"), 1.0 + omega).otherwise(1.0)
    rows = cov.join(s, keys + ["i"]).groupBy(*keys, "i").agg(
        F.array_sort(F.collect_list(F.struct("j", c.alias("c")))).alias("row"), (F.first("view") - lam * F.avg("cov")).alias("right"))
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.concat(F.col("row.c"), F.array("right")).alias("row")))).alias("m"))
    prior = 1.0 / F.size("m")
    x = rows.withColumn("y", solved(F.col("m.row"))).withColumn("w", F.transform("y", lambda y: F.greatest(prior + tau / lam * y, F.lit(0.0))))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    x = x.withColumn("e", F.arrays_zip(F.col("m.i").alias("ticker"), F.col("w"))).withColumn("total", total).select(*keys, "total", prior.alias("prior"), F.explode("e").alias("e"))
    return x.select(*keys, F.col("e.ticker").alias("ticker"), F.when(F.col("total") >= 1e-9, F.col("e.w") / F.col("total")).otherwise(F.col("prior")).alias("weight"))


def blend(parts: list[tuple[DataFrame, float]], keys: list[str]) -> DataFrame:
    """Convex mix of weight tables, clipped at zero and normalised."""
    u = stacked(*[df.select(*keys, "ticker", (F.col("weight") * share).alias("weight")) for df, share in parts])
    g = u.groupBy(*keys, "ticker").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("weight"))
    return g.withColumn("weight", _share(F.col("weight"), keys, 1e-9))


def optimize_portfolio(scores: DataFrame, returns: DataFrame, sectors: DataFrame, keys: list[str],
                       max_position: float = 0.20, floor: float = 0.03, max_sector: float = 0.35,
                       target_vol: float = 0.12) -> DataFrame:
    """The full construction: blend of three methods, then the constraints.

    ``scores`` = (keys, ticker, score); ``returns`` = aligned (keys, ticker, t, x).
    Portfolios with fewer than 20 return days get equal weights.  ``rank`` orders a portfolio by weight.
    """
    cov = ledoit_wolf(returns, keys).where("n >= 20")
    sig = returns.groupBy(*keys, "ticker").agg(F.stddev_samp("x").alias("sigma"), F.count("*").alias("n")).where("n >= 20")
    usable = scores.join(sig.select(*keys, "ticker", "sigma"), keys + ["ticker"])
    bl = black_litterman(usable.select(*keys, "ticker", "score"), cov, keys)
    tail = cvar_weights(cvar(returns, keys).where("n >= 20"), keys)
    ke = kelly(usable, keys)
    w = blend([(bl, 0.40), (tail, 0.30), (ke, 0.30)], keys)
    w = min_position(cap_positions(hhi_smooth(w, keys), keys, max_position), keys, floor)
    w = w.join(sectors.select("ticker", "sector"), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    w = sector_constraints(w.select(*keys, "ticker", "sector", "weight"), keys, max_sector)
    w = min_position(vol_target(w, cov, keys, target_vol), keys, floor, renormalise=False)
    built = w.select(*keys, "ticker", "sector", "weight")
    done = built.select(*keys).distinct()
    rest = scores.join(done, keys, "left_anti").join(sectors.select("ticker", "sector"), "ticker", "left").select(
        *keys, "ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        (1.0 / F.count("*").over(W.partitionBy(*keys))).alias("weight"))
    order = W.partitionBy(*keys).orderBy(F.desc("weight"), "ticker")
    return stacked(built, rest).withColumn("rank", F.row_number().over(order))


# ---- changes between two portfolios ----

def weight_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing of two weight tables with missing sides as 0."""
    o = old.select(*keys, "ticker", F.col("weight").alias("old_weight"))
    n = new.select(*keys, "ticker", F.col("weight").alias("new_weight"))
    return o.join(n, keys + ["ticker"], "full_outer").select(
        *keys, "ticker", F.coalesce("old_weight", F.lit(0.0)).alias("old_weight"), F.coalesce("new_weight", F.lit(0.0)).alias("new_weight"))


def turnover(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Two-way and one-way turnover per portfolio."""
    return changes.groupBy(*keys).agg(F.sum(F.abs(F.col("new_weight") - F.col("old_weight"))).alias("turnover")).withColumn(
        "one_way", F.col("turnover") / 2.0)


def turnover_filter(changes: DataFrame, keys: list[str], threshold: float = 0.02, renormalise: bool = True) -> DataFrame:
    """Ignore small changes, drop dust, optionally renormalise to one."""
    kept = F.when(F.abs(F.col("new_weight") - F.col("old_weight")) > threshold, F.col("new_weight")).otherwise(F.col("old_weight"))
    x = changes.select(*keys, "ticker", kept.alias("weight")).where("weight > 1e-6")
    return x.withColumn("weight", _share(F.col("weight"), keys)) if renormalise else x


def turnover_cap(changes: DataFrame, keys: list[str], max_delta: float = 0.30) -> DataFrame:
    """Move at most ``max_delta`` towards the new weight."""
    d = F.col("new_weight") - F.col("old_weight")
    return changes.select(*keys, "ticker", F.when(F.abs(d) > max_delta, F.col("old_weight") + F.signum(d) * max_delta)
                          .otherwise(F.col("new_weight")).alias("weight"))


def rebalance_costs(changes: DataFrame, adv: DataFrame, keys: list[str], notional: float = 100_000.0) -> DataFrame:
    """Cost per traded name (keys, ticker, delta, adv, cost, cost_bps)."""
    x = changes.withColumn("delta", F.abs(F.col("new_weight") - F.col("old_weight"))).where("delta >= 1e-6")
    x = x.join(adv.select(*keys, "ticker", "adv"), keys + ["ticker"], "left").withColumn("adv", F.coalesce("adv", F.lit(0.0)))
    cost = trade_cost("delta", "adv", F.lit(notional))
    return x.select(*keys, "ticker", "delta", "adv", cost.alias("cost"),
                    (cost * notional / (F.col("delta") * notional + 1e-6) * 10_000).alias("cost_bps"))


# ---- factor covariance model ----

def factor_series(returns: DataFrame) -> DataFrame:
    """Standardised market, momentum and low-volatility factor per date.

    Tie-shared percentile ranks of n names always average (n + 1) / 2n, so the
    equal-weight momentum rank needs only the count of ranked names per date.
    """
    w = W.partitionBy("ticker").orderBy("d")
    past = w.rowsBetween(-63, -1)
    vol = w.rowsBetween(-21, -1)
    x = returns.select(
        "ticker", "d", "ret", (F.count("ret").over(past) == 63).alias("ranked"),
        F.when(F.count("ret").over(vol) == 21, 1.0 / (F.stddev_samp("ret").over(vol) + 1e-8)).alias("inv"))
    g = x.groupBy("d").agg(
        F.avg("ret").alias("market"), F.count_if("ranked").alias("k"),
        F.coalesce(F.try_divide(F.sum(F.col("inv") * F.col("ret")), F.sum("inv")), F.lit(0.0)).alias("quality"))
    g = g.withColumn("momentum", F.when(F.col("k") > 0, 0.5 / F.col("k")).otherwise(0.0))
    names = ("market", "momentum", "quality")
    # one row: three means and deviations over the dates
    st = g.agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "m"), (F.stddev_pop, "s"))]).withColumn("one", F.lit(1))
    z = g.withColumn("one", F.lit(1)).join(st, "one")
    return z.select("d", *[((F.col(n) - F.col(f"{n}_m")) / (F.col(f"{n}_s") + 1e-8)).alias(n) for n in names])


def factor_loadings(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """Per-ticker least squares on the three factors: loadings, R2, residual variance.

    Spark sums the normal equations per ticker; the 4 x 4 solve is one
    vectorised function over all tickers of a batch.
    """
    cols = ["one", "market", "momentum", "quality"]
    j = returns.join(factors.withColumn("one", F.lit(1.0)), "d")
    xx = [F.sum(F.col(a) * F.col(b)).alias(f"s{i}{k}") for i, a in enumerate(cols) for k, b in enumerate(cols) if k >= i]
    xy = [F.sum(F.col(a) * F.col("ret")).alias(f"y{i}") for i, a in enumerate(cols)]
    g = j.groupBy("ticker").agg(*xx, *xy, F.sum(F.col("ret") * F.col("ret")).alias("yy"), F.count("*").alias("n"))

    @F.pandas_udf("array<double>")
    def solve(sxx: pd.Series, sxy: pd.Series) -> pd.Series:
        a = np.stack([np.asarray(v, float) for v in sxx]).reshape(-1, 4, 4)
        b = np.stack([np.asarray(v, float) for v in sxy])[..., None]
        # minimum-norm solution, also for collinear factors
        return pd.Series(list((np.linalg.pinv(a, rcond=1e-10, hermitian=True) @ b)[..., 0]))
    full = F.array(*[F.col(f"s{min(i, k)}{max(i, k)}") for i in range(4) for k in range(4)])
    x = g.withColumn("b", solve(full, F.array(*[F.col(f"y{i}") for i in range(4)])))
    fit = sum((F.col("b")[i] * F.col(f"y{i}") for i in range(4)), F.lit(0.0))
    var = F.greatest((F.col("yy") - fit) / F.col("n"), F.lit(0.0))     # residuals average to zero
    tot = F.col("yy") / F.col("n") - F.pow(F.col("y0") / F.col("n"), F.lit(2.0)) + 1e-10
    return x.select("ticker", "n", F.col("b")[1].alias("market"), F.col("b")[2].alias("momentum"), F.col("b")[3].alias("quality"),
                    var.alias("specific_var"), F.least(F.greatest(1 - var / tot, F.lit(0.0)), F.lit(1.0)).alias("r_squared"))


def factor_cov(factors: DataFrame) -> DataFrame:
    """3 x 3 sample covariance of the factor series as rows (a, b, fcov)."""
    names = ["market", "momentum", "quality"]
    g = factors.agg(*[F.covar_samp(a, b).alias(f"{a}__{b}") for a in names for b in names])
    return g.unpivot([], g.columns, "pair", "fcov").select(
        F.split("pair", "__")[0].alias("a"), F.split("pair", "__")[1].alias("b"), "fcov")


def factor_model_cov(loadings: DataFrame, fcov: DataFrame, names: DataFrame, shrunk: DataFrame, alpha: float = 0.30) -> DataFrame:
    """Blend B F B' + D with the shrunk covariance for the given short name list.

    ``names`` = (keys..., ticker): pairs are formed inside a portfolio only.
    """
    keys = [c for c in names.columns if c != "ticker"]
    long = names.join(loadings, "ticker").unpivot(keys + ["ticker", "specific_var"], ["market", "momentum", "quality"], "f", "b")
    left = long.select(*keys, F.col("ticker").alias("i"), F.col("f").alias("a"), F.col("b").alias("bi"), "specific_var")
    right = long.select(*keys, F.col("ticker").alias("j"), F.col("f").alias("b"), F.col("b").alias("bj"))
    sys = left.join(fcov, "a").join(right, keys + ["b"]).groupBy(*keys, "i", "j").agg(
        F.sum(F.col("bi") * F.col("fcov") * F.col("bj")).alias("systematic"), F.max("specific_var").alias("sv"))
    model = F.col("systematic") + F.when(F.col("i") == F.col("j"), F.col("sv")).otherwise(0.0)
    return sys.join(shrunk.select(*keys, "i", "j", "cov"), keys + ["i", "j"], "left").select(
        *keys, "i", "j", F.when(F.col("cov").isNull(), model).otherwise((1 - alpha) * model + alpha * F.col("cov")).alias("cov"))


def risk_attribution(weights: DataFrame, loadings: DataFrame, fcov: DataFrame, keys: list[str]) -> DataFrame:
    """Factor and specific variance of each portfolio with percentages per factor."""
    j = weights.join(loadings, "ticker")
    names = ["market", "momentum", "quality"]
    g = j.groupBy(*keys).agg(*[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names],
                             F.sum(F.col("weight") * F.col("weight") * F.col("specific_var")).alias("specific_variance"))
    long = g.unpivot(keys + ["specific_variance"], names, "a", "ea")
    other = g.unpivot(keys, names, "b", "eb")
    q = long.join(fcov, "a").join(other, keys + ["b"])
    part = F.col("ea") * F.col("fcov") * F.col("eb")
    agg = q.groupBy(*keys).agg(
        F.max("specific_variance").alias("specific_variance"), F.sum(part).alias("factor_variance"),
        *[F.sum(F.when((F.col("a") == n) & (F.col("b") == n), part)).alias(f"{n}_var") for n in names])
    tot = F.col("factor_variance") + F.col("specific_variance") + 1e-12
    return agg.select(*keys, tot.alias("total_variance"), "factor_variance", "specific_variance",
                      (F.col("factor_variance") / tot * 100).alias("factor_pct"), (F.col("specific_variance") / tot * 100).alias("specific_pct"),
                      *[(F.col(f"{n}_var") / tot * 100).alias(f"{n}_pct") for n in names])
