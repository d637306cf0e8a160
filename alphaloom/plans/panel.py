"""The point-in-time research panel: one row per (rebalance, eligible ticker)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alphaloom.operators import crosssection as CS
from alphaloom.operators import fundamentals as FU
from alphaloom.operators import ic as IC
from alphaloom.operators.features import price_features
from alphaloom.operators.regime import with_regime_asof
from alphaloom.operators.scale import attach
from alphaloom.operators.trading_calendar import at_rebalances, rebalance_calendar, served_rebalances, trading_days
from alphaloom.params import Params
from alphaloom.sources.storage import materialize


def calendar(bars: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(trading days, rebalance dates), written once: tiny and used everywhere."""
    days = materialize(trading_days(bars).coalesce(1), "days")
    return days, rebalance_calendar(days, p.rebalance_days)


def pit_universe(bars: DataFrame, p: Params, cal: tuple[DataFrame, DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Tickers with enough history and dollar volume strictly before each rebalance.

    ``known``: what else is taken along by ticker and date, where the features are (see ``features._long_frames``).
    """
    days, reb = cal or calendar(bars, p)
    # the rows in question are marked before the frames, so that no other one leaves its task
    served = served_rebalances(bars, days, reb, p.rebalance_days).withColumn("__served", F.expr("__from <= __to"))
    if known is None:
        at = at_rebalances(price_features(served, only="__served", carry=("__from", "__to")), reb)
    else:
        dates = {r["k"]: r["reb_d"] for r in reb.select("k", "reb_d").collect()}      # the calendar
        at = price_features(served, only="__served", known=known, dates=dates).join(F.broadcast(reb.select("k", "reb_d")), "k")
    return at.where((F.col("n") >= p.min_history) & (F.col("adv") >= p.min_adv))


# what the factors and the rules for positions read of the features and of the statements
FEATURES = ("close", "momentum_12_1", "ret_6m", "ret_3m", "ret_1m", "vol", "vol_regime", "skewness", "mean_reversion", "high_52w_proximity",
            "trend_slope", "flow_signal", "liquidity", "earnings_surprise", "adv")
STATEMENTS = ("roe_pct", "roic_pct", "op_margin_pct", "fcf_margin_pct", "gross_margin_pct", "revenue_growth", "piotroski", "accruals",
              "pe_ratio", "ps_ratio", "fmp_alpha", "sentiment")
_SOURCES = ("revenue", "net_income", "cfo", "total_assets", "roa_pct", "de_ratio", "current_ratio")      # and what these come from


def _known(sectors: DataFrame, fundamentals: DataFrame | None, members: DataFrame | None) -> DataFrame:
    """(ticker, t, the ticker's sectors and memberships, what its statements say from t on)."""
    own = sectors.where("ticker is not null").groupBy("ticker").agg(F.collect_list(F.coalesce("sector", F.lit("Unknown"))).alias("__sectors"))
    if members is not None:
        since = F.struct(F.col("valid_from").cast("date").alias("valid_from"), F.col("valid_to").cast("date").alias("valid_to"))
        own = own.join(members.where("ticker is not null").groupBy("ticker").agg(F.collect_list(since).alias("__members")), "ticker", "full")
    if fundamentals is None:
        return own.withColumn("t", F.lit(None).cast("date"))
    f = FU.ratios(fundamentals)
    f = FU.known_from(f.select("ticker", "available_date", *[c for c in f.columns if c in (*STATEMENTS, *_SOURCES)]))
    f = FU.piotroski(FU.growth(f)).withColumn("accruals", FU.accruals())
    return f.select("ticker", "t", *[c for c in STATEMENTS if c in f.columns]).join(own, "ticker", "full")


def research_panel(bars: DataFrame, sectors: DataFrame, regimes: DataFrame, p: Params, fundamentals: DataFrame | None = None,
                   members: DataFrame | None = None, cal: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Features, statements, scores and regime known at each rebalance date.

    Materialised: several statistics are taken over it.  What is known of a ticker (statements, memberships, sector) meets its
    bars before a row for each rebalance is made of them; the rows of the panel, many times as wide, are not shuffled.
    """
    cal = cal or calendar(bars, p)
    at = pit_universe(bars, p, cal, _known(sectors, fundamentals, members))
    at = at.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    if fundamentals is not None:      # without a statement no test is passed but that of the share count
        at = at.withColumns({"piotroski": F.coalesce("piotroski", F.lit(1)), "accruals": F.coalesce("accruals", F.lit(0.0))})
    kept = [c for c in ("k", "ticker", "reb_d", "sector", *FEATURES, *STATEMENTS) if c in at.columns]
    at = attach(at.select(*kept), with_regime_asof(cal[1].select("reb_d"), regimes, "reb_d"), ["reb_d"])
    return materialize(at, "panel")


CARRIED = ["reb_d", "vol", "adv"]


def normalized_panel(panel: DataFrame, min_universe: int = 5) -> DataFrame:
    """z-scores (k, regime, ticker, sector, reb_d, vol, adv, a column per factor) of large enough universes.

    The regime goes with the rebalance, so it takes part in the grouping and need not be joined again.
    """
    enough = panel.groupBy("k").agg(F.count("*").alias("universe")).where(F.col("universe") >= min_universe)
    return CS.normalized(attach(panel, enough.select("k"), ["k"]), ["k", "regime"], CARRIED)


def zscored_panel(panel: DataFrame, min_universe: int = 5) -> DataFrame:
    """The same as rows (k, regime, ticker, factor, z)."""
    return CS.stacked_factors(normalized_panel(panel, min_universe), ["k", "regime"])


def with_regime(z: DataFrame, panel: DataFrame) -> DataFrame:
    if "regime" in z.columns:
        return z
    return attach(z, panel.groupBy("k").agg(F.first("regime").alias("regime")), ["k"])


def ic_scales(z: DataFrame, panel: DataFrame, forward: DataFrame, p: Params) -> DataFrame:
    """(k, factor, scale) of the weights, from correlations whose returns had ended before the rebalance.

    ``forward`` = (k, ticker, fwd_return, closed): realised returns and the date of their last price.
    """
    known = forward.groupBy("k").agg(F.max("closed").alias("known_d"))
    wide = "factor" not in z.columns
    ic = IC.factor_ic(z if wide else z.select("k", "ticker", "factor", "z"), forward.select("k", "ticker", "fwd_return"), ["k"])
    of = z.select("k").distinct().withColumn("factor", F.explode(F.array(*map(F.lit, CS.FACTORS)))) if wide else z.select("k", "factor").distinct()
    probes = of.join(panel.select("k", "reb_d").distinct(), "k")
    return materialize(IC.known_scales(ic.join(known, "k").select("factor", "k", "known_d", "ic"), probes, p.ic_window, p.ic_half_life), "scales")


def scores(z: DataFrame, panel: DataFrame, kind: str = "longterm", scales: DataFrame | None = None) -> DataFrame:
    """Composite score and its cross-sectional z per (k, ticker); ``scales`` multiply the weights of the regime.

    ``z`` from ``normalized_panel`` carries what the result needs, so no row of it is shuffled.
    """
    score = CS.long_term_scores if kind == "longterm" else CS.swing_scores
    if "factor" not in z.columns:
        s = CS.zscore(score(z, panel, ["k"], scales), ["k"], "score", "cs_score", eps=1e-9)
        return s.select("k", "ticker", "score", "cs_score", "reb_d", "regime", "vol", "adv", "sector")
    s = CS.zscore(score(with_regime(z, panel), panel, ["k"], scales), ["k"], "score", "cs_score", eps=1e-9)
    return s.join(panel.select("k", "ticker", "reb_d", "regime", "vol", "adv", "sector"), ["k", "ticker"])
